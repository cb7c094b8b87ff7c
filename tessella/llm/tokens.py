"""Byte-level BPE ids by the tokenizers library, with a bounded cache of pieces.

A byte-level BPE splits its text before merging, and a split never spans the start of a run of white
space, nor a mark such as a full stop between a letter and white space. A text cut there has the same
ids piece by piece; it isn't cut within or behind the strings of added tokens, which the library looks
for first, nor behind white space outside ASCII, which goes on in one run. Each worker process keeps the
ids of SLOTS pieces in fixed numpy arrays and has the library encode the pieces that it doesn't find,
many in one call. Pieces are told apart by 64-bit hashes. Texts are worked on in windows, so that a task
needs about 15 bytes for each byte of its longest text.
"""

from __future__ import annotations

import numpy as np

from tessella.llm._shared import _BASE, _BYTE, _INV, _IS_SPACE, _STEP, WINDOW_BYTES, _power, gathered, mix64

#: Cached pieces for each worker process (a power of two), and the most ids of one of them.
SLOTS, WIDTH = 1 << 18, 8

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
#: Lead bytes of white space outside ASCII, and the controls that some libraries count as white space.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF, 0x1C, 0x1D, 0x1E, 0x1F]] = True


def _odd(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which white space outside ASCII may start, and how many bytes it has."""
    at = np.flatnonzero(_LEAD[text])
    a = text[at]
    b = text[np.minimum(at + 1, len(text) - 1)]
    c = text[np.minimum(at + 2, len(text) - 1)]
    hit = (a < 0x20) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0)))
    hit |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8F) | ((c >= 0xA8) & (c <= 0xAF)))) | (b == 0x81))
    hit |= ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xEF) & (b == 0xBB) & (c == 0xBF))
    return at[hit], np.where(a[hit] < 0x20, 1, np.where(a[hit] == 0xC2, 2, 3))


class Encoder:
    """The library's ids of blocks of texts, as encode(text, add_special_tokens=False) gives them."""

    def __init__(self, path: str, slots: int = SLOTS, window: int = WINDOW_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.window = window
        self.added = [x.content.encode() for x in t.get_added_tokens_decoder().values() if x.content]
        self.context = max([64, *(len(x) + 1 for x in self.added)])
        self.size = np.zeros(t.get_vocab_size(), np.int64)
        for token, i in t.get_vocab().items():
            self.size[i] = len(token)  # the byte-level alphabet has one character for each byte
        self.keys = np.zeros(slots, np.uint64)
        self.lens = np.zeros(slots, np.int64)
        self.held = np.zeros(slots * WIDTH, np.int32)
        self.mask = np.uint64(slots - 1)

    def _many(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cuts(self, offsets: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of a block start, and which of them must be encoded each for itself."""
        n = len(text)
        found, alone = [], []
        for a in range(0, n, self.window):
            b = min(n, a + self.window)
            low, high = max(0, a - self.context), min(n, b + self.context)
            part = text[low:high]
            space = _IS_SPACE[part]
            cut = space.copy()
            cut[1:] &= ~space[:-1]
            edge = np.zeros(len(part) + 1, bool)
            edge[offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high, "right")] - low] = True
            mark = np.flatnonzero(_MARK[part[1:]] & _LETTER[part[:-1]]) + 1
            after = np.minimum(mark + 1, len(part) - 1)
            cut[mark[((space[after] & (after > mark)) | edge[mark + 1]) & ~edge[mark]]] = True
            at, size = _odd(part)
            cut[(at + size)[at + size < len(part)]] = False
            raw = part.tobytes() if self.added else b""
            for token in self.added:
                k = raw.find(token)
                while k >= 0:
                    cut[k + 1 : k + len(token) + 1] = False
                    alone.append(np.array([k + low]))
                    k = raw.find(token, k + 1)
            cut |= edge[:-1]
            alone.append(at + low)
            found.append((np.flatnonzero(cut[a - low : b - low]) + a).astype(np.int32))
        start, odd = np.concatenate(found), np.sort(np.concatenate(alone))
        own = np.searchsorted(odd, start)
        return start, np.append(own[1:], len(odd)) > own

    def _learn(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the given pieces, one after another, and the number of ids of each."""
        size = end - start
        joined = _IS_SPACE[text[start]] & ~_IS_SPACE[text[end - 1]] & ~alone
        lens = np.zeros(len(start), np.int64)
        parts: list[np.ndarray] = []
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])
        n = int(joined.sum())
        if n:
            s, z = start[order[:n]], size[order[:n]]
            ids = np.asarray(self._many([gathered(text, s, z).tobytes().decode()])[0], np.int32)
            cut = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(z)) + 1
            lens[order[:n]] = np.diff(cut, prepend=0)
            parts.append(ids)
        if n < len(order):
            raw = [text[a:b].tobytes().decode() for a, b in zip(start[order[n:]].tolist(), end[order[n:]].tolist())]
            got = self._many(raw)
            lens[order[n:]] = [len(x) for x in got]
            parts += [np.asarray(x, np.int32) for x in got]
        flat = np.concatenate(parts)
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(lens[order]) - lens[order]
        return gathered(flat, at, lens), lens

    def _pieces(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of consecutive pieces that fill text, and the number of ids of each."""
        n = len(text)
        if n > 2 * self.window:  # a single piece, longer than a window
            ids = np.asarray(self._many([text.tobytes().decode()])[0], np.int32)
            return ids, np.array([len(ids)])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[text] * _power(_BASE, n), dtype=np.uint64)])
        key = mix64(((sums[end] - sums[start]) * _power(_INV, n)[start]) ^ ((end - start).astype(np.uint64) * _STEP))
        slot = (key & self.mask).astype(np.int64)
        hit = self.keys[slot] == key
        lens = self.lens[slot]
        source = slot * WIDTH
        if hit.all():
            return gathered(self.held, source, lens), lens
        miss = np.flatnonzero(~hit)
        new, first, inverse = np.unique(key[miss], return_index=True, return_inverse=True)
        one = miss[first]
        ids, count = self._learn(text, start[one], end[one], alone[one])
        at = np.cumsum(count) - count
        lens[miss] = count[inverse]
        source[miss] = at[inverse] - len(ids)  # below zero: among the new ids
        index = np.repeat(source - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        out = self.held[np.maximum(index, 0)]
        fresh = index < 0
        out[fresh] = ids[index[fresh] + len(ids)]
        short = np.flatnonzero(count <= WIDTH)
        _, pick = np.unique(new[short] & self.mask, return_index=True)
        keep = short[pick]
        where = (new[keep] & self.mask).astype(np.int64)
        self.keys[where], self.lens[where] = new[keep], count[keep]
        to = np.repeat(where * WIDTH - (np.cumsum(count[keep]) - count[keep]), count[keep]) + np.arange(int(count[keep].sum()))
        self.held[to] = gathered(ids, at[keep], count[keep])
        return out, lens

    def block(self, offsets: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all the texts of a block (see text_buffers), and where each text's ids start."""
        n = len(text)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        start, alone = self.cuts(offsets, text)
        ids, lens, i = [], [], 0
        while i < len(start):  # pieces of about a window at a time
            j = max(i + 1, int(np.searchsorted(start, start[i] + self.window, "right")) - 1) if start[-1] > start[i] + self.window else len(start)
            base, to = int(start[i]), int(start[j]) if j < len(start) else n
            own = start[i:j].astype(np.int64) - base
            got, count = self._pieces(text[base:to], own, np.append(own[1:], to - base), alone[i:j])
            ids.append(got)
            lens.append(count.astype(np.int32))
            i = j
        ends_at = np.concatenate([[0], np.cumsum(np.concatenate(lens), dtype=np.int64)])
        return np.concatenate(ids) if len(ids) > 1 else ids[0], ends_at[np.searchsorted(start, offsets)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

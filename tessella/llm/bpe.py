"""Byte-level BPE by speculation and verification, and decoding.

Greedy longest match proposes the tokens of a word: all positions walk the vocabulary's tree at once. A
sequence of tokens is the one that merging gives if and only if every two neighbours are compatible, that is,
if merging the bytes of the two gives just these two. So a proposal is checked pair by pair, all pairs of a
block at once, and only words with a pair that fails are merged exactly.

Two tokens are compatible if no merge across their border comes in time. Their merges are undone, the later
one first, along the border: at each step a piece of the left token meets a piece of the right one, and their
merge, if there is one, must not come before both have gone into what they were undone from. Of equal merges
the leftmost comes first. Tokens that merging their own bytes doesn't give are never proposed.

Texts are split as the vocabulary file says; pieces that recur are kept as in `tokens`.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import _BASE, _BYTE, _INV, _STEP, WINDOW_BYTES, _power, byte_slices, gathered, lean, mix64, text_buffers
from tessella.llm.tokens import SLOTS, WIDTH, Encoder

#: Bytes of a word that are merged at a time; longer words are merged in blocks, whose seams are mended.
LONG_WORD = 4096
#: Words up to so many bytes are merged side by side, longer ones each for itself.
SHORT_WORD = 64
NEVER = 1 << 40
#: Endings that are words of their own behind an apostrophe, and white space.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)


def byte_alphabet() -> list[str]:
    """The character of each byte: printable ones stand for themselves, the others follow 255 in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def char_classes(path: str) -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE of every code point, for the Unicode version of the tokenizers library, which is asked about those that the versions at hand see differently."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path).pre_tokenizer
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, name, sample in ((LETTER, "L", "a"), (NUMBER, "N", "1")):
        new = set(regex.findall(rf"\p{{{name}}}", text))
        old = {c for c in text if unicodedata.category(c)[0] == name}
        out[[ord(c) for c in new & old]] = kind
        out[[ord(c) for c in new ^ old if len(library.pre_tokenize_str(sample + c)) == 1]] = kind
    out[list(SPACES)] = SPACE
    return out


def word_starts(chars: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Marks where the words of texts (code points and their classes, with an EDGE between texts) start: runs of one class, with the space before them, or an apostrophe's ending.

    Of white space in front of something else the last character stands apart; it belongs to what follows if it is a space.
    """
    n = len(chars)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != EDGE))
    start[last] = True
    start[last[chars[last] == 32] + 1] = False
    mark = np.flatnonzero((chars[:-1] == 39) & (kind[:-1] == OTHER))
    before = np.where(mark > 0, kind[mark - 1], EDGE)
    mark = mark[(before == LETTER) | (before == NUMBER) | (before == EDGE) | ((before == SPACE) & (chars[mark - 1] != 32))]
    for ending in ENDINGS:
        own = mark[mark + len(ending) < n]
        for i, c in enumerate(ending, 1):
            own = own[(chars[own + i] == ord(c)) & (kind[own + i] == LETTER)]
        for i in range(1, len(ending) + 1):
            start[own + i] = False
        own = own + len(ending) + 1
        start[own[own < n]] = True
    return start


class Vocabulary:
    """A byte-level BPE's tokens, merges, and tree of tokens, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path} isn't a byte-level BPE without normalizer and prefix space")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in what is around them")
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        raw = lambda t: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"] if t["content"]}
        names = {i: t for t, i in [*vocab.items(), *self.added.items()]}
        self.count = max(names) + 1
        tokens = [raw(names.get(i, "")) for i in range(self.count)]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.base = np.array([vocab[c] for c in byte_alphabet()], np.int64)

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        if len(np.unique(made)) < len(made):
            raise ValueError(f"{path} has a token with two merges")
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.rank = np.full(self.count, -1, np.int64)
        self.left = np.arange(self.count)
        self.right = np.arange(self.count)
        self.made = made
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), left, right
        order = np.argsort(left * self.count + right)
        self.pair_keys, self.pair_ranks = (left * self.count + right)[order], order
        self.merges = dict(zip((left * self.count + right).tolist(), zip(range(len(made)), made.tolist())))
        own = np.zeros(self.count, bool)
        own[self.base] = True
        sound = ~self.clashes(left, right, np.arange(len(made)), np.arange(len(made)))
        for i, a, b, ok in zip(made.tolist(), left.tolist(), right.tolist(), sound.tolist()):
            own[i] = ok and own[a] and own[b]
        self._tree([(tokens[i], i) for i in np.flatnonzero(own).tolist()])

    def _tree(self, tokens: list[tuple[bytes, int]]) -> None:
        """keys (node * 256 + byte, sorted) and their child nodes; token of each node or -1. The root is node 0."""
        nodes, token = {b"": 0}, [-1]
        edges = []
        for t, i in sorted(tokens):
            for k in range(1, len(t) + 1):
                if t[:k] not in nodes:
                    nodes[t[:k]] = len(token)
                    edges.append((nodes[t[: k - 1]] * 256 + t[k - 1], len(token)))
                    token.append(-1)
            token[nodes[t]] = i
        edges.sort()
        self.keys, self.child = (np.array(x, np.int64) for x in zip(*edges))
        self.token = np.array(token, np.int64)
        self.first = np.zeros(256, np.int64)
        self.first[self.keys[self.keys < 256]] = self.child[self.keys < 256]
        self.deep = max(len(t) for t, _ in tokens)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of merges of a with b, NEVER where there is none."""
        key = a * self.count + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def clashes(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray | None = None, b_ends: np.ndarray | None = None) -> np.ndarray:
        """Whether a merge across the border of neighbours a and b comes in time; the ends are the ranks at which these go into others."""
        bad, live = np.zeros(len(a), bool), np.arange(len(a))
        ea = np.full(len(a), NEVER) if a_ends is None else a_ends
        eb = np.full(len(a), NEVER) if b_ends is None else b_ends
        while len(live):
            r = self.ranks(a, b)
            clash = (r < ea) & (r <= eb)
            bad[live[clash]] = True
            ra, rb = self.rank[a], self.rank[b]
            go = ~clash & ((ra >= 0) | (rb >= 0))
            undo = ra > rb  # of equal merges the right one came later
            ea, a = np.where(undo, ra, ea)[go], np.where(undo, self.right[a], a)[go]
            eb, b = np.where(undo, eb, rb)[go], np.where(undo, b, self.left[b])[go]
            live = live[go]
        return bad

    def propose(self, text: np.ndarray, ends: np.ndarray, window: int = WINDOW_BYTES) -> np.ndarray:
        """Greedy longest matches, one after another, through words that end at `ends`; none goes over an end."""
        n, out, at = len(text), array("i"), 0
        for a in range(0, n, window):
            b = min(n, a + window)
            best, size = self._longest(text[a : min(n, b + self.deep)], b - a, ends, a)
            step, token = size.tolist(), best.tolist()
            at -= a
            while at < b - a:
                out.append(token[at])
                at += step[at]
            at += a
        return np.frombuffer(out, np.int32).astype(np.int64) if len(out) else np.zeros(0, np.int64)

    def _longest(self, part: np.ndarray, n: int, ends: np.ndarray, a: int) -> tuple[np.ndarray, np.ndarray]:
        """The longest token at each of the first n positions of part, which starts at a, and its bytes."""
        room = ends[np.searchsorted(ends, np.arange(a, a + n), "right")] - np.arange(a, a + n)
        node = self.first[part[:n]]
        best, size = self.token[node], np.ones(n, np.int64)
        live, depth = np.flatnonzero(room > 1), 1
        node = node[live]
        while len(live):
            key = node * 256 + part[live + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            live, node = live[found], self.child[at[found]]
            depth += 1
            token = self.token[node]
            whole = token >= 0
            best[live[whole]], size[live[whole]] = token[whole], depth
            more = room[live] > depth
            live, node = live[more], node[more]
        return best, size

    def merge(self, word: bytes) -> list[int]:
        """The tokens of a word by merging: always the merge of the lowest rank, of equal ones the leftmost."""
        if len(word) <= LONG_WORD:
            return self._merge(word)
        out: list[int] = []
        for i in range(0, len(word), LONG_WORD):
            self._join(out, self._merge(word[i : i + LONG_WORD]))
        return out

    def _merge(self, word: bytes) -> list[int]:
        ids = self.base[np.frombuffer(word, np.uint8)].tolist()
        n, many, merges = len(ids), self.count, self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := merges.get(ids[i] * many + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or (m := merges.get(ids[i] * many + ids[j])) is None or m[0] != rank:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get(new * many + ids[k]):
                    heapq.heappush(heap, (m[0], i, m[1]))
            k = before[i]
            if k >= 0 and (m := merges.get(ids[k] * many + new)):
                heapq.heappush(heap, (m[0], k, m[1]))
        return [i for i in ids if i >= 0]

    def _join(self, left: list[int], right: list[int]) -> None:
        """Append what follows: around the seam, tokens are merged anew, more and more of them, until all neighbours are compatible."""
        k = 0
        fits = lambda a, b: not self.clashes(np.array([a]), np.array([b]))[0]
        middle: list[int] = []
        while left and right:
            a, b = left[: len(left) - k][-1:], right[k : k + 1]
            seam = [*a, *middle, *b] if middle else [*a, *b]
            edges = [(seam[0], seam[1])] * bool(a) + [(seam[-2], seam[-1])] * bool(b)
            if all(fits(x, y) for x, y in edges if len(seam) > 1):
                break
            k = 2 * k or 4
            middle = self._merge(self.text(np.array([*left[-k:], *right[:k]])))
        if k:
            del left[-k:]
        left += middle
        left += right[k:]

    def text(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens, one after another; ids without a token have none."""
        ids = ids[(ids >= 0) & (ids < self.count)]
        return gathered(self.bytes, self.starts[ids], self.sizes[ids]).tobytes()

    def _merge_short(self, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of short words by merging, a merge of each word at a time, and their numbers."""
        ids, word = self.base[text], np.repeat(np.arange(len(size)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(ids), NEVER)
        pair = np.flatnonzero(word[1:] == word[:-1])
        rank[pair] = self.ranks(ids[pair], ids[pair + 1])
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            over = least == NEVER
            if over.any():
                done.append((word[over], ids[over]))
                ids, word, rank, least = ids[~over], word[~over], rank[~over], least[~over]
            at = np.flatnonzero(rank == least)
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])] if len(at) else at
            ids[at] = self.made[rank[at]]
            gone = np.ones(len(ids), bool)
            gone[at + 1] = False
            at -= np.arange(len(at))
            ids, word, rank = ids[gone], word[gone], rank[gone]
            for i in (at, at - 1):
                i = i[(i >= 0) & (i + 1 < len(ids))]
                rank[i] = np.where(word[i] == word[i + 1], self.ranks(ids[i], ids[i + 1]), NEVER)
            if len(at) and len(ids) and at[-1] == len(ids) - 1:
                rank[-1] = NEVER
        word, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(size))

    def words(self, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The tokens of words of these sizes, one after another; the number of each word's tokens; how many words were merged."""
        ends = np.cumsum(size)
        ids = self.propose(text, ends)
        word = np.searchsorted(ends, np.cumsum(self.sizes[ids]), "left")
        counts = np.bincount(word, minlength=len(size))
        pair = np.flatnonzero(word[1:] == word[:-1])
        both, which = np.unique(ids[pair] * self.count + ids[pair + 1], return_inverse=True)
        failed = np.unique(word[pair[self.clashes(both // self.count, both % self.count)[which]]])
        if not len(failed):
            return ids, counts, 0
        short, long = failed[size[failed] <= SHORT_WORD], failed[size[failed] > SHORT_WORD]
        exact, many = [], np.zeros(len(failed), np.int64)
        if len(short):
            own, many[: len(short)] = self._merge_short(gathered(text, ends[short] - size[short], size[short]), size[short])
            exact.append(own)
        for i, w in enumerate(long.tolist(), len(short)):
            exact.append(np.array(self.merge(text[ends[w] - size[w] : ends[w]].tobytes()), np.int64))
            many[i] = len(exact[-1])
        at, order = np.cumsum(counts) - counts, np.concatenate([short, long])
        at[order], counts[order] = len(ids) + np.cumsum(many) - many, many
        return gathered(np.concatenate([ids, *exact]), at, counts), counts, len(failed)


class Speculator(Encoder):
    """The pieces and windows of Encoder, with ids by speculation and verification."""

    def __init__(self, path: str, slots: int = SLOTS, window: int = WINDOW_BYTES):
        self.vocabulary = v = Vocabulary(path)
        self.classes = char_classes(path)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(v.added, key=len, reverse=True)))) if v.added else None
        self.window = window
        self.added = [x.encode() for x in v.added]
        self.context = max([64, *(len(x) + 1 for x in self.added)])
        self.size = v.sizes
        self.keys, self.lens, self.held = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), np.zeros(slots * WIDTH, np.int32)
        self.mask = np.uint64(slots - 1)
        self.merged = 0

    def _spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes, where their words start and end in them, -1 or the id of the added token that a word is, and where each text's words begin."""
        joined = "\0".join([*texts, ""])
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.classes[chars]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kind[ends] = EDGE
        marks = [(m.start(), m.end(), self.vocabulary.added[m.group()]) for m in self.marks.finditer(joined)] if self.marks else []
        for a, b, _ in marks:
            kind[a:b] = EDGE
        begins = word_starts(chars, kind)
        begins[ends] = True
        begins[ends[:-1] + 1] = True
        for a, b, _ in marks:
            begins[a] = begins[b] = True
        start = np.flatnonzero(begins)
        raw = np.frombuffer(joined.encode(), np.uint8)
        at = np.flatnonzero((raw & 0xC0) != 0x80)[start] if len(raw) > len(chars) else start
        mark = np.full(len(start), -1)
        mark[np.searchsorted(start, [m[0] for m in marks])] = [m[2] for m in marks]
        edge = np.searchsorted(start, ends)
        word = np.ones(len(start), bool)
        word[edge] = False
        return raw, at[word], np.append(at[1:], len(raw))[word], mark[word], edge - np.arange(len(edge))

    def _many(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        raw, start, end, mark, to = self._spans(texts)
        if not len(start):
            return [np.zeros(0, np.int32) for _ in texts]
        key = np.empty(len(start), np.uint64)
        for a in range(0, len(start), 1 << 16):  # hashes of words, in windows
            s, e = start[a : a + (1 << 16)], end[a : a + (1 << 16)]
            if e[-1] - s[0] > 4 * self.window and len(s) < 4096:
                key[a : a + (1 << 16)] = [hash(raw[x:y].tobytes()) & 0xFFFFFFFFFFFFFFFF for x, y in zip(s.tolist(), e.tolist())]
                continue
            part = raw[s[0] : e[-1]]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * _power(_BASE, len(part)), dtype=np.uint64)])
            key[a : a + (1 << 16)] = mix64(((sums[e - s[0]] - sums[s - s[0]]) * _power(_INV, len(part) + 1)[s - s[0]]) ^ ((e - s).astype(np.uint64) * _STEP))
        _, first, which = np.unique(key[mark < 0], return_index=True, return_inverse=True)
        plain = np.flatnonzero(mark < 0)
        one = plain[first]
        ids, counts, merged = self.vocabulary.words(gathered(raw, start[one], end[one] - start[one]), end[one] - start[one]) if len(one) else (np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
        self.merged += merged
        size, at = np.ones(len(start), np.int64), np.empty(len(start), np.int64)
        size[plain], at[plain] = counts[which], (np.cumsum(counts) - counts)[which]
        marked = np.flatnonzero(mark >= 0)
        at[marked] = len(ids) + np.arange(len(marked))
        ids = np.concatenate([ids, mark[marked]]).astype(np.int32)
        flat, to = gathered(ids, at, size), np.concatenate([[0], np.cumsum(size)])[to]
        return np.split(flat, to[:-1])


_speculators: dict[str, Speculator] = {}


def speculator(path: str) -> Speculator:
    """One for each worker process and vocabulary."""
    if path not in _speculators:
        _speculators[path] = Speculator(path)
    return _speculators[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every text, as the tokenizers library gives them without special tokens around it.

    path is a byte-level BPE's vocabulary file, which executors have. Null and empty texts have no ids.
    Rows that repeat are encoded each for itself. Other columns are not read. There is no shuffle; texts are
    worked on in windows, and a word of any length in blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = speculator(path)
        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                ids, starts = own.block(*text_buffers(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


_vocabularies: dict[str, Vocabulary] = {}


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """encoded with the text of its ids, special tokens included.

    Null and empty ids give an empty text, ids without a token and null ids nothing; bytes that are no UTF-8
    become U+FFFD, as the library has it. A column with text_col's name is replaced.
    """
    rest = [c for c in encoded.columns if c.lower() != text_col.lower()]
    schema = ", ".join([*(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in rest), f"`{text_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _vocabularies:
            _vocabularies[path] = Vocabulary(path)
        v = _vocabularies[path]
        for batch in batches:
            texts = (v.text(x.values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)).decode(errors="replace") if x.is_valid else "" for x in batch.column(ids_col))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, text_col])

    return encoded.mapInArrow(lean(run), schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 of every document, encoded and decoded."""
    both = decode(encode(docs, path), path)
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))

"""Helpers shared by the training-data operators: scratch tables, column names and text vectors."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.scratch import discard, scratch_dir, written  # noqa: F401

#: The six ASCII white-space bytes that end a word: [\x20\x09-\x0D].
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: The word pattern, for Spark and DuckDB regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Python works on at most about this many bytes of text at a time (at least one document).
CHUNK_BYTES = 512 << 10
#: Bytes, and words, for which figures are held one by one at a time: a single long text is worked on in such windows.
WINDOW_BYTES, GRAM_WINDOW = 512 << 10, 1 << 17


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that docs doesn't have (in any letter case)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean(run):
    """run, for mapInArrow; at its end the worker gives freed memory back, as it lives on for other tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def byte_slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about limit bytes each, at least one row."""
    offsets = text_buffers(column)[0]
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, from 0) and UTF-8 bytes of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    raw = np.frombuffer(data, np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


def gathered(source: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of source[start : start + length]; what lies behind the end of source is repeated from there."""
    at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    return source[np.minimum(at, len(source) - 1)] if len(at) else source[:0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix64((np.arange(1, 257, dtype=np.uint64)) * _STEP)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; n is bounded by the windows below."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def runs(offsets: np.ndarray, text: np.ndarray, breaks: np.ndarray, lower: bool = False, chars: bool = False, window: int = WINDOW_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Byte spans, 64-bit hashes and (if asked) code points of the maximal runs of bytes outside `breaks`.

    A run stays within one text. Figures for single bytes are held for one window at a time, so that
    a text of any length needs memory for its runs only; a run over windows is put together.
    """
    n = len(text)
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    power, inverse = _power(_BASE, min(n, window)), _power(_INV, min(n, window) + 1)
    found: list[tuple[np.ndarray, ...]] = []
    held: tuple[int, int, int] | None = None  # start, hash sum and code points of a run that reached its window's end
    for a in range(0, n, window):
        part = text[a : a + window]
        if lower:
            part = _LOWER[part]
        b = a + len(part)
        inside = ~breaks[part]
        cut = begins[np.searchsorted(begins, a) : np.searchsorted(begins, b)] - a
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        first[cut] = inside[cut]
        cut = cut[cut > 0] - 1
        last[cut] = inside[cut]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * power[: len(part)], dtype=np.uint64)])
        h = (sums[e] - sums[s]) * inverse[s]
        if chars:
            count = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            c = count[e] - count[s]
        else:
            c = np.zeros(len(s), np.int64)
        s, e = s + a, e + a
        if held is not None:
            at, sum_, many = held
            if len(s) and s[0] == a and not np.any(begins[np.searchsorted(begins, a) :][:1] == a):
                h[0] = (sum_ + int(h[0]) * pow(_BASE, a - at, 1 << 64)) & 0xFFFFFFFFFFFFFFFF
                s[0] = at
                c[0] += many
            else:
                s, e, h, c = np.append(at, s), np.append(a, e), np.append(np.uint64(sum_), h), np.append(many, c)
            held = None
        if len(e) and e[-1] == b and b < n:
            held = int(s[-1]), int(h[-1]), int(c[-1])
            s, e, h, c = s[:-1], e[:-1], h[:-1], c[:-1]
        found.append((s.astype(np.int32), e.astype(np.int32), mix64(h ^ ((e - s).astype(np.uint64) * _STEP)), c.astype(np.int32)))
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    out = [np.concatenate(x) for x in zip(*found)] if len(found) > 1 else list(found[0])
    return out[0], out[1], out[2], out[3] if chars else None


class Words:
    """Words of a block of texts: byte spans, document numbers and 64-bit hashes, as numpy arrays.

    text: one uint8 array; offsets: where each document starts (and the end). A word is a maximal run
    of bytes outside SPACE_BYTES within one document. Memory is about 28 bytes a word, and 40 more
    while runs of words are hashed.
    """

    def __init__(self, offsets: np.ndarray, text: np.ndarray, lower: bool = False, chars: bool = False):
        self.text, self.offsets = text, offsets
        self.start, self.end, self.hash, self.chars = runs(offsets, text, _IS_SPACE, lower, chars)
        self.doc = (np.searchsorted(offsets, self.start, "right") - 1).astype(np.int32)
        self.n_docs = len(offsets) - 1
        self.count = np.bincount(self.doc, minlength=self.n_docs)
        #: Number of a document's first word in this block; one more entry at the end.
        self.first = np.concatenate([[0], np.cumsum(self.count)]).astype(np.int64)

    def gram_hash(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within one document, and the number of each run's first word."""
        h, doc, n = self.hash, self.doc, len(self.hash)
        found = []
        for a in range(0, n - k + 1, GRAM_WINDOW):
            part = h[a : a + GRAM_WINDOW + k - 1]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _power(_BASE, len(part)), dtype=np.uint64)])
            last = min(a + GRAM_WINDOW, n - k + 1)
            at = np.flatnonzero(doc[a:last] == doc[a + k - 1 : last + k - 1])
            found.append((mix64((sums[at + k] - sums[at]) * _power(_INV, len(part))[at] ^ np.uint64(k)), (at + a).astype(np.int32)))
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int32)
        return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found))

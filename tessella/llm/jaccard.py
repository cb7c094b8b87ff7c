"""N-gram Jaccard join: a size-aware heavy-light join, and the components of its links.

A document's set holds its distinct word shingles. Two sets of sizes a and b link if they share
need(a, b) shingles. The join is exact at every step:

* Light sets (up to a boundary size that a cost model picks from the sizes' histogram) enumerate
  their subsets of the sizes that a link may need; linked light sets share such a subset.
* Heavy sets go into inverted lists. A list is kept for each part of the shingle universe and not for
  each shingle: sizes fall into classes, and a class deals its shingles into m parts, more than two
  linked sets of that class can differ in. So linked sets agree in a whole part: a list is the inverted
  list of one value of a part, and a common passage alone makes none. The least parts, of one shingle
  or none, are left out where enough others must agree. Lists of single shingles would be
  as exact, but a passage in a third of all documents would make lists of a third of all documents.
  Sets near the next class's sizes are entered there too.
* Lists with the same members are one list. A list of any length is bounded in each task: a task that
  finds many members of a list passes them on as chunks of their own, and only the chunks' hubs meet
  where the list is gathered.
* Pairs are named from lists before any text moves, after exact filters (sizes, and counts of shingles
  in hashed cells, coarse ones and then finer ones, whose distance bounds the sets' difference from
  below): all pairs of a list, or of one with many near members and of chunks those with a few hubs.
  Only sets in pairs that pass are fetched and compared in full: each set with its nearest partner
  first, then the nearest sets of two components, then the rest.
* Dense lists and chunked ones that still hold several components are compared across them, after the
  same filters. Linked heavy sets agree in two parts at least; so in a list of very many components
  only members that share a second such list are compared (those that share a shorter one are
  compared there). A pair that meets in many lists is named by the first of them.

Equal sets are one node, named by a 64-bit digest; shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import Words, byte_slices, discard, fresh, gathered, lean, mix64, parallelism, text_buffers, written

#: A list entry costs as much as so many subsets: it brings sets to compare that share a few shingles.
ENTRY_COST = 4
#: The boundary is at most this size; the histogram up to here is what the driver reads.
MOST_LIGHT = 40
#: Largest over smallest size of a class of heavy sets, or the largest ratio that can link if that is more.
CLASS_RATIO = 1.4
#: A part in so many beyond the necessary ones is left out of the lists: those with no shingle or a single one,
#: whose lists would be the longest.
SPARE = 4
#: Cells of the counts that bound a difference (a power of two: about half the set's size, within these
#: bounds), and members of a list that are compared in one task.
CELLS, MOST_CELLS, BLOCK = 64, 4096, 1024
#: Members of a list all of whose pairs are named, hubs of a longer list, and members of a chunk of one.
SHORT, HUBS, CHUNK = 8, 4, 1024
#: Pairs for each member of a list that pass the coarse filters, above which only those with hubs are named at first.
DENSE = 4
#: Members of a list in one task's entries from which on they are passed on as chunks.
MANY = 256
#: Lists of parts with more components are narrowed to members that share a second such list.
LONG_LIST = 1024
#: How pairs are taken, turn by turn: the nearest of each node, the nearest of two components, and all that are left.
TURNS = ("node", "parts", "all")
#: So many links (16 bytes each) are joined up in one task.
FEW_LINKS = 200_000
#: Up to so many documents to drop (16 bytes each) are broadcast; beyond, texts are shuffled to them.
FEW_GONE = 1_000_000
#: Pairs of two components that a block of a list names at first: the nearest ones.
NEAREST = 2
#: Pairs that a task remembers, to name each once, and members whose distances rule out pairs of a list.
SEEN, PIVOTS = 100_000, 4
#: Of each node's lists so many, the least ones, go with it: a pair that meets in one of these is left to that list.
EARLIER = 32
#: Followers of one hub in one task, about, and entries that a task gathers before it passes them on.
FOLLOWERS, FLUSH = 2000, 500_000
_LAST = (1 << 63) - 1
_A, _B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_ORDERS = mix64(np.arange(1, HUBS + 1, dtype=np.uint64))


@dataclass(frozen=True)
class Rule:
    """Shingles of `words` words; a link has intersection / union >= num / den."""

    words: int = 5
    num: int = 80
    den: int = 100

    def need(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))

    def smallest(self, b: int) -> int:
        """The least size that can link with size b."""
        return -(-self.num * b // self.den)

    def subset_sizes(self, s: int, boundary: int) -> list[int]:
        sizes = {self.need(s, t) for t in range(self.smallest(s), boundary + 1) if self.need(s, t) <= min(s, t)}
        return sorted(sizes)

    def parts(self, largest: int) -> tuple[int, int]:
        """(parts, spare): sets of at most this size that link agree in two parts, of all but the `spare` least parts of each.

        They agree in spare + 2 parts at least. Ranked by size and then by content, the two greatest of
        these are above `spare` others in both sets, so neither set leaves them out.
        """
        differ = 2 * largest - 2 * self.need(largest, largest)
        spare = 1 + differ // SPARE
        return differ + 2 + spare, spare

    def classes(self, boundary: int, largest: int) -> list[tuple[int, int, int, int]]:
        out, low = [], boundary + 1
        while low <= largest:
            high = max(low, int(low * max(CLASS_RATIO, self.den / self.num)))
            out.append((low, high, *self.parts(high)))
            low = high + 1
        return out

    def boundary(self, histogram: dict[int, int]) -> int:
        """The size up to which enumerating subsets is cheaper than list entries, over all sets."""
        best, at, saved = 0, 0, 0
        for s in range(1, MOST_LIGHT + 1):
            subsets = sum(comb(s, c) for c in self.subset_sizes(s, s))
            entries = 2 * self.parts(s)[0]
            saved += histogram.get(s, 0) * (ENTRY_COST * entries - subsets)
            if saved > best or s <= 2:
                best, at = max(saved, best), s
        return at


def _most(rule: Rule, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """In how many shingles sets of these sizes may differ if they link."""
    return n + m - 2 * -(-rule.num * (n + m) // (rule.num + rule.den))


def shingle_sets(offsets: np.ndarray, text: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and hashes of all distinct shingles of a block, sorted by both."""
    w = Words(offsets, text, lower=True)
    h, at = w.gram_hash(words)
    hs, ds = [h], [w.doc[at]]
    for k in range(1, words):  # texts with fewer words: the whole sequence
        short = w.count == k
        if short.any():
            h, at = w.gram_hash(k)
            mine = short[w.doc[at]]
            hs.append(mix64(h[mine] ^ _A))
            ds.append(w.doc[at][mine])
    h, d = np.concatenate(hs), np.concatenate(ds).astype(np.int32)
    order = np.argsort(h)
    order = order[np.argsort(d[order], kind="stable")]
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new].astype(np.int64), h[new]


def _sum64(slot: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit digest of the values of each slot, whatever their order."""
    low = np.bincount(slot, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    high = np.bincount(slot, (value >> np.uint64(32)).astype(np.float64), n)
    return mix64(low.astype(np.uint64) + mix64(high.astype(np.uint64) + _A))


def nodes(d: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes and the digests that name the sets."""
    size = np.bincount(d, minlength=n)
    return size, _sum64(d, mix64(h ^ _B), n) ^ mix64(size.astype(np.uint64))


def signatures(rule: Rule, boundary: int, classes: list[tuple[int, int, int, int]], d: np.ndarray, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of all subsets and list entries of a block's sets."""
    docs, keys = [], []
    g = mix64(h)
    first = np.concatenate([[0], np.cumsum(size)])
    for i in np.flatnonzero((size > 0) & (size <= boundary)).tolist():
        mine = g[first[i] : first[i + 1]].tolist()
        total = sum(mine)
        own = []
        for c in rule.subset_sizes(len(mine), boundary):
            own += [((total - sum(out)) * 31 + c) & 0xFFFFFFFFFFFFFFFF for out in combinations(mine, len(mine) - c)]
        docs.append(np.full(len(own), i))
        keys.append(mix64(np.array(own, np.uint64)) & ~np.uint64(1))  # even: of subsets
    if classes:
        lows = np.array([c[0] for c in classes])
        many, spare = np.array([c[2] for c in classes]), np.array([c[3] for c in classes])
        own = np.searchsorted(lows, size, "right") - 1
        reach = np.array([rule.smallest(int(x)) for x in lows])
        for cls in (own, own + 1):
            ok = (cls >= 0) & (cls < len(classes)) & (size > 0)
            ok[ok] &= size[ok] >= reach[cls[ok]]
            pick = np.flatnonzero(ok)
            if not len(pick):
                continue
            m = many[cls[pick]]
            base = np.cumsum(m) - m
            row = np.full(len(size), -1)
            row[pick] = np.arange(len(pick))
            here = row[d]
            token = here >= 0
            at = here[token]
            part = (mix64(h[token] ^ _A) % m[at].astype(np.uint64)).astype(np.int64)
            slots = int(m.sum())
            slot = base[at] + part
            owner = np.repeat(np.arange(len(pick)), m)
            held = np.bincount(slot, minlength=slots)
            number = np.arange(slots) - base[owner]
            key = mix64(_sum64(slot, g[token], slots) ^ mix64((cls[pick][owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64) + np.uint64(1)))
            order = np.lexsort((key, held, owner))
            keep = order[number >= spare[cls[pick]][owner]]  # owners stay in their places
            docs.append(pick[owner[keep]])
            keys.append(key[keep] | np.uint64(1))  # odd: of parts
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(keys)


def cell_counts(d: np.ndarray, h: np.ndarray, size: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each set by hashed cells, about `each` of them to a cell: all counts, and the cells of each set."""
    width = np.clip(1 << np.ceil(np.log2(np.maximum(size, each) / each)).astype(np.int64), CELLS, MOST_CELLS)
    base = np.cumsum(width) - width
    cell = base[d] + (mix64(h ^ _B) & (width[d] - 1).astype(np.uint64)).astype(np.int64)
    return np.bincount(cell, minlength=int(width.sum())), width


def _cut(raw: bytes, width: np.ndarray) -> list[bytes]:
    at = np.concatenate([[0], np.cumsum(width)]).tolist()
    return [raw[x:y] for x, y in zip(at[:-1], at[1:])]


def _folded(raw: list[bytes], w: int) -> np.ndarray:
    """Coarse counts of sets (two to a byte), summed up to w cells."""
    out = np.zeros((len(raw), w), np.int16)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        packed = np.frombuffer(b"".join([raw[i] for i in at.tolist()]), np.uint8).reshape(len(at), n)
        both = np.concatenate([packed & 15, packed >> 4], axis=1)  # cell c is in byte c % n
        out[at] = both.reshape(len(at), -1, w).sum(1, dtype=np.int16) if 2 * n > w else both
    return out


def _describe(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(2)):
                part = batch.slice(a, b - a)
                d, h = shingle_sets(*text_buffers(part.column(2)), rule.words)
                size, node = nodes(d, h, b - a)
                coarse, width = cell_counts(d, h, size, 4)
                coarse, half = np.minimum(coarse, 15).astype(np.uint8), width // 2
                at = np.repeat(np.cumsum(width) - width, half) + np.arange(int(half.sum())) - np.repeat(np.cumsum(half) - half, half)
                packed = _cut((coarse[at] | (coarse[at + np.repeat(half, half)] << 4)).tobytes(), half)
                fine, width = cell_counts(d, h, size, 2)
                fine = _cut(np.minimum(fine, 255).astype(np.uint8).tobytes(), width)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size), pa.array(node.view(np.int64), mask=size == 0), *[pa.array(x, pa.binary()) for x in (packed, fine)]], names=["id", "text_hash", "n_shingles", "node", "coarse", "cells"])

    return run


def hubs(node: np.ndarray) -> np.ndarray:
    """The places of the members that are first in each of HUBS orders, which are the same for all lists."""
    return np.array([int(np.argmin(mix64(node ^ _ORDERS[t]))) for t in range(HUBS)])


def _short(key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Keys of 40 bits, odd ones of parts, below the number of their bucket: keys that fall together make one list of two."""
    return (bucket.astype(np.uint64) << np.uint64(40)) | ((key >> np.uint64(24)) & ~np.uint64(1)) | (key & np.uint64(1))


def _entries(rule: Rule, boundary: int, classes: list, buckets: int):
    """Entries (key, node), by bucket: arrays of keys, nodes and entries for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies enter once from each task
        held, size_held = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size_held
            node, key = (np.concatenate(x) for x in zip(*held))
            held, size_held = [], 0
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            key = _short(key, bucket)
            # Lists with many members here: these go on as chunks to any task, and their hubs to the list's own.
            order = np.argsort(key, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
            count = np.diff(np.append(edge, len(key)))
            stay, chunks = np.ones(len(key), bool), []
            for a, n in zip(edge[count >= MANY].tolist(), count[count >= MANY].tolist()):
                stay[order[a : a + n]] = False
                for c in range(a, a + n, CHUNK):
                    mine = order[c : min(c + CHUNK, a + n)]
                    stay[mine[hubs(node[mine])]] = True
                    chunks.append((len(chunks) % buckets, key[mine[:1]].tobytes(), node[mine].tobytes(), b""))
            bucket, node, key = bucket[stay], node[stay], key[stay]
            order = np.argsort(bucket, kind="stable")
            bucket, node, key = bucket[order], node[order], key[order]
            edge = np.ones(len(node), bool)
            edge[1:] = (node[1:] != node[:-1]) | (bucket[1:] != bucket[:-1])
            at = np.flatnonzero(edge)
            runs = np.diff(np.append(at, len(node))).astype(np.uint32)
            which, start = np.unique(bucket, return_index=True)
            end = np.append(start[1:], len(bucket))
            lo = np.searchsorted(at, start)
            hi = np.searchsorted(at, end)
            low, high = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), ((key >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8)
            rows = chunks + [(w, low[a:b].tobytes() + high[a:b].tobytes(), node[at[c:e]].tobytes(), runs[c:e].tobytes()) for w, a, b, c, e in zip(which.tolist(), start, end, lo, hi)]
            first, *rest = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), *[pa.array(c, pa.binary()) for c in rest]], names=["bucket", "keys", "nodes", "runs"])

        for batch in batches:
            for a, b in byte_slices(batch.column(0)):
                d, h = shingle_sets(*text_buffers(batch.column(0).slice(a, b - a)), rule.words)
                size, node = nodes(d, h, b - a)
                fresh = np.zeros(b - a, bool)
                for i, x in enumerate(node.tolist()):
                    if size[i] and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                if len(seen) > 200_000:
                    seen.clear()
                mine = fresh[d]
                doc, key = signatures(rule, boundary, classes, d[mine], h[mine], np.where(fresh, size, 0))
                if len(doc):
                    held.append((node[doc], key))
                    size_held += len(doc)
                if size_held >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists with two nodes or more, from all entries of a bucket: list, nodes, whole.

    A list of at most CHUNK members is named by its members, so that equal lists are found; a longer one
    comes in chunks that are named by its key, with one more chunk of their hubs.
    """
    show = lambda lists, offsets, flat, whole: pa.RecordBatch.from_arrays([pa.array(lists.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64))), pa.array(np.full(len(lists), whole))], names=["list", "nodes", "whole"])
    keys, members = [], []
    for batch in batches:
        for b, k, n, r in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if not r:
                flat = np.frombuffer(n, np.uint64)
                yield show(np.frombuffer(k, np.uint64), np.array([0, len(flat)]), flat, False)
                continue
            size = len(k) // 5
            key = np.frombuffer(k, np.uint32, size).astype(np.uint64) | (np.frombuffer(k, np.uint8, size, 4 * size).astype(np.uint64) << np.uint64(32))
            keys.append(key | np.uint64(b << 40))
            members.append(np.repeat(np.frombuffer(n, np.uint64), np.frombuffer(r, np.uint32)))
    if not keys:
        return
    key, node = np.concatenate(keys), np.concatenate(members)
    del keys, members
    order = np.argsort(key)
    key, node = key[order], node[order]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= key[1:] == key[:-1]
    key, node = key[same], node[same]
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    if not len(key):
        return
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(at, len(key)))
    name = mix64(np.add.reduceat(mix64(node ^ _A), at) ^ count.astype(np.uint64))
    for a, n in zip(at[count > CHUNK].tolist(), count[count > CHUNK].tolist()):
        first = []
        for c in range(a, a + n, CHUNK):
            mine = node[c : min(c + CHUNK, a + n)]
            first.append(mine[np.unique(hubs(mine))])
            yield show(key[a : a + 1], np.array([0, len(mine)]), mine, False)
        mine = np.concatenate(first)
        yield show(key[a : a + 1], np.array([0, len(mine)]), mine, False)
    _, pick = np.unique(name, return_index=True)
    pick = pick[(count[pick] > 1) & (count[pick] <= CHUNK)]
    for i in range(0, len(pick), 20_000):
        part = pick[i : i + 20_000]
        yield show(name[part], np.concatenate([[0], np.cumsum(count[part])]), gathered(node, at[part], count[part]), True)


def _named(rule: Rule, dense: int | None):
    """Pairs (hub, node) from the members of lists (row, whole, list, node, n, coarse), sorted by row.

    All pairs of a list that pass the filters on sizes and coarse cells, if they are at most `dense` for
    each member; else, and of chunks, those of the members with its hubs, and the list is named as open
    (list, null).
    """

    def passing(n: np.ndarray, cells: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(i), bool)
        step = max(1, (4 << 20) // cells.shape[1])
        for k in range(0, len(i), step):
            x, y = i[k : k + step], j[k : k + step]
            most = _most(rule, n[x], n[y])
            at = np.flatnonzero(np.abs(n[x] - n[y]) <= most)
            ok[k + at] = np.abs(cells[x[at]] - cells[y[at]]).sum(1, dtype=np.int32) <= most[at]
        return ok

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        row, whole, list_, node, n = (rows.column(k).to_numpy() for k in range(5))
        coarse = rows.column(5).to_pylist()
        edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        size = np.diff(np.append(edge, len(row)))
        # A list is judged in as many cells as all of its sets have; short lists of one kind together.
        width = 2 * np.minimum.reduceat(np.fromiter(map(len, coarse), np.int64, len(coarse)), edge)
        x, y, open_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        short = (size > 1) & (size <= SHORT) & whole[edge]
        for g, w in set(zip(size[short].tolist(), width[short].tolist())):
            begin = edge[short & (size == g) & (width == w)]
            at = (begin[:, None] + np.arange(g)).ravel()
            i, j = (np.repeat(np.arange(len(begin)) * g, g * (g - 1) // 2) + np.tile(t, len(begin)) for t in np.triu_indices(g, 1))
            ok = passing(n[at], _folded([coarse[t] for t in at.tolist()], w), i, j)
            x.append(at[i[ok]])
            y.append(at[j[ok]])
        for a, g, w in zip(edge[~short].tolist(), size[~short].tolist(), width[~short].tolist()):
            few, found, mine = whole[a], [], slice(a, a + g)
            cells = _folded(coarse[mine], w)
            for k in range(0, g, 64):
                if not few:
                    break
                i, j = np.nonzero(np.arange(k, min(k + 64, g))[:, None] < np.arange(k, g)[None, :])
                ok = passing(n[mine], cells, i + k, j + k)
                found.append(np.stack([i[ok] + k, j[ok] + k]))
                few = dense is None or sum(f.shape[1] for f in found) <= dense * g
            if few:
                i, j = np.concatenate(found, axis=1)
            else:
                open_.append(list_[a])
                h = np.unique(hubs(node[mine].view(np.uint64)))
                i, j = np.repeat(h, g), np.tile(np.arange(g), len(h))
                ok = passing(n[mine], cells, i, j)
                i, j = i[ok], j[ok]
            x.append(i + a)
            y.append(j + a)
        x, y = (node[np.concatenate(z)].view(np.uint64) for z in (x, y))
        swap = mix64(x ^ _ORDERS[0]) > mix64(y ^ _ORDERS[0])
        x, y = np.where(swap, y, x)[x != y], np.where(swap, x, y)[x != y]
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        hub = np.concatenate([x[new].view(np.int64), np.array(open_, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(hub), pa.concat_arrays([pa.array(y[new].view(np.int64)), pa.nulls(len(open_), pa.int64())])], names=["hub", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 10_000):
                held.append(batch.slice(k, 10_000))
                count += held[-1].num_rows
                if count < 10_000:
                    continue
                table = pa.Table.from_batches(held)
                row = table.column(0).to_numpy()
                cut = int(np.searchsorted(row, row[-1]))
                if cut:
                    yield pairs(table.slice(0, cut))
                held, count = table.slice(cut).to_batches(), 0
        if held:
            yield pairs(pa.Table.from_batches(held))

    return run


def _fetch(rule: Rule):
    """Shingles of sets (node, text); a task gives each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh_ = []
            for i, x in enumerate(batch.column(0).to_pylist()):
                if x not in seen:
                    seen.add(x)
                    fresh_.append(i)
            if len(seen) > 200_000:
                seen.clear()
            rows = batch.take(pa.array(fresh_, pa.int64()))
            for a, b in byte_slices(rows.column(1)):
                part = rows.slice(a, b - a)
                d, h = shingle_sets(*text_buffers(part.column(1)), rule.words)
                size = np.bincount(d, minlength=b - a)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["node", "shingles"])

    return run


def _compare(rule: Rule):
    """Links between a hub and its followers, from rows sorted by hub and salt with the hub's own set first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            lists = batch.column(3)
            at = np.asarray(lists.offsets)
            flat = np.asarray(lists.values).view(np.uint64)
            out = []
            for i, (h, node, self_) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)))):
                mine = flat[at[i] : at[i + 1]]
                if self_:
                    hub, own = h, mine.copy()
                    continue
                if hub != h:
                    raise ValueError("a follower came without its hub")
                both = len(own) + len(mine)
                if rule.need(len(own), len(mine)) > min(len(own), len(mine)):
                    continue
                place = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                shared = int((own[place] == mine).sum())
                if rule.den * shared >= rule.num * (both - shared):
                    out.append((h, node))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return run


def _links(rule: Rule, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (hub, node) that link, verified on whole sets; pairs is a written table. Hubs with many followers are salted."""
    salts = F.ceil(F.count("*") / F.lit(FOLLOWERS)).cast("int")
    hubs = pairs.groupBy("hub").agg(salts.alias("salts"))
    mine = sets.select("node", "shingles")
    followers = pairs.join(hubs, "hub").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).select("hub", "salt", "node").join(mine, "node")
    selves = hubs.join(mine, F.col("hub") == F.col("node")).drop("node").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    rows = followers.select("hub", "node", F.lit(False).alias("self"), "shingles", "salt").unionByName(selves.select("hub", F.col("hub").alias("node"), F.lit(True).alias("self"), "shingles", "salt"))
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("self").desc())
    return rows.select("hub", "node", "self", "shingles").mapInArrow(lean(_compare(rule)), "a long, b long")


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest node that each node of at most FEW_LINKS links leads to."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = top(a), top(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([top(x) for x in parent], pa.int64())], names=["a", "to"])


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of links (a, b).

    Each turn every node takes the smallest of itself and its neighbours, and links are drawn again
    between what they took; nodes at least halve, so turns grow with the logarithm of the longest
    path. Once FEW_LINKS or fewer are left, one task ends the work.
    """
    links = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels, old = None, None
    while True:
        few = links.count() <= FEW_LINKS
        if few:
            step = links.coalesce(1).mapInArrow(lean(_union), "a long, to long")
        else:
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            step = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "step")
        if labels is None:
            labels = step.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            labels = labels.join(step.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = written(labels, "labels")
        discard(old)
        old = labels
        if few:
            discard(links)
            return labels
        before = links
        links = links.join(step, "a").select(F.col("to").alias("a"), "b")
        links = links.join(step.withColumnRenamed("a", "b").withColumnRenamed("to", "to_b"), "b").select("a", F.col("to_b").alias("b"))
        links = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        discard(before, step)


def _coarse(raw: list[bytes]) -> np.ndarray:
    """Counts of each set in CELLS cells."""
    out = np.zeros((len(raw), CELLS), np.int32)
    width = np.fromiter(map(len, raw), np.int64, len(raw))
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join([raw[i] for i in at.tolist()]), np.uint8).reshape(len(at), -1, CELLS).sum(1, dtype=np.int32)
    return out


def _apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Lower bounds of the differences of pairs of sets, in as many cells as both have."""
    out = np.zeros(len(a), np.int64)
    width = np.array([(len(x), len(y)) for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    for v, w in np.unique(width, axis=0).tolist():
        every, least = np.flatnonzero((width[:, 0] == v) & (width[:, 1] == w)), min(v, w)
        for k in range(0, len(every), max(1, (4 << 20) // max(v, w))):
            at = every[k : k + max(1, (4 << 20) // max(v, w))]
            fold = lambda raw, n: np.frombuffer(b"".join([raw[i] for i in at.tolist()]), np.uint8).reshape(len(at), n // least, least).sum(1, dtype=np.int32)  # noqa: E731, B023
            out[at] = np.abs(fold(a, v) - fold(b, w)).sum(1)
    return out


def _near_enough(rule: Rule):
    """Pairs (hub, node) that may link, by sizes and cells, with their least difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            most = _most(rule, n, m)
            at = np.flatnonzero(np.abs(n - m) <= most)
            part = batch.take(pa.array(at))
            far = _apart(part.column(4).to_pylist(), part.column(5).to_pylist())
            ok = far <= most[at]
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), part.column(1).filter(pa.array(ok)), pa.array(far[ok])], names=["hub", "node", "far"])

    return run


def _across(rule: Rule, nearest: int | None):
    """Pairs of members of one list block in different components that pass the filters, from rows sorted by block.

    Of the lists that two members share, the first one names them; rows have the list's members' earlier lists, or some of
    them, so that few pairs are named by another list as well. The filters say the same of a pair in each of its lists.
    At most `nearest` of any two components (by coarse cells), or all of them.

    What can't link is ruled out for all pairs of a block at once: by component, by size, and by the
    distances of both members to a few pivots, whose difference bounds their own distance from below.
    """

    seen: set[tuple[int, int]] = set()  # pairs meet in many lists; a task names each once

    def elsewhere(lists: np.ndarray, count: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs meet in an earlier list: at least in the first of all that both are in, they don't."""
        met = np.zeros(len(i), bool)
        for c in range(int(count[i].max(initial=0))):
            at = np.flatnonzero(~met & (count[i] > c))
            met[at] = (lists[i[at], c][:, None] == lists[j[at]]).any(1)
        return met

    def passing(node: np.ndarray, n: np.ndarray, raw: list[bytes], i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(i), 50_000):
            x, y = i[k : k + 50_000], j[k : k + 50_000]
            a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
            fresh_ = []
            for q, pair in enumerate(zip(a.tolist(), b.tolist())):
                if pair not in seen:
                    seen.add(pair)
                    fresh_.append(q)
            if len(seen) > SEEN:
                seen.clear()
            x, y, a, b = x[fresh_], y[fresh_], a[fresh_], b[fresh_]
            far = _apart([raw[q] for q in x.tolist()], [raw[q] for q in y.tolist()])
            ok = far <= _most(rule, n[x], n[y])
            yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in (a, b, far)], names=["hub", "node", "far"])

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        block, low, high, chunk, node, comp, n = (rows.column(k).to_numpy() for k in range(7))
        raw = rows.column(7).to_pylist()
        coarse = _coarse(raw)
        count = pc.list_value_length(rows.column(8)).to_numpy()
        lists = np.repeat(block[:, None], max(1, int(count.max(initial=0))), axis=1)  # filled up with the row's own list, which is no earlier one
        lists[np.arange(lists.shape[1]) < count[:, None]] = pc.list_flatten(rows.column(8)).to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        for a, g in zip(edge.tolist(), np.diff(np.append(edge, len(block))).tolist()):
            own = slice(a, a + g)
            left, right = (np.arange(a, a + g),) * 2 if low[a] == high[a] else (a + np.flatnonzero(chunk[own] == low[a]), a + np.flatnonzero(chunk[own] == high[a]))
            _, first = np.unique(comp[own], return_index=True)
            pivots = a + first[:PIVOTS]
            to = np.abs(coarse[own][:, None, :] - coarse[pivots][None, :, :]).sum(2, dtype=np.int32) if g > 2 * PIVOTS else np.zeros((g, 1), np.int32)
            for k in range(0, len(left), 256):
                i = left[k : k + 256]
                most = _most(rule, n[i][:, None], n[right][None, :])
                ok = (comp[i][:, None] != comp[right][None, :]) & (np.abs(n[i][:, None] - n[right][None, :]) <= most)
                if low[a] == high[a]:
                    ok &= i[:, None] < right[None, :]
                for p in range(to.shape[1]):
                    ok &= np.abs(to[i - a, p][:, None] - to[right - a, p][None, :]) <= most
                x, y = np.nonzero(ok)
                x, y = i[x], right[y]
                for q in range(0, len(x), 50_000):
                    u, v = x[q : q + 50_000], y[q : q + 50_000]
                    gap = np.abs(coarse[u] - coarse[v]).sum(1)
                    near = gap <= _most(rule, n[u], n[v])
                    u, v, gap = u[near], v[near], gap[near]
                    first = ~elsewhere(lists, count, u, v)
                    u, v, gap = u[first], v[first], gap[first]
                    if nearest is not None and len(u):
                        p, r = np.minimum(comp[u], comp[v]), np.maximum(comp[u], comp[v])
                        order = np.lexsort((gap, r, p))
                        first = np.concatenate([[True], (p[order[1:]] != p[order[:-1]]) | (r[order[1:]] != r[order[:-1]])])
                        at = np.flatnonzero(first)
                        place = np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order))))
                        u, v = u[order[place < nearest]], v[order[place < nearest]]
                    yield from passing(node, n, raw, u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 10_000):
                held.append(batch.slice(k, 10_000))
                count += held[-1].num_rows
                if count < 10_000:
                    continue
                table = pa.Table.from_batches(held)
                key = [table.column(c).to_numpy() for c in range(3)]
                last = np.ones(len(key[0]), bool)
                for c in key:
                    last &= c == c[-1]
                cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
                if cut:
                    yield from pairs(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                count = 0
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def _placed(rows: DataFrame, found: DataFrame, node: str, component: str) -> DataFrame:
    """rows with the component of a node; a node without links is its own."""
    named = found.select(F.col("node").alias(node), F.col("component").alias(component))
    return rows.join(named, node, "left").withColumn(component, F.coalesce(component, node))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """found, with what further links join: only components are looked at again. Discards found."""
    ends = _placed(_placed(links, found, "a", "x"), found, "b", "y")
    between = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    moved = found.join(between.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    new = between.join(found.select("node"), "node", "left_anti")
    out = written(moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(new), "found")
    discard(found, between)
    return out


def _filtered(rule: Rule, pairs: DataFrame, figures: DataFrame) -> DataFrame:
    """The distinct pairs (hub, node) that may link, with `far`; a written table."""
    mine = figures.select("node", "n", "cells")
    hubs_ = mine.toDF("hub", "hub_n", "hub_cells")
    rows = pairs.distinct().join(mine, "node").join(hubs_, "hub").select("hub", "node", "hub_n", "n", "hub_cells", "cells")
    return written(rows.mapInArrow(lean(_near_enough(rule)), "hub long, node long, far long"), "near-pairs")


def _settle(rule: Rule, pairs: DataFrame, found: DataFrame | None, fetch) -> DataFrame:
    """found, with what the links among pairs (hub, node, far) join. Pairs within a component needn't be compared."""
    sets = fetch(pairs.select("hub").union(pairs.select("node")).toDF("node"))
    tried: list[DataFrame] = []
    for how in TURNS:
        left = pairs if found is None else _placed(_placed(pairs, found, "node", "x"), found, "hub", "y").filter("x <> y")
        for past in tried:
            left = left.join(past, ["hub", "node"], "left_anti")
        if how == "node":
            left = left.groupBy("node").agg(F.min_by("hub", F.struct("far", "hub")).alias("hub"))
        elif how == "parts":
            left = left.groupBy(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).agg(F.min(F.struct("far", "hub", "node")).alias("b")).select("b.hub", "b.node")
        tried.append(written(left.select("hub", "node"), "tries"))
        if found is not None and tried[-1].isEmpty():
            break
        linked = _links(rule, tried[-1], sets)
        found = components(linked) if found is None else _joined(found, linked)
    discard(sets, *tried)
    return found


def _members(once: DataFrame, figures: DataFrame) -> DataFrame:
    """The members of lists with their sizes and coarse cells, sorted by list (or chunk of one)."""
    row = F.when(F.col("whole"), F.col("list")).otherwise(F.xxhash64("list", F.get("nodes", F.lit(0))))
    members = once.select(row.alias("row"), "whole", "list", F.explode("nodes").alias("node")).join(figures.select("node", "n", "coarse"), "node")
    return members.select("row", "whole", "list", "node", "n", "coarse").repartition("row").sortWithinPartitions("row")


def _between(rule: Rule, placed: DataFrame, figures: DataFrame, block: int, nearest: int | None = None) -> DataFrame | None:
    """Pairs (hub, node, far) of members in different components that pass the filters, from lists (list, node, component).

    All such pairs, or in each block of a list the nearest of any two components.
    """
    spans = placed.groupBy("list").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members"), F.approx_count_distinct("component").alias("parts")).filter("x <> y").select("list", "members", "parts")
    spans = written(spans, "spans")  # a table of its own, so that Spark may split a list's many members when it joins them
    open_ = written(placed.join(F.broadcast(spans) if spans.count() <= FEW_GONE else spans, "list"), "open-lists")
    discard(spans)
    if open_.isEmpty():
        discard(open_)
        return None
    long = (F.col("parts") > LONG_LIST) & (F.pmod(F.col("list"), F.lit(2)) == 1) & (F.col("members") > CHUNK)
    narrow = open_.filter(~long).select("list", "node", "component", "members")
    if not open_.filter(long).isEmpty():
        first, second = open_.filter(long).select("list", "node", "component"), open_.filter(long).select("node", F.col("list").alias("second"))
        twice = first.join(second, "node").filter("list < second")
        twice = twice.select(F.xxhash64("list", "second").alias("list"), "node", "component")
        both = twice.groupBy("list").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members")).filter("x <> y").select("list", "members")
        narrow = narrow.unionByName(twice.join(both, "list").select("list", "node", "component", "members"))
    least = narrow.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("list")), 1, EARLIER).alias("least"))
    mine = figures.select("node", "n", "cells").join(least, "node")
    chunks = F.ceil(F.col("members") / F.lit(block)).cast("int")
    spread = narrow.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    spread = spread.select("list", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "node", "component").join(mine, "node")
    earlier = F.filter("least", lambda x: x < F.col("list")).alias("earlier")
    spread = spread.select("list", "low", "high", "chunk", "node", "component", "n", "cells", earlier).repartition("list", "low", "high").sortWithinPartitions("list", "low", "high")
    more = written(spread.mapInArrow(lean(_across(rule, nearest)), "hub long, node long, far long").distinct(), "across")
    discard(open_)
    return more


def _grow(rule: Rule, once: DataFrame, figures: DataFrame, fetch, block: int) -> DataFrame:
    """node, component of all nodes with links, from the lists (list, nodes, whole)."""
    named = written(_members(once, figures).mapInArrow(lean(_named(rule, DENSE)), "hub long, node long").distinct(), "named")
    pairs = _filtered(rule, named.filter("node IS NOT NULL"), figures)
    found = _settle(rule, pairs, None, fetch)
    dense = named.filter("node IS NULL").select(F.col("hub").alias("list"))
    longer = written(once.join(dense, "list", "left_semi").select("list", F.explode("nodes").alias("node")).distinct(), "open-lists")
    tried = [pairs]
    for nearest in (NEAREST, None):  # what the nearest pairs join needn't be compared any more
        placed = written(_placed(longer, found, "node", "component"), "placed")
        more = _between(rule, placed, figures, block, nearest)
        discard(placed)
        if more is None:
            break
        left = more
        for past in tried:
            left = left.join(past.select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node")), ["hub", "node"], "left_anti")
        tried.append(written(left, "new-pairs"))
        discard(more)
        if not tried[-1].isEmpty():
            found = _settle(rule, tried[-1], found, fetch)
    discard(named, longer, *tried)
    return found


def _listed(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> tuple:
    """(documents with their nodes, lists, what is known of the nodes in lists, a function that fetches sets)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    every = written(rows.select("id", "text_hash", "text").mapInArrow(lean(_describe(rule)), "id long, text_hash long, n_shingles long, node long, coarse binary, cells binary"), "sets")
    totals = every.agg(F.max("n_shingles").alias("largest"), F.sum("n_shingles").alias("all")).first()
    few = every.filter(F.col("n_shingles").between(1, MOST_LIGHT)).groupBy("n_shingles").count().collect()  # at most MOST_LIGHT rows
    boundary = rule.boundary({r["n_shingles"]: r["count"] for r in few})
    classes = rule.classes(boundary, totals["largest"] or 0)
    buckets = max(parallelism(spark), (totals["all"] or 0) // 5_000_000 + 1)
    entries = rows.select("text").mapInArrow(lean(_entries(rule, boundary, classes, buckets)), "bucket int, keys binary, nodes binary, runs binary")
    lists = entries.repartitionById(buckets, F.col("bucket")).mapInArrow(lean(_lists), "list long, nodes array<long>, whole boolean")
    lists = written(lists, "lists")
    once = lists.filter("whole").groupBy("list").agg(F.first("nodes").alias("nodes"))
    once = written(once.withColumn("whole", F.lit(True)).unionByName(lists.filter("NOT whole")), "distinct-lists")
    discard(lists)
    # What is known of each node that a list names: its size, its cells, and one document that has it.
    listed = once.select(F.explode("nodes").alias("node")).distinct()
    known = every.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "text_hash", F.col("n_shingles").alias("n"), "coarse", "cells")).alias("k")).select("node", "k.*")
    figures = written(known.join(listed, "node", "left_semi"), "figures")

    def fetch(wanted: DataFrame) -> DataFrame:
        """node, shingles of the wanted nodes, from the text of one document each; a written table."""
        place = written(wanted.distinct().join(figures.select("node", "id", "text_hash"), "node"), "wanted")
        texts = rows.join(F.broadcast(place) if place.count() <= FEW_GONE else place, ["id", "text_hash"]).select("node", "text")
        sets = written(texts.mapInArrow(lean(_fetch(rule)), "node long, shingles array<long>").dropDuplicates(["node"]), "shingles")
        discard(place)
        return sets

    return every, once, figures, fetch


def _grouped(docs: DataFrame, rule: Rule, id_col: str, text_col: str, block: int) -> DataFrame:
    """id (null as the largest), text_hash, n_shingles, component (null without words); a written table."""
    every, once, figures, fetch = _listed(docs, rule, id_col, text_col)
    found = _grow(rule, once, figures, fetch, block)
    discard(once, figures)
    grouped = every.join(found, "node", "left").select("id", "text_hash", "n_shingles", F.coalesce("component", "node").alias("component"))
    grouped = written(grouped, "grouped")
    discard(every, found)
    return grouped


def similar_pairs(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The join itself: all links (a, b with a < b) between different sets, and doc_id, n_shingles, node of each document.

    Sets are named by their nodes; documents of one node are copies of each other and link without
    further ado. Every link is verified on whole sets. A family of n near copies has up to n * n / 2
    links, and the join's cost is at least their number; near_groups() has no such cost.
    """
    every, once, figures, fetch = _listed(docs, rule, id_col, text_col)
    named = written(_members(once, figures).mapInArrow(lean(_named(rule, None)), "hub long, node long").distinct(), "named")
    chunked = once.filter("NOT whole").select("list", F.explode("nodes").alias("node")).distinct().withColumn("component", F.col("node"))
    more = _between(rule, chunked, figures, block)
    pairs = _filtered(rule, named.filter("node IS NOT NULL"), figures).select("hub", "node")
    pairs = pairs if more is None else pairs.unionByName(more.select("hub", "node"))
    pairs = written(pairs.select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node")).distinct(), "pairs")
    sets = fetch(pairs.select("hub").union(pairs.select("node")).toDF("node"))
    links = written(_links(rule, pairs, sets), "all-links")
    discard(once, named, more, figures, pairs, sets)
    back = F.when(F.col("id") != _LAST, F.col("id")).alias("doc_id")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), every.select(back, "n_shingles", "node")


def _with_least(grouped: DataFrame) -> DataFrame:
    """grouped with the smallest id of each component as `least`; sets that nothing repeats have their own id."""
    least = grouped.filter("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    least = written(least, "least")  # a table of its own, so that Spark may split a component's many rows when it joins them
    least = F.broadcast(least) if least.count() <= FEW_GONE else least
    return grouped.join(least, "component", "left").withColumn("least", F.coalesce("least", "id"))


def near_groups(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (and text_hash, of the text).

    Words end at [\\x20\\x09-\\x0D] and A-Z are lower-cased. component_id is the smallest doc_id that
    links lead to; equal sets link. A text without words (null, empty, blank) has size 0 and links
    with nothing. A null doc_id counts as the largest. Repeated rows are equal sets. An empty table
    gives no rows. Other columns are not read.
    """
    out = _with_least(_grouped(docs, rule, id_col, text_col, block))
    back = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return out.select(back("id").alias("doc_id"), "n_shingles", back("least").alias("component_id"), "text_hash")


def keep_one(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those whose group has a smaller id; groups are components of links.

    Texts without words all stay. Of rows that repeat the smallest id with one text, all stay. The
    columns of docs stay as they are, whatever their names.
    """
    grouped = _grouped(docs, rule, id_col, text_col, BLOCK)
    id_, hashed = fresh(docs, "id", "hash")
    gone = _with_least(grouped).filter("least < id").select(F.col("id").alias(id_), F.col("text_hash").alias(hashed))
    gone = written(gone.distinct(), "gone")
    discard(grouped)
    known = docs.withColumns({id_: F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), hashed: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    return known.join(F.broadcast(gone) if gone.count() <= FEW_GONE else gone, [id_, hashed], "left_anti").select(*docs.columns)

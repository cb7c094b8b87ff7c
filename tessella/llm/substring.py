"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix is a word position; a repeat is a node of the suffix tree that is at least `window` words
deep and has suffixes of several documents below it. Trees are built by groups of suffixes:

* Each window of `window` words has a key, the least hash of the `anchor`-word runs in it. Equal
  windows have equal keys, and neighbouring windows mostly share theirs, so that a run of suffixes
  with one key travels as one segment of text.
* Keys found in one document only are leaves and are dropped before any text moves.
* Segments are grouped by key, if a task can hold the group: groups are bounded by their words. A larger
  group gets a longer prefix, at once all `window` words, whose group is a leaf of the tree: its suffixes
  are rows of two numbers, and their least id is combined before the shuffle, so that no group of any
  size meets in one task.
* In a task, the tree of each group is built from the root down: classes of suffixes with equal
  prefixes of 1, 2, 4, ... and at last `window` words, where classes within one document are dropped
  at every depth. What remains are the deep internal nodes.

Whole copies of a document are settled first, by their smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import Words, byte_slices, discard, gathered, lean, mix64, text_buffers, written

WINDOW, ANCHOR = 50, 16
#: Words of the segments that share a key, above which the group gets the longest prefix.
GROUP_WORDS = 50_000
#: Up to so many keys (16 bytes each) are broadcast.
FEW_KEYS = 100_000
#: Words whose bytes are joined at a time.
JOINED = 1 << 17
#: A task builds trees over about so many words at a time (always whole groups).
BLOCK_WORDS = 400_000
EMPTY = hashlib.sha256(b"").hexdigest()
_LAST = (1 << 63) - 1


def window_keys(w: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all windows of a block, and the number of each window's first word."""
    h, at = w.gram_hash(anchor)
    n = len(w.doc)
    if n < window or not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    low[at] = h
    span, width = window - anchor + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    rest = span - width
    if rest:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    first = np.flatnonzero(w.doc[: n - window + 1] == w.doc[window - 1 :])
    return low[first], first


def word_digests(w: Words, keep: np.ndarray | None = None) -> list[str]:
    """SHA-256 of each text's words (those of the mask `keep`), joined by one space."""
    pick = np.arange(len(w.start)) if keep is None else np.flatnonzero(keep)
    of = np.searchsorted(pick, w.first)
    out, low, high, raw, at = [], 0, 0, b"", np.zeros(1, np.int64)
    for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
        digest = hashlib.sha256()
        while a < b:
            if a >= high:
                low, high = a, min(a + JOINED, len(pick))
                start, size = w.start[pick[low:high]].astype(np.int64), (w.end[pick[low:high]] - w.start[pick[low:high]]).astype(np.int64) + 1
                at = np.concatenate([[0], np.cumsum(size)])
                joined = gathered(w.text, start, size)
                joined[at[1:] - 1] = 32
                raw = joined.tobytes()
            to = min(b, high)
            digest.update(raw[at[a - low] : at[to - low] - (to == b)])
            a = to
        out.append(digest.hexdigest())
    return out


def _describe(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(2)):
                part = batch.slice(a, b - a)
                w = Words(*text_buffers(part.column(2)))
                keys, first = window_keys(w, window, anchor)
                doc = w.doc[first]
                # Runs of windows with one key are segments; then the segments of a document with one key.
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                words = np.diff(np.append(at, len(keys))) + window - 1
                keys, doc = keys[at], doc[at]
                order = np.lexsort((keys, doc))
                keys, doc, words = keys[order], doc[order], words[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                words = np.add.reduceat(words, at) if len(at) else words
                counts = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=b - a))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(counts), pa.array(x)) for x in (keys[at].view(np.int64), words.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(w.count.astype(np.int64)), pa.array(word_digests(w)), *lists], names=["id", "text_hash", "n_words", "sha", "keys", "words"])

    return run


def _segments(window: int, anchor: int):
    """Segments of light keys (key, id, text_hash, at, words) and suffixes of heavy keys (prefix hash, id, text_hash, at, null)."""
    names = ["key", "id", "text_hash", "at", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(2)):
                part = batch.slice(a, b - a)
                w = Words(*text_buffers(part.column(2)))
                keys, first = window_keys(w, window, anchor)
                doc = w.doc[first]
                shared, heavy = part.column(3), part.column(4)
                owner = np.repeat(np.arange(b - a), np.diff(np.asarray(shared.offsets)))
                # A window is looked up by its key and document together.
                tag = lambda k, d: k ^ mix64(d.astype(np.uint64) + np.uint64(1))
                known = tag(np.asarray(shared.flatten()).view(np.uint64), owner)
                order = np.argsort(known)
                known, hot = known[order], np.asarray(heavy.flatten())[order]
                mine = tag(keys, doc)
                at = np.minimum(np.searchsorted(known, mine), max(len(known) - 1, 0))
                hit = known[at] == mine if len(known) else np.zeros(len(mine), bool)
                is_hot = hit & hot[at] if len(known) else hit
                light = np.flatnonzero(hit & ~is_hot)
                ids, hashes = part.column(0), part.column(1)
                if len(light):
                    cut = np.ones(len(light), bool)
                    cut[1:] = (np.diff(light) > 1) | (keys[light[1:]] != keys[light[:-1]]) | (doc[light[1:]] != doc[light[:-1]])
                    begin = light[cut]
                    end = light[np.append(np.flatnonzero(cut)[1:], len(light)) - 1]
                    from_byte, to_byte = w.start[first[begin]], w.end[first[end] + window - 1]
                    text = pa.array([w.text[x:y].tobytes() for x, y in zip(from_byte.tolist(), to_byte.tolist())], pa.binary())
                    of = pa.array(doc[begin])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[begin].view(np.int64)), ids.take(of), hashes.take(of), pa.array((first[begin] - w.first[doc[begin]]).astype(np.int32)), text], names=names)
                if is_hot.any():
                    pick = np.flatnonzero(is_hot)
                    deep, start = w.gram_hash(window)
                    whole = deep[np.searchsorted(start, first[pick])]
                    of = pa.array(doc[pick])
                    yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), ids.take(of), hashes.take(of), pa.array((first[pick] - w.first[doc[pick]]).astype(np.int32)), pa.nulls(len(pick), pa.binary())], names=names)

    return run


def deep_nodes(words: Words, ids: np.ndarray, window: int) -> np.ndarray:
    """Suffixes (word numbers) whose window also starts in a document with a smaller id.

    words: a block of segments, each a text of its own; ids: the document id of each segment.
    """
    n = len(words.doc)
    alive = np.flatnonzero(words.doc[: max(0, n - window + 1)] == words.doc[window - 1 :]) if n >= window else np.zeros(0, np.int64)
    depth = 1
    while len(alive):
        h, at = words.gram_hash(depth)
        key = h if depth == 1 else h[np.searchsorted(at, alive)]
        key = key[alive] if depth == 1 else key
        who = ids[words.doc[alive]]
        order = np.argsort(key, kind="stable")
        edge = np.ones(len(order), bool)
        edge[1:] = key[order[1:]] != key[order[:-1]]
        begin = np.flatnonzero(edge)
        least = np.minimum.reduceat(who[order], begin)
        most = np.maximum.reduceat(who[order], begin)
        size = np.diff(np.append(begin, len(order)))
        if depth == window:
            later = np.zeros(len(order), bool)
            later[order] = who[order] > np.repeat(least, size)
            return alive[later]
        inner = np.zeros(len(order), bool)
        inner[order] = np.repeat(least != most, size)
        alive = alive[inner]
        depth = min(4 * depth, window)
    return alive


def _trees(window: int):
    """Runs of words to remove (id, text_hash, from, to), from segments sorted by key."""
    names = ["id", "text_hash", "from", "to"]

    def build(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        words = Words(*text_buffers(table["words"].chunk(0)))
        ids = table["id"].to_numpy()
        hit = deep_nodes(words, ids, window)
        seg = words.doc[hit]
        start = table["at"].to_numpy().astype(np.int64)[seg] + hit - words.first[seg]
        cut = np.ones(len(hit), bool)
        cut[1:] = (seg[1:] != seg[:-1]) | (np.diff(hit) > 1)
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(hit)) - 1
        return pa.RecordBatch.from_arrays([pa.array(ids[seg[begin]]), pa.array(table["text_hash"].to_numpy()[seg[begin]]), pa.array(start[begin]), pa.array(start[end[: len(begin)]] + window)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, enough = 0, 6 * BLOCK_WORDS
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                held.append(batch.slice(at, 2000))
                size += held[-1].column(4).nbytes
                if size < enough:
                    continue
                table = pa.Table.from_batches(held)
                keys = table["key"].to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
                if cut:
                    yield build(table.slice(0, cut))
                rest = table.slice(cut).combine_chunks()
                held, size = rest.to_batches(), rest["words"].nbytes
                enough = max(6 * BLOCK_WORDS, 2 * size)
        if held:
            yield build(pa.Table.from_batches(held))

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in byte_slices(batch.column(2)):
            part = batch.slice(a, b - a)
            w = Words(*text_buffers(part.column(2)))
            edge = np.zeros(len(w.start) + 1, np.int32)
            for k, by in ((3, 1), (4, -1)):
                lists = part.column(k)
                at = np.asarray(lists.flatten()) + np.repeat(w.first[:-1], np.diff(np.asarray(lists.offsets)))
                np.add.at(edge, at, by)
            gone = np.cumsum(edge[:-1]) > 0
            n_removed = np.bincount(w.doc[gone], minlength=b - a)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(word_digests(w), pa.string()), pa.array(n_removed.astype(np.int64)), pa.array(word_digests(w, ~gone), pa.string())], names=["id", "sha", "n_removed", "kept_sha256"])


def _by_key(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows joined with a written table on its key: broadcast if few, else so that Spark may split a key's many rows."""
    return rows.join(F.broadcast(table) if table.count() <= FEW_KEYS else table, "key")


def repeated_runs(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, group_words: int = GROUP_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """(all documents, documents that may repeat others with their text, runs of words to remove, tables that the runs are read from)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    every = written(rows.mapInArrow(lean(_describe(window, anchor)), "id long, text_hash long, n_words long, sha string, keys array<long>, words array<int>"), "described")
    # One document of each text: the sha is that of its words.
    firsts = every.filter(F.col("n_words") >= window).groupBy("sha").agg(F.min(F.struct("id", "text_hash", "keys", "words")).alias("d")).select("d.*")
    firsts = written(firsts, "first-copies")
    held = firsts.select("id", "text_hash", F.explode(F.arrays_zip("keys", "words")).alias("k")).select("id", "text_hash", "k.keys", "k.words").toDF("id", "text_hash", "key", "words")
    shared = held.groupBy("key").agg(F.sum("words").alias("all_words"), F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b")
    shared = written(shared.select("key", (F.col("all_words") > group_words).alias("heavy")), "shared-keys")
    wanted = _by_key(held.drop("words"), shared).groupBy("id", "text_hash").agg(F.collect_list(F.struct("key", "heavy")).alias("k"))
    wanted = wanted.select("id", "text_hash", F.col("k.key").alias("keys"), F.col("k.heavy").alias("heavy"))
    texts = written(rows.filter(F.length("text") >= 2 * window - 1).join(wanted, ["id", "text_hash"]).dropDuplicates(["id", "text_hash"]).select("id", "text_hash", "text", "keys", "heavy"), "repeating-texts")
    discard(firsts, shared)
    parts = texts.mapInArrow(lean(_segments(window, anchor)), "key long, id long, text_hash long, at int, words binary")
    parts = written(parts, "segments", compression="zstd")
    light = parts.filter("words IS NOT NULL").repartition("key").sortWithinPartitions("key")
    runs = light.mapInArrow(lean(_trees(window)), "id long, text_hash long, `from` long, `to` long")
    heavy = parts.filter("words IS NULL").drop("words")
    least = written(heavy.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").drop("most"), "leaves")
    deep = _by_key(heavy, least).filter("id > least").select("id", "text_hash", F.col("at").cast("long").alias("from"), (F.col("at") + window).cast("long").alias("to"))
    return every, texts, runs.unionByName(deep), [parts, least]


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, group_words: int = GROUP_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window over it also starts in a document with a smaller id; a null id is
    greater than all others. Repeats within one document, and documents below `window` words, stay.
    Null and empty texts have no words; repeated rows each keep their row, and equal ids never
    remove from each other. Windows are compared by 64-bit hashes of their words. An empty table
    gives no rows. A task needs about 20 bytes for each byte of its longest text. Other columns are
    not read.
    """
    every, texts, runs, read = repeated_runs(docs, window, anchor, group_words, id_col, text_col)
    by_doc = runs.groupBy("id", "text_hash").agg(F.collect_list("from").alias("begin"), F.collect_list("to").alias("end"))
    cut = texts.select("id", "text_hash", "text").join(by_doc, ["id", "text_hash"]).mapInArrow(lean(_cut_out), "id long, sha string, n_removed long, kept_sha256 string")
    cut = written(cut, "cut-texts")
    discard(texts, *read)
    narrow = every.drop("keys", "words", "text_hash")
    first = written(narrow.filter(F.col("n_words") >= window).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "copied")
    out = narrow.join(F.broadcast(first) if first.count() <= FEW_KEYS // 4 else first, "sha", "left").join(cut, ["id", "sha"], "left")  # rows of one id and the same words lose the same
    copy = F.col("id") > F.col("first")
    return out.select(
        F.when(F.col("id") != _LAST, F.col("id")).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


REPEATS_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i,
             unnest(list_transform(range(1, len(ws) + 1), lambda k: CASE WHEN k + {WINDOW - 1} <= len(ws) THEN md5(array_to_string(list_slice(ws, k, k + {WINDOW - 1}), ' ')) END)) AS win FROM d),
f AS (SELECT doc_id, word, i, CASE WHEN win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id THEN 1 ELSE 0 END AS later FROM u),
g AS (SELECT doc_id, word, i, max(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i), '') AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

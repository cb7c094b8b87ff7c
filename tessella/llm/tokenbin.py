"""Token ids in Parquet list columns: delta or dictionary encoding, small row groups, page indexes.

Documents are range-partitioned by id and sorted, so that file after file holds ascending ids. Each
task encodes its documents in one pass and keeps a running count of ids. A file has the metadata
columns beside the list column; Parquet's page indexes let a reader fetch one document's ids, or the
metadata of all documents, without the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import byte_slices, lean, parallelism, scratch_dir, text_buffers
from tessella.llm.tokens import encoder

#: Characters of a text that order equal ids, and rows of an id that one task takes.
LEAD, SAME_IDS = 24, 10_000
#: Parquet settings: version 2 pages have delta-packed integers where no dictionary pays; dictionaries
#: serve the ids, whose vocabulary fits one dictionary page; every column has a page index.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "20000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.dictionary.page.size": str(2 << 20),
}


def encode_column(column: pa.Array, vocabulary: str, end_id: int | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, ids, where each row's ids start) for blocks of a string column."""
    enc = encoder(vocabulary)
    for a, b in byte_slices(column):
        ids, at = enc.block(*text_buffers(column.slice(a, b - a)))
        if end_id is not None:
            n = np.diff(at)
            out = np.full(len(ids) + len(n), end_id, np.int32)
            keep = np.ones(len(out), bool)
            at = at + np.arange(len(at))
            keep[at[1:] - 1] = False
            out[keep] = ids
            ids = out
        yield a, b, ids, at


def write_token_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, layout: dict[str, str] = LAYOUT) -> None:
    """Write the ids of every text below path, ascending by id.

    Columns: doc_id, part (number of the file's task), local_start (ids before the document in its
    file), n_tokens, tokens. A null text counts as empty and has the end id only; a null doc_id comes
    first; equal ids are ordered by the first LEAD characters of their texts, then a hash and the text, so
    that any number of them spreads over tasks, and each keep their row. There are as many tasks as the input
    has splits, or as the session has partitions if these are more. Other columns of docs are not read.
    An empty table gives an empty directory of files. A text's ids are one list, whole in a task's memory.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tasks = partitions or max(parallelism(docs.sparkSession), rows.rdd.getNumPartitions())
    most = rows.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0  # reads ids only
    order = [F.col("doc_id"), F.substring("text", 1, LEAD), F.xxhash64("text"), F.col("text")] if most > 1 else [F.col("doc_id")]
    rows = rows.repartitionByRange(tasks, *order[: 3 if most > SAME_IDS else 1]).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids_of, text = batch.column(0), batch.column(1)
            for a, b, ids, at in encode_column(text, vocabulary, end_id):
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [ids_of.slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(total + at[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))],
                    names=["doc_id", "part", "local_start", "n_tokens", "tokens"],
                )
                total += int(at[-1])

    out = rows.mapInArrow(lean(encode), "doc_id long, part int, local_start long, n_tokens long, tokens array<int>")
    out.write.options(**layout).parquet(path)


def read_token_index(spark, path: str) -> DataFrame:
    """doc_id, part, n_tokens and start of every document: reads metadata columns only."""
    meta = spark.read.parquet(path).select("doc_id", "part", "local_start", "n_tokens")
    return _with_start(meta, path)


def _with_start(rows: DataFrame, path: str) -> DataFrame:
    """local_start turned into start. There is one total for each file, so that side is bounded."""
    parts = rows.sparkSession.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    totals = sorted((r.part, r.n) for r in parts.collect())
    before, at = [], 0
    for part, n in totals:
        before.append((part, at))
        at += n
    base = rows.sparkSession.createDataFrame(before, "part int, base long")
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base", "local_start", "part")


def read_tokens(spark, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and tokens of a few documents: row groups and pages without them are passed over by their statistics."""
    return spark.read.parquet(path).filter(F.col("doc_id").isin(*doc_ids)).select("doc_id", "tokens")


def read_token_digest(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, computed from the ids that the files hold."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at = np.asarray(lists.offsets)
            raw = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            size = pa.array(np.diff(at).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), size, pa.array(crc, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(path).select("doc_id", "part", "local_start", "tokens")
    rows = rows.mapInArrow(lean(digest), "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return _with_start(rows, path)


def token_ids(docs: DataFrame, vocabulary: str, end_id: int = 2, path: str | None = None, **columns: str) -> DataFrame:
    """Write all ids, read the files back and return doc_id, start, n_tokens and ids_crc32."""
    path = path or scratch_dir(docs.sparkSession, "token-ids")
    write_token_ids(docs, path, vocabulary, end_id, **columns)
    return read_token_digest(docs.sparkSession, path).select("doc_id", "start", "n_tokens", "ids_crc32")

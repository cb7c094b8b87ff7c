"""Shards by extendible hashing: only buckets over the byte limit split on a further hash bit.

A bucket is a prefix of the bits of a row's hash. Bytes are summed once for all prefixes of a fine
depth; from these follow the sums of every shorter prefix, and so the depth at which each bucket
first fits. Rows in cells that are too large even at the fine depth are refined by eight further
bits, on their own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._shared import discard, fresh, parallelism, scratch_dir, written

#: Bits of the hash, and cells of the fine histogram for each shard that the limit makes necessary (as a power of two).
BITS, FINER, DEEPER = 60, 4, 8
#: Prefixes of at most this many bits are so few (2048) that their sums are broadcast.
TOP = 10
#: Texts that one writer task takes, about; a task writes whole shards, one after another in the order of their bits.
TASK_BYTES = 128 << 20
#: Cells of a histogram of bytes that one task orders and that are broadcast, at most.
FEW_CELLS = 1 << 18


def row_hash(id_col: str) -> F.Column:
    """The first 60 bits of the md5 of an id; null ids hash as the text 'null'."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def _depths(cells: DataFrame, fine: int, least: int, limit: int) -> DataFrame:
    """cell, depth: the smallest depth (from least on) at which the cell's bucket fits, or null."""
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(least), F.lit(fine))))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {fine} - depth)"))
    sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("all_bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
    fits = sums.filter((F.col("all_bytes") <= limit) | (F.col("low") == F.col("high"))).select("depth", "prefix")
    top = levels.filter(F.col("depth") <= TOP).join(F.broadcast(fits.filter(F.col("depth") <= TOP)), ["depth", "prefix"])
    deep = levels.filter(F.col("depth") > TOP).join(fits.filter(F.col("depth") > TOP), ["depth", "prefix"])
    best = top.select("cell", "depth").unionByName(deep.select("cell", "depth")).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(best, "cell", "left")


def _assigned(docs: DataFrame, limit: int, id_col: str, text_col: str) -> tuple[DataFrame, list[str], int]:
    """docs with the hash, the bytes and the depth of each row under new names, these names, and the bytes of all texts."""
    h, size, cell, depth = names = fresh(docs, "h", "bytes", "cell", "depth")
    rows = docs.withColumns({h: row_hash(id_col), size: F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")})
    total = rows.agg(F.sum(size)).first()[0] or 0
    least, fine = 0, min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + FINER)
    out = None
    while True:
        at = F.shiftright(F.col(h), BITS - fine)
        cells = rows.groupBy(at.alias("cell")).agg(F.sum(size).alias("bytes"), F.min(h).alias("low"), F.max(h).alias("high"))
        cells = written(cells, "cells")
        depths = written(_depths(cells, fine, least, limit), "directory")
        discard(cells)
        few = depths.count() <= 200_000
        side = depths.toDF(cell, depth)
        joined = rows.withColumn(cell, at).join(F.broadcast(side) if few else side, cell).drop(cell)
        found = joined.filter(F.col(depth).isNotNull())
        out = found if out is None else out.unionByName(found)
        if depths.filter("depth IS NULL").isEmpty():
            return out, [h, size, depth], total
        rows = joined.filter(F.col(depth).isNull()).drop(depth)
        least, fine = fine + 1, min(BITS, fine + DEEPER)


def _bits(h: str, depth: str) -> F.Column:
    bits = F.lpad(F.bin(F.expr(f"shiftright(`{h}`, {BITS} - `{depth}`)")), F.col(depth), F.lit("0"))
    return F.when(F.col(depth) == 0, F.lit("*")).otherwise(bits)


def assign_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with `shard` (its hash bits, '*' for the one bucket of depth 0) and `shard_depth`.

    A shard's texts have at most `limit` UTF-8 bytes together. A bucket whose rows all have one hash
    (a single long text, repeated ids) can't be split and may be larger. Null texts have no bytes;
    an empty table gives no rows. Existing columns named shard or shard_depth are replaced; all
    others stay as they are, whatever their names.
    """
    docs = docs.drop("shard", "shard_depth")
    rows, (h, _, depth), _ = _assigned(docs, limit, id_col, text_col)
    return rows.select(*docs.columns, _bits(h, depth).alias("shard"), F.col(depth).alias("shard_depth"))


def _dealt(rows: DataFrame, h: str, size: str, depth: str, total: int, tasks: int) -> DataFrame:
    """rows in so many tasks, each of whole shards."""
    bits = min(BITS, math.ceil(math.log2(tasks)) + 4)
    first, task = fresh(rows, "first", "task")
    # The first cell of a row's shard: its leading bits, as many as the shard has, and zeros.
    rows = rows.withColumn(first, F.shiftright(F.expr(f"shiftleft(shiftright(`{h}`, {BITS} - `{depth}`), {BITS} - `{depth}`)"), BITS - bits))
    if 1 << bits > FEW_CELLS:
        return rows.repartition(tasks, F.col(first))
    cells = rows.groupBy(F.col(first).alias("first")).agg(F.sum(size).alias("bytes"))  # at most FEW_CELLS
    before = F.coalesce(F.sum("bytes").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = written(cells.select("first", F.least(F.floor(before * tasks / max(total, 1)), F.lit(tasks - 1)).cast("int").alias("task")), "tasks").toDF(first, task)
    return rows.join(F.broadcast(dealt), first).repartitionById(tasks, F.col(task))


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write one folder of Parquet for each shard.

    A task writes whole shards, TASK_BYTES of texts or so (less where there are fewer than the
    session's partitions): which, follows from a histogram of bytes over the first bits, 16 to 32 cells
    for each task. A task has more only by what one shard has. If these are more than FEW_CELLS, cells
    are dealt by hash instead, so that nothing as large as the histogram is ordered or broadcast; a
    task's bytes then vary as sums of that many cells do.
    """
    docs = docs.drop("shard", "shard_depth")
    rows, (h, size, depth), total = _assigned(docs, limit, id_col, text_col)
    rows = _dealt(rows, h, size, depth, total, max(parallelism(docs.sparkSession), -(-total // TASK_BYTES)))
    out = rows.select(*docs.columns, F.concat(F.lit("b"), _bits(h, depth)).alias("shard"), F.col(depth).alias("shard_depth"))
    out.write.partitionBy("shard").parquet(path)


def shard_table(docs: DataFrame, limit: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards, read them back and return doc_id, shard, shard_depth, n_bytes, shard_bytes."""
    spark = docs.sparkSession
    path = path or scratch_dir(spark, "shards")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    write_shards(rows, path, limit)
    if rows.isEmpty():
        return rows.selectExpr("doc_id", "'' AS shard", "0 AS shard_depth", "0L AS n_bytes", "0L AS shard_bytes").limit(0)
    back = spark.read.schema(f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, shard_depth int, shard string").parquet(path)
    back = written(back.select("doc_id", F.expr("substring(shard, 2)").alias("shard"), "shard_depth", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "shard-rows")
    sizes = back.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    return back.join(sizes, "shard").select("doc_id", "shard", "shard_depth", "n_bytes", "shard_bytes")


def shard_sql(limit: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
l AS (SELECT d.*, t.depth, h >> CAST(60 - t.depth AS INT) AS prefix FROM d, (SELECT unnest(range(0, 31)) AS depth) t),
s AS (SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM l GROUP BY ALL HAVING sum(n_bytes) <= {limit} OR min(h) = max(h)),
f AS (SELECT l.doc_id, l.h, l.n_bytes, l.depth, l.prefix, s.shard_bytes FROM l JOIN s USING (depth, prefix) QUALIFY row_number() OVER (PARTITION BY l.doc_id ORDER BY l.depth) = 1)
SELECT doc_id, CASE WHEN depth = 0 THEN '*' ELSE lpad(bin(prefix), CAST(depth AS INT), '0') END AS shard, CAST(depth AS INT) AS shard_depth, n_bytes, shard_bytes FROM f
"""

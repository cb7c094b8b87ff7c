"""Exact dedup by content sort, with DataFrame functions only.

Normalised texts are range-partitioned by sampled splitters, sorted, and compared in full with their
neighbours. Splitters are the first bytes and a hash of a text, so that what is sampled stays small
and a common beginning is no hot range. A text with more copies than a task should sort is salted:
each part keeps its own best row, and the parts' best rows are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._shared import fresh, parallelism, written

#: Bytes of a normalised text that its splitter holds.
PREFIX = 24
#: A text with fewer copies than this is never hot.
LEAST_HOT = 200


def normalised(text: str | F.Column) -> F.Column:
    r"""A text without the characters [\x20\x09-\x0D]; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "[ \\t-\\r]+", "")


def _hot_texts(norms: DataFrame, column: str) -> DataFrame:
    """Hashes (in `column`) of the texts with more copies than a quarter of a partition's rows: at most 4 for each partition."""
    hot_at = max(LEAST_HOT, norms.count() // (4 * parallelism(norms.sparkSession)))
    counted = norms.groupBy(column).agg(F.count(F.lit(1)).alias("copies"))
    return written(counted.filter(F.col("copies") > hot_at).select(column), "hot-texts")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their normalised forms are. Of equal texts the row with the most code points
    stays, then that with the smallest id (a null id last); of rows that agree in both, one stays.
    Null, empty and blank texts are one group. An empty table gives no rows. Other columns are not read.
    """
    parts = parallelism(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"), normalised(text_col).alias("norm"))
    rows = rows.withColumn("hash", F.xxhash64("norm"))
    hot = _hot_texts(rows, "hash").withColumn("hot", F.lit(True))
    rows = rows.join(F.broadcast(hot), "hash", "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "n"), F.lit(4 * parts))).otherwise(F.lit(0))
    keys = ["prefix", "hash", "salt"]
    rows = rows.withColumns({"prefix": F.substring("norm", 1, PREFIX), "salt": salt}).repartitionByRange(parts, *keys)
    best = [F.col("n").desc(), F.col("doc_id").asc_nulls_last()]
    alike = Window.partitionBy(*keys, "norm")
    local = rows.select(
        "doc_id", "n", F.sha2("norm", 256).alias("text_sha256"), F.coalesce("hot", F.lit(False)).alias("hot"),
        F.row_number().over(alike.orderBy(*best)).alias("place"),
        F.first("doc_id").over(alike.orderBy(*best)).alias("first_id"),
        F.count("*").over(alike).alias("many"),
    )
    local = written(local, "sorted-texts")
    # Heads of the salted parts: at most 4 * parts for each hot text.
    heads = local.filter("hot AND place = 1")
    merged = heads.groupBy("text_sha256").agg(F.sum("many").alias("all_many"), F.min(F.struct((-F.col("n")).alias("n"), F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"))).alias("top"))
    cold = local.filter("NOT hot").select("doc_id", F.col("first_id").alias("keep_id"), F.col("many").alias("group_size"), (F.col("place") == 1).alias("kept"), "text_sha256")
    joined = local.filter("hot").join(F.broadcast(merged), "text_sha256")
    is_top = (F.col("place") == 1) & (-F.col("n") == F.col("top.n")) & F.col("doc_id").eqNullSafe(F.col("top.id"))
    warm = joined.select("doc_id", F.col("top.id").alias("keep_id"), F.col("all_many").alias("group_size"), is_top.alias("kept"), "text_sha256")
    return cold.unionByName(warm)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns, whatever these are named.

    Rows are compared as in exact_groups(), in one shuffle of the rows as they are: the normalised
    text is made again behind it. Of a hot text each task first keeps its best row, by SHA-256, so
    that its copies don't travel.
    """
    n, hashed, prefix, norm, place, sha = fresh(docs, "n", "hash", "prefix", "norm", "place", "sha")
    rows = docs.withColumns({n: F.length(F.coalesce(F.col(text_col), F.lit(""))), hashed: F.xxhash64(normalised(text_col))})
    order = [-F.col(n), F.col(id_col).isNull(), F.col(id_col)]
    hot = _hot_texts(rows, hashed)
    if not hot.isEmpty():
        many = rows.join(F.broadcast(hot), hashed, "left_semi").withColumn(sha, F.sha2(normalised(text_col), 256))
        best = many.groupBy(sha).agg(F.min_by(F.struct(*rows.columns), F.struct(*[c.alias(f"by{k}") for k, c in enumerate(order)])).alias("best")).select("best.*")
        rows = rows.join(F.broadcast(hot), hashed, "left_anti").select(*rows.columns).unionByName(best)
    rows = rows.withColumn(prefix, F.substring(normalised(text_col), 1, PREFIX)).repartitionByRange(parallelism(docs.sparkSession), prefix, hashed)
    alike = Window.partitionBy(prefix, hashed, norm).orderBy(*order)
    return rows.withColumn(norm, normalised(text_col)).withColumn(place, F.row_number().over(alike)).filter(F.col(place) == 1).select(*docs.columns)


EXACT_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
             row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS place FROM n)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
"""

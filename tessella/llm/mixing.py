"""Mixing sources to target weights, with DataFrame functions only.

Token counts are summed for each source; a budget is shared by weight; a source's repetition rate is
its target over its size. Each document is taken floor(rate) times, and once more by a Bernoulli draw
that a hash of its id seeds, with the fraction as probability.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._shared import WORD, discard, parallelism, written

#: Hexadecimal digits of a document's hash that make its draw: as many as a double holds exactly.
DIGITS = 13
#: Fewer sources than this are broadcast (three numbers and a name each).
BROADCAST_SOURCES = 50_000


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row for each source: source, source_size, target, from rows of (source, source_size).

    Sources in code-point order, null last, weigh `weights` in turn. They share `total` times all
    sizes by weight; none gets more than `most` times its size, and what is over is shared again
    among the others. Ranks are taken within sorted ranges, so no task holds all sources. A source
    of size 0 has target 0.
    """
    ranged = sizes.repartitionByRange(parallelism(sizes.sparkSession), F.col("source").asc_nulls_last())
    ranged = written(ranged.withColumn("part", F.spark_partition_id()), "sources")
    # A row for each partition, so that one task can order them.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("base") + F.col("local") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = written(ranged.withColumn("local", local).join(F.broadcast(base), "part").select("source", "source_size", weight.alias("weight")), "ranks")
    discard(ranged)
    cap = F.col("source_size") * F.lit(float(most))
    all_size = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level = total * all_size, 0.0
    while True:  # each turn saturates further sources; it ends after a few turns, whatever their number
        over = cap <= F.col("weight") * F.lit(level)
        row = ranked.agg(F.sum(F.when(over, F.col("source_size"))).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        free = row["free"] or 0.0
        if not free:
            break
        found = (budget - most * (row["full"] or 0)) / free
        if found <= level:
            break
        level = found
    return ranked.select("source", "source_size", F.round(F.least(cap, F.col("weight") * F.lit(level)), 6).alias("target"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies, taken. See allot() for settings."""
    return allot(docs, **settings)


def allot(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies, taken (and `keep`, as keep_<name>).

    Size is the number of words; a null or empty text has size 0 and is taken as its source's rate
    says, with no words. A document is taken floor(rate) times, and once more with the fraction as
    probability: if the hash of seed and id, as a number from 0 to 1, is below it. Rows with equal ids
    draw alike. Reruns give the same rows, another seed other draws. Clashing names are no matter:
    only the three columns named and `keep` are read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    rows = rows if keep else written(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, total, most)
    targets = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    few = targets.count() < BROADCAST_SOURCES
    right = targets.withColumnRenamed("source", "its_source")
    joined = rows.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    draw = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))
    whole = F.floor("rate")
    out = joined.withColumn("copies", (whole + (draw < F.col("rate") - whole).cast("long")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *[f"keep_{c}" for c in keep])


def emit(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: each document as often as mix() takes it, with the columns of docs."""
    mixed = allot(docs, keep=tuple(docs.columns), **settings).filter("copies > 0")
    mixed = mixed.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return mixed.select(*[F.col(f"keep_{c}").alias(c) for c in docs.columns])


MIX_SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT / CAST(4503599627370496 AS DOUBLE) AS draw
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM src),
o AS (SELECT *, source_size * 2.0::DOUBLE AS cap,
             row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST) AS k FROM w),
c AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
             sum(source_size) OVER () AS all_size FROM o),
lv AS (SELECT *, (CAST(1.5 AS DOUBLE) * all_size - CAST(2.0 AS DOUBLE) * full_before) / free AS level FROM c),
one AS (SELECT level FROM lv WHERE cap > weight * level ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, round(least(cap, weight * coalesce((SELECT level FROM one), 1e300)), 6) AS target FROM o),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
j AS (SELECT s.*, r.source_size, r.target, r.rate, floor(r.rate) AS whole FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CAST(draw < rate - whole AS INT)) AS BIGINT) AS taken FROM j
"""

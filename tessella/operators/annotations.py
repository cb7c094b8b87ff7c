"""Annotations of line ranges, and the one that covers a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import range_label


def explode_annotations(files: DataFrame, column: str = "annotations") -> DataFrame:
    """A row for each annotation, with its place in the list."""
    others = [c for c in files.columns if c != column]
    rows = files.select(*others, F.posexplode(column).alias("idx", "a"))
    return rows.select(*others, "idx", "a.line_start", "a.line_end", "a.annotation")


#: Lines of a block: longer ranges are kept by whole blocks, and by line only at their ends.
BLOCK_LINES = 64
#: Lines of a task, about: what a task sorts doesn't grow with the table. (Rows of a few bytes that compress well would
#: otherwise meet in a few tasks.)
TASK_LINES = 200_000


def tasks(spark: SparkSession, lines: int) -> int:
    """In how many tasks so many lines are looked up."""
    return max(spark.sparkContext.defaultParallelism, -(-lines // TASK_LINES))


def lookup(lines: DataFrame, annotations: DataFrame, keys: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """lines (keys, line) with `annotation`: the first in list order whose closed range holds the line, else null.

    A range is entered for the whole blocks of lines that it covers and for the single lines before and
    behind them: at most 126 lines, and a row for each 64 lines. Lines meet both by equal keys, so a
    long file makes no product of lines and ranges. Repeated lines each keep their row. Rows meet in `parts` tasks;
    if that isn't given, lines are counted first.
    """
    parts = parts or tasks(lines.sparkSession, lines.count())
    block = lambda c: F.floor(F.col(c) / BLOCK_LINES)
    last = lines.groupBy(*keys).agg(F.max("line").alias("_last"))
    ranged = annotations.join(last, list(keys)).withColumns({"_from": F.greatest("line_start", F.lit(1)), "_to": F.least("line_end", "_last")}).filter("_from <= _to")
    # Whole blocks are _low .. _high - 1.
    ranged = ranged.withColumns({"_low": F.ceil(F.col("_from") / BLOCK_LINES), "_high": F.floor((F.col("_to") + 1) / BLOCK_LINES)})
    whole = F.col("_low") < F.col("_high")
    single = F.when(whole, F.concat(_span(F.col("_from"), F.col("_low") * BLOCK_LINES), _span(F.col("_high") * BLOCK_LINES, F.col("_to") + 1))).otherwise(_span(F.col("_from"), F.col("_to") + 1))
    blocks = F.when(whole, _span(F.col("_low"), F.col("_high"))).otherwise(F.array().cast("array<bigint>"))
    place = lambda kind, at: F.transform(at, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("at")))
    entered = ranged.select(*keys, "idx", "annotation", F.explode(F.concat(place(1, single), place(BLOCK_LINES, blocks))).alias("_p"))
    entered = entered.select(*keys, "idx", "annotation", "_p.kind", "_p.at").repartition(parts, *keys, "kind", "at")
    first = entered.groupBy(*keys, "kind", "at").agg(F.min(F.struct("idx", "annotation")).alias("_a"))
    by_line = first.filter("kind = 1").select(*keys, F.col("at").alias("line"), F.col("_a").alias("_one"))
    by_block = first.filter("kind <> 1").select(*keys, F.col("at").alias("_block"), F.col("_a").alias("_many"))
    met = lines.repartition(parts, *keys, "line").join(by_line.repartition(parts, *keys, "line"), [*keys, "line"], "left")
    met = met.withColumn("_block", block("line")).repartition(parts, *keys, "_block").join(by_block.repartition(parts, *keys, "_block"), [*keys, "_block"], "left")
    return met.withColumn("annotation", F.least("_one", "_many")["annotation"]).drop("_block", "_one", "_many")


def _span(a: Column, b: Column) -> Column:
    """The whole numbers from a up to before b."""
    return F.when(a < b, F.sequence(a.cast("long"), (b - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def labels(annotations: DataFrame) -> DataFrame:
    return annotations.withColumn("label", range_label("line_start", "line_end"))

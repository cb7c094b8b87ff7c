"""Keys of cached results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import content_hash


def annotation_key(content: str = "content") -> Column:
    return F.concat(F.lit("annotate:"), content_hash(content))


def overview_keys(files: DataFrame) -> DataFrame:
    """project, cache_key: a hash of path:size of the project's ranked files. The cap bounds what is gathered."""
    items = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "path", F.col("size").cast("string")).alias("item"))))
    signature = F.array_join(F.transform(items, lambda x: x["item"]), "|")
    return files.groupBy("project").agg(F.concat(F.lit("overview:"), content_hash(signature)).alias("cache_key"))

"""The stores as tables: cached results, projects and counters, created once and read through.

A project's metadata is kept as JSON, as it is looked up whole; the contents of its files are rows of a table of their
own, so that no row grows with a project's files, and a look-up of a file reads that file's row. Projects in memory
never expire; the time to live applies where one has to be read back from the table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as t
from tessella.functions import values as v
from tessella.operators import scan
from tessella.operators.cache import is_live
from tessella.scratch import written

#: The stores' tables.
TABLES = {
    "cache": "key STRING, value STRING, created_at TIMESTAMP",
    "projects": "id STRING, data STRING, created_at TIMESTAMP",
    "project_files": "id STRING, path STRING, content STRING",
    "rate_limits": "client STRING, day DATE, requests BIGINT",
}


def create_tables(spark: SparkSession, schema: str = "default") -> None:
    """Create the tables that don't exist yet."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {schema}.{name} ({columns}) USING parquet")


def project_rows(meta: DataFrame, created_at: Column, name: Column | None = None) -> DataFrame:
    """id, data, created_at of projects: their metadata as a JSON object. meta has project, total_files, files, which the cap bounds."""
    name = F.col("project") if name is None else name
    data = F.to_json(F.struct(F.col("project").alias("id"), name.alias("name"), "total_files", "files"))
    return meta.select(F.col("project").alias("id"), data.alias("data"), created_at.alias("created_at"))


def file_rows(contents: DataFrame) -> DataFrame:
    """id, path, content of projects' files (project, path, content, one row for each path)."""
    return contents.select(F.col("project").alias("id"), "path", "content")


class Saved(NamedTuple):
    """projects: id, data, created_at; files: id, path, content; ranked: the accepted files, with project as their id."""

    projects: DataFrame
    files: DataFrame
    ranked: DataFrame


def save_uploads(uploads: DataFrame, created_at: Column, most: int = v.MAX_FILES) -> Saved:
    """Uploads as new projects: rejected if there is no file, or none readable; a random id each, their metadata and contents.

    uploads has upload (what tells uploads apart), ord, path, content, and relative (a path with its top folder, or
    empty), from which the name follows as in scan.project_names. All files' contents are kept, of equal paths the
    last; metadata has the first `most` accepted ones. An upload of which no file is accepted makes no project.
    """
    scan.require_files(uploads, "no files uploaded")
    ids = written(uploads.select("upload").distinct().withColumn("project", t.project_id()), "ids")
    rows = uploads.join(ids, "upload").drop("upload")
    ranked = scan.rank(scan.cap(scan.scan_upload(rows), most))
    meta = written(scan.project_meta(scan.require_files(ranked)).join(scan.project_names(rows), "project"), "metadata")
    kept = rows.join(meta.select("project"), "project", "left_semi")
    return Saved(project_rows(meta, created_at, F.col("name")), file_rows(scan.contents(kept)), ranked)


def resolve(wanted: DataFrame, memory: DataFrame, stored: DataFrame, now: Column, ttl: int = v.CACHE_TTL_SECONDS) -> DataFrame:
    """wanted (id) with data: from memory, which doesn't expire, else from the table while it is live, else null."""
    held = memory.select("id", F.col("data").alias("_held"))
    kept = stored.filter(is_live("created_at", now, ttl)).select("id", F.col("data").alias("_kept"))
    found = wanted.join(held, "id", "left").join(kept, "id", "left")
    return found.withColumn("data", F.coalesce("_held", "_kept")).drop("_held", "_kept")


def read_through(wanted: DataFrame, memory: DataFrame, stored: DataFrame, now: Column, ttl: int = v.CACHE_TTL_SECONDS) -> tuple[DataFrame, DataFrame]:
    """What resolve() gives, and memory (id, data) with what had to be read from the table: that doesn't expire from then on."""
    found = resolve(wanted, memory, stored, now, ttl)
    fresh = found.filter(F.col("data").isNotNull()).select("id", "data").distinct().join(memory.select("id"), "id", "left_anti")
    return found, memory.select("id", "data").unionByName(fresh)


def purge_projects(projects: DataFrame, files: DataFrame, now: Column, ttl: int = v.CACHE_TTL_SECONDS) -> tuple[DataFrame, DataFrame]:
    """projects that are live, and the files of these."""
    live = projects.filter(is_live("created_at", now, ttl))
    return live, files.join(live.select("id"), "id", "left_semi")


def files_of(found: DataFrame, files: DataFrame) -> DataFrame:
    """found (id, path, data, ...) with the content of that file, null if the project isn't there or has none of that path."""
    held = files.select("id", "path", F.col("content").alias("_content"))
    joined = found.join(held, ["id", "path"], "left")
    return joined.withColumn("content", F.when(F.col("data").isNotNull(), F.col("_content"))).drop("_content")

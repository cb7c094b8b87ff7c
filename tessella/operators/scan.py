"""Scans: which files of an upload or a tree count, and what is kept of them.

Each rule is a named predicate; the first that a file fails is its reject_reason, and accepted files
are those without one. One plan so gives both the result and its audit. Files are capped in input
order within each project, then ranked: configuration files first, then by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as t
from tessella.functions import values as v


def upload_reject_reason(path: str = "path", content: str = "content") -> Column:
    """Uploads: size in code points; empty files and files in skipped folders are accepted."""
    rules = [("unsafe_path", ~t.is_safe_path(path)), ("extension", t.is_skipped_extension(path)), ("too_large", F.length(content) > v.MAX_FILE_SIZE)]
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in rules])


def tree_reject_reason(path: str = "path", content: str = "content") -> Column:
    """Trees: size in bytes; folders, empty and binary files are rejected."""
    size = F.octet_length(F.col(content))
    rules = [("directory", t.in_skipped_dir(path)), ("extension", t.is_skipped_extension(path)), ("too_large", size > v.MAX_FILE_SIZE), ("empty", size == 0), ("binary", t.is_binary(content))]
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in rules])


def client_reject_reason(path: str = "path", content: str = "content") -> Column:
    """The browser's own test: bytes, dot files and NUL anywhere."""
    rules = [("too_large", F.octet_length(F.col(content)) > v.MAX_FILE_SIZE), ("dot_file", F.startswith(t.basename(path), F.lit("."))), ("binary", F.contains(F.col(content), F.lit("\0")))]
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in rules])


def client_path(relative: str = "relative", name: str = "name") -> Column:
    return F.coalesce(F.when(F.col(relative) != "", F.col(relative)), F.col(name))


def read_back(content: str | Column) -> Column:
    """A file's bytes as text with every line end as `\n`: what is kept of a tree's files for look-ups."""
    return F.replace(F.replace(t.decode_utf8(content), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def tree_contents(spark, path: str, most: int | None = None) -> DataFrame:
    """project, path, content of a tree's accepted files, read back for look-ups."""
    from tessella.sources.tree import read_tree

    options = {} if most is None else {"maxFiles": str(most)}
    return read_tree(spark, path, **options).select(F.lit(path).alias("project"), "path", read_back("content").alias("content"))


def project_names(files: DataFrame, project: str = "project", relative: str = "relative", order: str = "ord") -> DataFrame:
    """Name of each project: the top folder of its last file that has a relative path, else 'untitled'."""
    top = F.get(F.split(F.col(relative), "/"), F.lit(0))
    best = F.max_by(F.when(top != "", top), F.when(top != "", F.col(order)))
    return files.groupBy(project).agg(F.coalesce(best, F.lit("untitled")).alias("name"))


def file_info(files: DataFrame, lines: int = v.PREVIEW_LINES) -> DataFrame:
    """size, language, preview beside the other columns of files (path, content)."""
    return files.withColumns({"size": F.octet_length("content").cast("long"), "language": t.language("path"), "preview": t.preview("path", "content", lines)})


def scan_upload(files: DataFrame, lines: int = v.PREVIEW_LINES) -> DataFrame:
    """Accepted files of an upload (project, ord, path, content, ...), with what is kept of them."""
    return file_info(files.filter(upload_reject_reason().isNull()), lines)


def scan_tree(spark, path: str, lines: int = v.PREVIEW_LINES, most: int | None = None) -> DataFrame:
    """Accepted files of a directory tree. ord is their place in a walk: a folder's files come before its folders.

    With `most` the walk ends at so many files.
    """
    from tessella.sources.tree import read_tree

    parts = F.split("path", "/")
    place = F.struct(F.slice(parts, F.lit(1), F.size(parts) - 1).alias("folders"), F.element_at(parts, -1).alias("name"))
    options = {} if most is None else {"maxFiles": str(most)}
    files = read_tree(spark, path, **options).withColumns({"project": F.lit(path), "ord": place})
    decoded = files.withColumn("content", t.decode_utf8("content"))
    return decoded.withColumns({"language": t.language("path"), "preview": t.preview("path", "content", lines)})


def scan_project(spark, path: str, most: int = v.MAX_FILES, most_mb: float = v.MAX_TREE_MB) -> DataFrame:
    """Ranked files of a directory tree, as a project: rejects a tree that is too large or has no readable file."""
    from tessella.sources.tree import check_tree_size

    check_tree_size(spark, path, most_mb)
    return rank(cap(require_files(scan_tree(spark, path, most=most)), most))


def upload_project(files: DataFrame, most: int = v.MAX_FILES) -> DataFrame:
    """Ranked files of an upload (project, ord, path, content): rejects an empty one, and one with no readable file."""
    return rank(cap(require_files(scan_upload(require_files(files, "no files uploaded"))), most))


def cap(files: DataFrame, most: int = v.MAX_FILES) -> DataFrame:
    """The first `most` files of each project in input order; other rows are cut off before the shuffle."""
    place = F.row_number().over(Window.partitionBy("project").orderBy("ord"))
    return files.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def rank(files: DataFrame) -> DataFrame:
    """Adds rank: configuration files first, then by path; equal paths in input order."""
    order = [F.when(t.is_config("path"), 0).otherwise(1), F.col("path"), F.col("ord")]
    return files.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy(*order)))


def project_meta(files: DataFrame) -> DataFrame:
    """A row for each project: total_files, total_size and its ranked files without previews. The cap bounds the array."""
    item = F.struct("rank", "path", "size", "language", F.lit("").alias("preview"))
    grouped = files.groupBy("project").agg(F.count("*").alias("total_files"), F.sum("size").alias("total_size"), F.array_sort(F.collect_list(item)).alias("files"))
    return grouped


def require_files(files: DataFrame, message: str = "no readable files") -> DataFrame:
    if files.isEmpty():
        raise ValueError(message)
    return files


def contents(files: DataFrame) -> DataFrame:
    """project, path, content of every uploaded file; of equal paths the last."""
    return files.groupBy("project", "path").agg(F.max_by("content", "ord").alias("content"))


def file_lookup(wanted: DataFrame, stored: DataFrame, scanned: DataFrame, default: str = "unknown", annotated: str = "python") -> DataFrame:
    """content, language and annotation_language of (project, path).

    The language is that of the first scanned file of that path, be it unknown. A path that wasn't
    scanned has the default language, and another default where it is annotated.
    """
    languages = scanned.groupBy("project", "path").agg(F.min_by("language", "ord").alias("_scanned"))
    found = wanted.join(stored, ["project", "path"], "left").join(languages, ["project", "path"], "left")
    return found.withColumns({"language": F.coalesce("_scanned", F.lit(default)), "annotation_language": F.coalesce("_scanned", F.lit(annotated))}).drop("_scanned")

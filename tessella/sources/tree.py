"""The `source_tree` data source: the regular files of a directory tree, read on the executors.

Folders are listed on the driver, from the top, until there are PARTS partitions or only single folders
are left; those that are still to be entered then are dealt over PARTS partitions, and over more where these would have
over NAMES folders. A folder with many files is dealt over several partitions, each with the names that it reads. Skipped
folders are not entered; links, skipped extensions, too large and empty files are not opened; files with a NUL among
their first bytes, and unreadable files and folders, are left out; a root that is missing has no files. Hidden and
underscored names are ordinary names, unlike in Spark's file sources. The tree must be on a file system that all
executors mount.

Conditions on path and size can be given to read_tree(): folders that no wanted path is in are not entered, and files
that don't meet them aren't opened. (They are not taken over from filters: what Spark 4.1 has handed on to a Python
source for one query stays in force for later queries of the same DataFrame that hand on nothing.) With maxFiles a walk
in order ends at so many files; as which these are depends on all before them, one task walks, and opens no more than
it needs.
"""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.functions import values as v


#: Partitions that the driver splits a tree into, about, and names of one folder, or folders, that a partition reads.
PARTS, NAMES = 256, 10_000


class _Entry(InputPartition):
    """Folders with all that is below them, or (names) some of the files that are directly in the one folder."""

    def __init__(self, folders: list[str], names: list[str] | None = None):
        self.folders, self.names = folders, names


def _skipped(name: str) -> bool:
    return name in v.SKIP_DIRS or name.endswith(v.SKIP_DIR_ENDING)


#: How conditions (column, kind, value) are met.
MEETS = {
    "=": lambda x, y: x == y, "in": lambda x, y: x in y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y,
    "startswith": lambda x, y: x.startswith(y), "endswith": lambda x, y: x.endswith(y), "contains": lambda x, y: y in x,
}


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): value for k, value in options.items()}  # as Spark hands them on
        self.root = os.path.realpath(options["path"])
        self.limit = int(options.get("maxfilesize", v.MAX_FILE_SIZE))
        self.most = int(options["maxfiles"]) if "maxfiles" in options else None
        self.everything = options.get("everything", "false").lower() == "true"
        self.conditions = [tuple(c) for c in json.loads(options.get("where", "[]"))]
        if any(column not in ("path", "size") or kind not in MEETS for column, kind, _ in self.conditions):
            raise ValueError(f"no conditions on path and size: {options['where']}")

    def _wanted(self, column: str, value: str | int) -> bool:
        return all(MEETS[kind](value, other) for name, kind, other in self.conditions if name == column)

    def _leads(self, folder: str) -> bool:
        """Whether some wanted path may be below a folder."""
        below = "" if folder == self.root else os.path.relpath(folder, self.root) + "/"
        for name, kind, value in self.conditions:
            if name == "path" and kind in ("=", "in"):
                if not any(x.startswith(below) for x in ([value] if kind == "=" else value)):
                    return False
            elif name == "path" and kind == "startswith" and not (value.startswith(below) or below.startswith(value)):
                return False
        return True

    def _listed(self, folder: str) -> tuple[list[str], list[str]]:
        """The folders to enter and the names of other entries of a folder, in order; none of an unreadable one."""
        folders, names = [], []
        try:
            with os.scandir(folder) as entries:
                for entry in entries:
                    if not entry.is_dir(follow_symlinks=False):
                        names.append(entry.name)
                    elif (self.everything or not _skipped(entry.name)) and self._leads(entry.path):
                        folders.append(entry.path)
        except OSError:
            return [], []
        return sorted(folders), sorted(names)

    def partitions(self) -> list[_Entry]:
        waiting, out = deque([self.root]), []
        while self.most is None and waiting and len(waiting) + len(out) < PARTS:
            folder = waiting.popleft()
            folders, names = self._listed(folder)
            out += [_Entry([folder], names[i : i + NAMES]) for i in range(0, len(names), NAMES)]
            waiting += folders
        left, parts = list(waiting), max(PARTS, -(-len(waiting) // NAMES))
        return [*out, *(_Entry(left[i::parts]) for i in range(min(parts, len(left))))] or [_Entry([self.root], [])]

    def read(self, partition: _Entry) -> Iterator[tuple[str, bytearray, int]]:
        found = self._walk(partition)
        yield from found if self.most is None else islice(found, self.most)

    def _walk(self, partition: _Entry) -> Iterator[tuple[str, bytearray, int]]:
        waiting = partition.folders[::-1]
        while waiting:
            folder = waiting.pop()
            folders, names = self._listed(folder) if partition.names is None else ([], partition.names)
            for name in names:
                yield from self._file(os.path.join(folder, name))
            waiting += reversed(folders)

    def _file(self, path: str) -> Iterator[tuple[str, bytearray, int]]:
        extension, relative = os.path.splitext(os.path.basename(path))[1].lower(), os.path.relpath(path, self.root)
        if not self._wanted("path", relative) or os.path.islink(path) or not os.path.isfile(path):
            return
        try:
            size = os.stat(path).st_size
            if not self._wanted("size", size):
                return
            if self.everything:
                content = b""
            else:
                if extension in v.SKIP_EXTENSIONS or not 0 < size <= self.limit:
                    return
                with open(path, "rb") as f:
                    content = f.read()
                if b"\0" in content[: v.SNIFFED_BYTES]:
                    return
        except OSError:
            return
        yield relative, bytearray(content), size


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, content binary, size bigint"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_tree(spark: SparkSession, path: str, where: list[tuple[str, str, object]] = (), **options: str) -> DataFrame:
    """path, content, size of a tree's source files; with everything=true all files' sizes, unread; with maxFiles the first ones of a walk.

    where has conditions such as ("size", "<=", 1000) or ("path", "startswith", "src/"), of which files meet all; kinds
    are those of MEETS. With maxFiles the walk ends at so many files that meet them.
    """
    spark.dataSource.register(SourceTree)
    if where:
        options["where"] = json.dumps([list(c) for c in where])
    return spark.read.format("source_tree").options(**options).load(path)


def tree_megabytes(spark: SparkSession, path: str) -> float:
    """Size of all files of a tree, skipped ones included."""
    from pyspark.sql import functions as F

    total = read_tree(spark, path, everything="true").agg(F.sum("size")).first()[0]
    return (total or 0) / 1048576


def check_tree_size(spark: SparkSession, path: str, most: float = v.MAX_TREE_MB) -> float:
    """The size of a tree in MB; one of more than `most` is rejected."""
    size = tree_megabytes(spark, path)
    if size > most:
        raise ValueError(f"the tree has {size:.1f} MB, more than {most:g}")
    return size


def write_tree(files: DataFrame, path: str) -> int:
    """Write files (path, content) below the folder `path`, which all executors mount; the number written."""
    root = path

    def write(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                full = os.path.normpath(os.path.join(root, name))
                if os.path.commonpath([root, full]) != root:
                    raise ValueError(f"{name} is not below its root")
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as f:  # a retried task writes the same files again
                    f.write(content)
            yield pdf[["path"]]

    return files.select("path", "content").mapInPandas(write, "path string").count()

"""Tables that cut lineage: Parquet in the shared folder that the session names in spark.checkpoint.dir.

All of a process's tables lie in one folder of its own. Tables that no later plan reads can be discarded at once; the
others, which a result may still be read from, go with clear(), and at the end of the process.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_OWN = f"tessella-{uuid.uuid4().hex[:12]}"
#: This process's folders, and the process that made them.
_folders: dict[str, SparkSession] = {}
_process = os.getpid()


def clear() -> None:
    """Remove all scratch tables of this process: results that haven't been read yet can't be read any more."""
    if os.getpid() != _process:
        return
    for folder, spark in list(_folders.items()):
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except (Py4JError, OSError):
            continue  # the session's JVM has ended
        del _folders[folder]


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A new folder path below the shared folder that the session names in spark.checkpoint.dir.

    Where that is unset and driver and tasks are one process (tests, a single machine), a temporary
    folder is made once and named there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessella-scratch-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/{_OWN}"
    if not _folders:
        atexit.register(clear)
    _folders[folder] = spark
    return f"{folder}/{what}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = scratch_dir(spark, what)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove the files of tables made by written(); only for tables that no later plan reads."""
    for df in tables:
        if df is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""A sink for server-sent events, and streamed completions as a table function.

`sse` is a data source that only writes: rows (request_id, i, kind, payload) become one file for each task and request
log, whose names the commit of a batch makes known. A task writes to a name that no reader looks at; what a failed task
or an aborted batch has written is removed or stays unseen, and a batch that is committed again writes the same names.
The folder must be on a file system that all executors mount.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from tessella.streaming.sse import DONE, PREFIX

ROWS = "request_id string, i bigint, kind string, payload string"
LEDGER = "_batches"


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


def event(kind: str, payload: str | None) -> str:
    """One event as sse.encode() writes it."""
    if kind == "done":
        return f"{PREFIX}{DONE}\n\n"
    body = ("null" if payload is None else payload) if kind == "result" else json.dumps(payload, ensure_ascii=False)
    return f'{PREFIX}{{"{kind}":{body}}}\n\n'


class _Files:
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def put(self, rows: Iterator[Row]) -> _Written:
        """A task's rows, written to a file of its own; lines are JSON with the event's text."""
        name = f"{TaskContext.get().partitionId():05}-{uuid.uuid4().hex}"
        os.makedirs(self.folder, exist_ok=True)
        hidden = os.path.join(self.folder, "." + name)
        try:
            with open(hidden, "w", encoding="utf-8") as f:
                for r in rows:
                    f.write(json.dumps({"request_id": r.request_id, "i": r.i, "event": event(r.kind, r.payload)}, ensure_ascii=False) + "\n")
        except BaseException:
            if os.path.exists(hidden):
                os.unlink(hidden)
            raise
        return _Written([name])

    def publish(self, messages: Iterable[_Written | None], batch: int) -> None:
        """Make the files known, all at once: a batch's list is put in its place by one rename."""
        names = sorted(n for m in messages if m is not None for n in m.names)
        for name in names:
            os.rename(os.path.join(self.folder, "." + name), os.path.join(self.folder, name + ".jsonl"))
        os.makedirs(os.path.join(self.folder, LEDGER), exist_ok=True)
        at = os.path.join(self.folder, LEDGER, str(batch))
        with open(at + ".new", "w", encoding="utf-8") as f:
            json.dump([n + ".jsonl" for n in names], f)
        os.replace(at + ".new", at)

    def drop(self, messages: Iterable[_Written | None]) -> None:
        for name in (n for m in messages if m is not None for n in m.names):
            for path in ("." + name, name + ".jsonl"):
                if os.path.exists(os.path.join(self.folder, path)):
                    os.unlink(os.path.join(self.folder, path))


class _StreamWriter(_Files, DataSourceStreamWriter):
    def write(self, iterator: Iterator[Row]) -> _Written:
        return self.put(iterator)

    def commit(self, messages: list[_Written | None], batchId: int) -> None:
        self.publish(messages, batchId)

    def abort(self, messages: list[_Written | None], batchId: int) -> None:
        self.drop(messages)


class _BatchWriter(_Files, DataSourceWriter):
    def write(self, iterator: Iterator[Row]) -> _Written:
        return self.put(iterator)

    def commit(self, messages: list[_Written | None]) -> None:
        known = os.path.join(self.folder, LEDGER)
        taken = [int(n) for n in os.listdir(known) if n.isdigit()] if os.path.isdir(known) else []
        self.publish(messages, max(taken, default=-1) + 1)

    def abort(self, messages: list[_Written | None]) -> None:
        self.drop(messages)


class EventSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return ROWS

    def streamWriter(self, schema, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _BatchWriter:
        return _BatchWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventSink)


def rows(events: DataFrame) -> DataFrame:
    """events (request_id, i, kind, payload) with the types that the sink takes."""
    return events.select(F.col("request_id").cast("string"), F.col("i").cast("bigint"), "kind", F.col("payload").cast("string"))


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """request_id, i, event of the batches that are committed. A batch has one file for each task."""
    names = []
    known = os.path.join(folder, LEDGER)
    for batch in sorted(os.listdir(known)) if os.path.isdir(known) else ():
        if batch.isdigit():
            with open(os.path.join(known, batch), encoding="utf-8") as f:
                names += json.load(f)
    schema = "request_id string, i bigint, event string"
    return spark.read.schema(schema).json([f"file://{os.path.join(folder, n)}" for n in names]) if names else spark.createDataFrame([], schema)

"""Text completion through a pluggable function, once for each distinct key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

Completer = Callable[[str], str]
Streamer = Callable[[str], Iterable[str]]
#: Chunks that a task holds before it passes them on.
BATCH = 1000


def stub(prompt: str) -> str:
    """A deterministic completer for tests and offline runs: annotates the first line."""
    return '[{"line_start": 1, "line_end": 1, "annotation": "%d characters"}]' % len(prompt)


def stub_overview(prompt: str) -> Iterator[str]:
    """A deterministic streamer: an overview object in three chunks, or plain words for prompts without a README."""
    if "README" in prompt:
        yield from ('{"summary": "', f"{len(prompt)} characters", '"}')
    else:
        yield from ("no ", "JSON")


def stream(rows: DataFrame, streamer: Streamer = stub_overview, key: str = "key", prompt: str = "prompt") -> DataFrame:
    """key, seq, chunk, error of each distinct key's streamed completion; empty chunks are left out.

    A failure ends the key's chunks with a row whose error says how. Tasks pass chunks on as they come.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        show = lambda: pd.DataFrame(out, columns=["key", "seq", "chunk", "error"]).astype({"seq": "int64"})
        for pdf in batches:
            for k, p in zip(pdf["key"], pdf["prompt"]):
                seq = 0
                try:
                    for chunk in streamer(p):
                        if chunk:
                            out.append((k, seq, chunk, None))
                            seq += 1
                        if len(out) >= BATCH:
                            yield show()
                            out = []
                except Exception as e:  # the provider may fail in any way; the row says how
                    out.append((k, seq, None, f"{type(e).__name__}: {e}"))
        if out:
            yield show()

    once = rows.groupBy(F.col(key).alias("key")).agg(F.min(prompt).alias("prompt"))
    return once.mapInPandas(run, "key string, seq long, chunk string, error string")


def complete(rows: DataFrame, completer: Completer = stub, key: str = "key", prompt: str = "prompt") -> DataFrame:
    """rows with `response` and `error`. Equal keys are completed once; a failure is data, not text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, p in zip(pdf["key"], pdf["prompt"]):
                try:
                    out.append((k, completer(p), None))
                except Exception as e:  # the provider may fail in any way; the row says how
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["key", "response", "error"])

    once = rows.groupBy(F.col(key).alias("key")).agg(F.min(prompt).alias("prompt"))
    answers = once.mapInPandas(run, "key string, response string, error string")
    return rows.join(answers.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left").drop("_key")


def register_stream(spark: SparkSession, name: str = "stream_completion", streamer: Streamer = stub_overview) -> None:
    """Make streamed completion a table function of SQL: `SELECT * FROM name(TABLE(t) PARTITION BY key ORDER BY prompt)`.

    t has key and prompt (and may have other columns); the result is key, seq, chunk, error as in stream(). The rows of a
    key are one completion, of its first prompt; a key's chunks are passed on as they come. A null prompt has no chunks.
    """

    class Stream:
        def __init__(self):
            self.asked = False

        def eval(self, row: Row):
            if self.asked or row["prompt"] is None:
                return
            self.asked, seq = True, 0
            try:
                for chunk in streamer(row["prompt"]):
                    if chunk:
                        yield row["key"], seq, chunk, None
                        seq += 1
            except Exception as e:  # the provider may fail in any way; the row says how
                yield row["key"], seq, None, f"{type(e).__name__}: {e}"

    spark.udtf.register(name, F.udtf(Stream, returnType="key string, seq bigint, chunk string, error string"))

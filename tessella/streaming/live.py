"""Replays as requests come: keyed state that grows with what is open, not with what has passed.

* assemble: a request's chunks go to a list that a batch only appends to; it is read once, at the end.
* hits: of each key, until when its entry is live; forgotten when the watermark has passed that.
* quota: of each client, the countable requests of its days, read and written as one value; days that the watermark has
  passed are forgotten when the client comes again, at the latest when it has passed the client's last day.

Within a batch rows of a key are taken by time and id, batches as they come. Rows behind the watermark that earlier
batches have set are left out. State is kept in RocksDB, which the functions' queries need: see rocksdb().
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.functions import values as v
from tessella.operators.cache import micros
from tessella.streaming.sse import REMEMBERED

DAY_MS = 86_400_000


@contextmanager
def rocksdb(spark: SparkSession, count_rows: bool = False) -> Iterator[None]:
    """Queries started within keep their state in RocksDB; keys are counted only if asked for, as that reads what is appended to."""
    own = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": str(count_rows).lower(),
    }
    before = {k: spark.conf.get(k, None) for k in own}
    for k, value in own.items():
        spark.conf.set(k, value)
    try:
        yield
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


class _Assembly(StatefulProcessor):
    def __init__(self, remembered: int | None):
        self.remembered = remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "seq long, chunk string")
        self.ended = handle.getValueState("ended", "ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.remembered:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.remembered)
        if self.ended.exists():
            return
        new, last = [], False
        for pdf in rows:
            last |= bool(pdf["done"].eq(True).any())
            new += [(int(s), c) for s, c in zip(pdf["seq"], pdf["chunk"]) if c]  # empty deltas are not passed on
        if not last:
            if new:
                self.chunks.appendList(new)
            return
        parts = sorted([*self.chunks.get(), *new], key=lambda x: x[0])
        self.chunks.clear()
        self.ended.update((True,))
        yield pd.DataFrame({"request_id": [key[0]], "response": ["".join(c for _, c in parts)], "chunks": [len(parts)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.chunks.clear()
        self.ended.clear()
        return iter(())

    def close(self) -> None:
        pass


def assemble(chunks: DataFrame, remembered: int | None = REMEMBERED) -> DataFrame:
    """Streaming rows (request_id, seq, chunk, done) into request_id, response, chunks of each request that has ended.

    As sse.assemble_stream: rows behind the end are left out, and a request of which nothing has come for `remembered`
    milliseconds is forgotten (None: never, for triggers that end by themselves). A batch writes its own chunks only.
    """
    kind = chunks.schema["request_id"].dataType.simpleString()
    rows = chunks.select("request_id", "seq", "chunk", "done").groupBy("request_id")
    return rows.transformWithStateInPandas(_Assembly(remembered), f"request_id {kind}, response string, chunks long", "Append", "ProcessingTime" if remembered else "None")


def _ordered(rows: Iterator[pd.DataFrame], watermark: int) -> pd.DataFrame:
    """A key's rows of a batch in order, without those behind the watermark (in milliseconds)."""
    pdfs = list(rows)
    pdf = pdfs[0] if len(pdfs) == 1 else pd.concat(pdfs)
    if len(pdf) == 1 and pdf["at"].iat[0] >= watermark * 1000:
        return pdf
    pdf = pdf[pdf["at"] >= watermark * 1000]
    return pdf.sort_values(["at", "tie"], kind="stable")


class _Hits(StatefulProcessor):
    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, timerValues.getCurrentWatermarkInMs())
        at, n, a = pdf["at"].to_numpy(np.int64), len(pdf), 0
        hit = np.zeros(n, bool)
        if key[0] is not None and not (isinstance(key[0], float) and np.isnan(key[0])):  # a null key is never stored
            before = until = self.until.get()[0] if self.until.exists() else None
            while a < n:
                if until is not None:
                    to = a + int(np.searchsorted(at[a:], until, "right"))
                    hit[a:to] = True
                    a = to
                if a < n:
                    until = int(at[a]) + self.ttl
                    a += 1
            if until != before:
                self.until.update((until,))
                self.handle.registerTimer(until // 1000 + 1)
        yield pd.DataFrame({"tie": pdf["tie"], "hit": hit})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Of an entry made anew since, the timer is another one.
        if self.until.exists() and self.until.get()[0] // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def hits(requests: DataFrame, key: str = "key", at: str = "ts", tie: str = "event_id", ttl: int = v.CACHE_TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Streaming requests into tie, hit: what cache.ttl_replay says of them, if their batches come in order of time.

    Requests that are more than `late` behind the latest one of an earlier batch have no result.
    """
    rows = requests.select(F.col(key).alias("key"), micros(at).alias("at"), F.col(tie).alias("tie"), F.col(at).cast("timestamp").alias("time")).withWatermark("time", late)
    kind = rows.schema["tie"].dataType.simpleString()
    out = rows.groupBy("key").transformWithStateInPandas(_Hits(ttl * 1_000_000), f"tie {kind}, hit boolean", "Append", "EventTime")
    return out.withColumnRenamed("tie", tie)


class _Quota(StatefulProcessor):
    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getValueState("days", "day array<long>, requests array<long>")

    def _known(self) -> dict[int, int]:
        return dict(zip(*self.days.get())) if self.days.exists() else {}

    def _keep(self, known: dict[int, int], before: int) -> None:
        """Keeps the days that end behind a time (in milliseconds)."""
        left = {d: n for d, n in known.items() if (d + 1) * DAY_MS > before}
        self.days.update((list(left), list(left.values()))) if left else self.days.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        pdf = _ordered(rows, watermark)
        day, countable = pdf["day"].to_numpy(np.int64), ~pdf["free"].to_numpy(bool)
        known = self._known()
        first = np.flatnonzero(np.diff(day, prepend=day[:1] - 1))  # days come in order, as times do
        size = np.diff(np.append(first, len(day)))
        counted = np.cumsum(countable) - countable
        start = np.array([known.get(d, 0) for d in day[first].tolist()], np.int64)
        before = counted + np.repeat(start - counted[first], size)
        last = max(known, default=None)
        if countable.any():
            for d, n in zip(day[first].tolist(), np.add.reduceat(countable, first, dtype=np.int64).tolist()):
                if n:
                    known[d] = known.get(d, 0) + n
            self._keep(known, watermark)
            if max(known) != last:
                self.handle.registerTimer((max(known) + 1) * DAY_MS)
        left = np.maximum(self.limit - before, 0)
        yield pd.DataFrame({"tie": pdf["tie"], "allowed": ~countable | (left > 0), "remaining": left})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._known(), expiredTimerInfo.getExpiryTimeInMs())
        return iter(())

    def close(self) -> None:
        pass


def quota(requests: DataFrame, client: str = "client", at: str = "ts", tie: str = "event_id", exempt: Column | None = None, limit: int = v.DAILY_QUOTA, late: str = "10 minutes") -> DataFrame:
    """Streaming requests into tie, allowed, remaining: what cache.quota says of them, if their batches come in order of time.

    Days are those of UTC. Denied requests count as in cache.quota, where they come after the last allowed one anyway.
    Requests that are more than `late` behind the latest one of an earlier batch have no result.
    """
    free = F.coalesce(exempt, F.lit(False)) if exempt is not None else F.lit(False)
    day = F.floor(micros(at) / F.lit(DAY_MS * 1000)).cast("long")
    rows = requests.select(F.col(client).alias("client"), micros(at).alias("at"), day.alias("day"), F.col(tie).alias("tie"), free.alias("free"), F.col(at).cast("timestamp").alias("time")).withWatermark("time", late)
    kind = rows.schema["tie"].dataType.simpleString()
    out = rows.groupBy("client").transformWithStateInPandas(_Quota(limit), f"tie {kind}, allowed boolean, remaining long", "Append", "EventTime")
    return out.withColumnRenamed("tie", tie)

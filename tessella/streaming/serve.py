"""Flows over a stream: every batch sees the entries and counters of those before it, exactly once.

A batch writes its answers, entries and counters to folders of its own, named by its number, and then its number to
the ledger. What isn't in the ledger doesn't count: a batch that failed on its way is done again from the same state,
over what it had written, and one that is in the ledger is passed over when it comes again. From time to time a batch
also writes what is still of use of all entries and counters before it, so that later ones read that instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.functions import values as v
from tessella.operators import cache, replay
from tessella.operators.flows import Flow

#: A judge takes (batch, cached, used) and gives a Flow.
Judge = Callable[[DataFrame, DataFrame, DataFrame], Flow]
ENTRIES, COUNTS = "key string, value string, created_at timestamp", "client {client}, day date, requests long"
#: Batches after which entries and counters are put together.
TOGETHER = 50


class Stores:
    """The entries, counters, answers and ledger of a stream, as Parquet below a folder that executors share."""

    def __init__(self, spark: SparkSession, folder: str, client: str = "long", ttl: int = v.CACHE_TTL_SECONDS, together: int = TOGETHER):
        self.spark, self.folder, self.ttl, self.together = spark, folder.rstrip("/"), ttl, together
        self.counts = COUNTS.format(client=client)

    def _there(self, path: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, what: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{what}"
        if not self._there(path):
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.schema(f"{schema}, batch int").parquet(path)

    def done(self, batch: int) -> bool:
        return self._there(f"{self.folder}/ledger/batch={batch}/_SUCCESS")

    def _since(self, what: str, schema: str, before: int, anew: bool) -> DataFrame:
        """What batches before this one wrote; of those that were put together, that (anew: but not by the last of them)."""
        base = max(range(self.together - 1, before - anew, self.together), default=-1)
        own = self._read(what, schema).filter(F.col("batch").between(base + 1, before - 1))
        return own if base < 0 else own.unionByName(self._read(f"{what}-together", schema).filter(F.col("batch") == base))

    def entries(self, before: int, anew: bool = False) -> DataFrame:
        """key, value, created_at as they were before a batch: of each key what was written last."""
        last = F.max_by(F.struct("value", "created_at"), F.struct("batch", "created_at"))
        return self._since("entries", ENTRIES, before, anew).groupBy("key").agg(last.alias("e")).select("key", "e.*")

    def used(self, before: int, anew: bool = False) -> DataFrame:
        """client, day, requests as they were before a batch."""
        return self._since("counts", self.counts, before, anew).groupBy("client", "day").agg(F.sum("requests").alias("requests"))

    def answers(self) -> DataFrame:
        """The answers of all batches in the ledger, with the batch."""
        ledger = self._read("ledger", "latest timestamp").select("batch").distinct()
        return self.spark.read.option("basePath", f"{self.folder}/answers").parquet(f"{self.folder}/answers/batch=*").join(F.broadcast(ledger), "batch", "left_semi")

    def write(self, batch: int, flow: Flow, latest) -> None:
        for what, rows in (("answers", flow.answers), ("entries", flow.entries), ("counts", flow.counts)):
            rows.write.mode("overwrite").parquet(f"{self.folder}/{what}/batch={batch}")
        if (batch + 1) % self.together == 0:
            now = F.lit(latest).cast("timestamp")
            kept = {"entries": self.entries(batch + 1, anew=True).filter(cache.is_live("created_at", now, self.ttl)), "counts": self.used(batch + 1, anew=True).filter(F.col("day") >= F.date_sub(now.cast("date"), 1))}
            for what, rows in kept.items():
                rows.write.mode("overwrite").parquet(f"{self.folder}/{what}-together/batch={batch}")
        self.spark.range(1).select(F.lit(latest).cast("timestamp").alias("latest")).write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")


def serve(requests: DataFrame, judge: Judge, stores: Stores, checkpoint: str, at: str = "ts", **trigger) -> StreamingQuery:
    """Start a query that judges each batch of a stream of requests by the entries and counters of those before it.

    A request's time decides on entries and days. When entries and counters are put together, entries that aren't
    live at the latest request of that batch go, and counters of days before the day before it: a request that comes
    later than that finds neither.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if stores.done(number):
            return
        latest = rows.agg(F.max(at)).first()[0]
        stores.write(number, judge(rows, stores.entries(number), stores.used(number)), latest)

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def replay_judge(key: str, client: str, at: str = "ts", tie: str = "event_id", exempt=None, accepted=None, limit: int = v.DAILY_QUOTA, ttl: int = v.CACHE_TTL_SECONDS, alone: int = replay.ALONE) -> Judge:
    """A judge that replays a log: its answers are tie, hit, allowed, remaining; entries have the tie as value."""

    def judge(rows: DataFrame, cached: DataFrame, used: DataFrame) -> Flow:
        verdict = replay.replay(rows, key, client, at, tie, exempt, accepted, limit, ttl, cached, used, alone)
        ok = F.coalesce(accepted, F.lit(False)) if accepted is not None else F.lit(True)
        free = F.coalesce(exempt, F.lit(False)) if exempt is not None else F.lit(False)
        misses = rows.join(verdict, tie).filter(F.col("allowed") & ~F.col("hit"))
        stored = misses.filter(ok & F.col(key).isNotNull())
        entries = cache.upsert(stored.withColumn("_value", F.col(tie).cast("string")), key, "_value", at, tie)
        return Flow(verdict, entries, cache.quota_counts(misses.filter(~free), client, at))

    return judge

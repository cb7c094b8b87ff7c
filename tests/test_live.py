"""Live replays as streams run to their end, against their batch forms."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import cache
from tessella.scratch import scratch_dir
from tessella.streaming import live

START = dt.datetime(2024, 3, 1)


def stream(spark, parts, schema, make, count_rows=False):
    """The rows that make(stream) gives for parts that come as a batch each, and the query's progress."""
    source, out = scratch_dir(spark, "source"), scratch_dir(spark, "out")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    with live.rocksdb(spark, count_rows):
        query = make(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_dir(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).collect(), [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]


def test_assembly(spark):
    parts = [
        [("a", 1, "he", False), ("b", 1, "x", False), ("a", 0, "> ", False)],
        [("a", 2, "", False), ("a", 3, "llo", False), ("c", 1, None, True)],
        [("a", 5, "!", True), ("a", 4, " you", False)],
        [("a", 6, "late", False), ("b", 2, "y", None), ("a", 9, None, True)],
        [("b", 3, "z", True)],
    ]
    got, progress = stream(spark, parts, "request_id string, seq long, chunk string, done boolean", lambda s: live.assemble(s, remembered=None))
    assert sorted(map(tuple, got)) == [("a", "> hello you!", 5), ("b", "xyz", 3), ("c", "", 0)]


def test_assembly_writes_each_chunk_once(spark):
    """The bytes written to the store don't grow with what has come before."""
    parts = [[("a", 100 * b + i, "x" * 2000, b == 11 and i == 99) for i in range(100)] for b in range(12)]
    got, progress = stream(spark, parts, "request_id string, seq long, chunk string, done boolean", lambda s: live.assemble(s, remembered=None))
    assert [(r.request_id, len(r.response), r.chunks) for r in got] == [("a", 12 * 100 * 2000, 1200)]
    metrics = [p["stateOperators"][0]["customMetrics"] for p in progress if p["numInputRows"]]
    for what, slack in (("rocksdbTotalBytesWritten", 20_000), ("rocksdbTotalBytesRead", 20_000)):
        assert max(m[what] for m in metrics[1:-1]) < metrics[1][what] + slack, what


def log(n, seed, keys, span):
    rng = random.Random(seed)
    rows = [(i, START + dt.timedelta(seconds=rng.randrange(span)), rng.choice([f"k{rng.randrange(keys)}", "hot", None]), rng.random() < 0.2) for i in range(n)]
    return sorted(rows, key=lambda r: (r[1], r[0]))


SCHEMA = "event_id long, ts timestamp, key string, free boolean"


@pytest.mark.parametrize("ttl", [900, 40_000])
def test_hits_equal_the_replay(spark, ttl):
    rows = log(600, 1, 20, 400_000)
    got, progress = stream(spark, [rows[i : i + 120] for i in range(0, 600, 120)], SCHEMA, lambda s: live.hits(s, ttl=ttl), True)
    want = cache.ttl_replay(spark.createDataFrame(rows, SCHEMA), ttl=ttl).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    if ttl == 900:  # entries that the watermark has passed are gone
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
        assert kept[-1] < 20


def test_late_requests_have_no_result(spark):
    first = [(1, START + dt.timedelta(days=3), "a", False)]
    late = [(2, START, "a", False), (3, START + dt.timedelta(days=3, seconds=5), "a", False), (4, START + dt.timedelta(days=3, seconds=-100), "a", False)]
    got, _ = stream(spark, [first, late], SCHEMA, lambda s: live.hits(s, ttl=60))
    assert sorted(map(tuple, got)) == [(1, False), (3, True), (4, True)]
    got, _ = stream(spark, [first, late], SCHEMA, lambda s: live.quota(s, client="key", limit=1))
    assert sorted(r.event_id for r in got) == [1, 3, 4]


def test_quota_equals_the_window(spark):
    rows = log(500, 2, 6, 500_000)
    got, progress = stream(spark, [rows[i : i + 100] for i in range(0, 500, 100)], SCHEMA, lambda s: live.quota(s, client="key", exempt=F.col("free"), limit=4), True)
    want = cache.quota(spark.createDataFrame(rows, SCHEMA), client="key", exempt=F.col("free"), limit=4).select("event_id", "allowed", "remaining").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert kept[-1] <= 8 * 4  # of eight clients, the latest days and their timers


def test_quota_keeps_a_row_for_a_client(spark):
    """However many days a batch has, a client's counters are one value and one timer."""
    rows = [(40 * k + i, START + dt.timedelta(days=i % 20, seconds=i), f"k{k}", False) for k in range(3) for i in range(40)]
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    got, progress = stream(spark, [rows], SCHEMA, lambda s: live.quota(s, client="key", limit=1), True)
    assert sorted(r.remaining for r in got) == [0] * 60 + [1] * 60
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) <= 3 * 3

"""Flows over streams: batches see those before them, and a batch that comes again changes nothing."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_replay import START, serial

from tessella.operators import flows, keys, scan
from tessella.scratch import scratch_dir
from tessella.streaming import serve

LOG = "event_id long, ts timestamp, key string, client string, own boolean, ok boolean"


def parts(n=240, seed=3):
    rng = random.Random(seed)
    log = sorted(((i, rng.randrange(250_000), f"k{rng.randrange(9)}", f"c{rng.randrange(4)}", rng.random() < 0.1, rng.random() < 0.9) for i in range(n)), key=lambda r: (r[1], r[0]))
    return log, [log[i : i + n // 4] for i in range(0, n, n // 4)]


def to_rows(part):
    return [(i, START + dt.timedelta(seconds=s), k, c, e, a) for i, s, k, c, e, a in part]


def started(spark, source, stores, checkpoint, judge):
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
    query = serve.serve(stream, judge, stores, checkpoint, availableNow=True)
    query.awaitTermination()
    return query


def write(spark, part, source):
    spark.createDataFrame(to_rows(part), LOG).coalesce(1).write.mode("append").parquet(source)


def test_batches_equal_one_replay_and_come_once(spark):
    log, batches = parts()
    want, _, _ = serial(log, 2, 30_000)
    source, folder, checkpoint = (scratch_dir(spark, x) for x in ("log", "stores", "progress"))
    judge = serve.replay_judge("key", "client", exempt=F.col("own"), accepted=F.col("ok"), limit=2, ttl=30_000)
    stores = serve.Stores(spark, folder, "string", ttl=30_000, together=3)
    for part in batches[:3]:
        write(spark, part, source)
    started(spark, source, stores, checkpoint, judge)
    tell = lambda: sorted((r.event_id, r.hit, r.allowed, r.remaining) for r in stores.answers().collect())
    first = tell()
    assert first == [x for x in want if x[0] in {r[0] for part in batches[:3] for r in part}]
    before = [sorted(map(tuple, df.collect()), key=str) for df in (stores.entries(2), stores.used(2))]
    # The same batch again: passed over as it is in the ledger; and done again if it failed before it got there.
    again = spark.createDataFrame(to_rows(batches[2]), LOG)
    calls = []
    flow = judge(again, stores.entries(2), stores.used(2))
    stores.write(2, flow, max(r.ts for r in again.collect()))
    assert tell() == first and [sorted(map(tuple, df.collect()), key=str) for df in (stores.entries(2), stores.used(2))] == before
    started(spark, source, stores, scratch_dir(spark, "progress"), lambda *a: calls.append(a))
    assert not calls and tell() == first
    # The stream goes on where it was, from what was put together.
    write(spark, batches[3], source)
    started(spark, source, stores, checkpoint, judge)
    assert tell() == want


def test_a_batch_that_fails_leaves_nothing(spark):
    log, batches = parts(80, 5)
    source, folder, checkpoint = (scratch_dir(spark, x) for x in ("log", "stores", "progress"))
    stores = serve.Stores(spark, folder, "string", ttl=30_000)
    judge = serve.replay_judge("key", "client", exempt=F.col("own"), accepted=F.col("ok"), limit=2, ttl=30_000)
    write(spark, batches[0], source)
    started(spark, source, stores, checkpoint, judge)
    state = [sorted(map(tuple, df.collect()), key=str) for df in (stores.answers(), stores.entries(1), stores.used(1))]

    def failing(*given):
        flow = judge(*given)
        flow.entries.write.mode("overwrite").parquet(f"{folder}/entries/batch=1")
        raise RuntimeError("lost")

    write(spark, batches[1], source)
    with pytest.raises(Exception, match="lost"):
        started(spark, source, stores, checkpoint, failing)
    assert [sorted(map(tuple, df.collect()), key=str) for df in (stores.answers(), stores.entries(1), stores.used(1))] == state
    started(spark, source, stores, checkpoint, judge)
    want, _, _ = serial(batches[0] + batches[1], 2, 30_000)
    assert sorted((r.event_id, r.hit, r.allowed, r.remaining) for r in stores.answers().collect()) == want


def test_serial_flows(spark):
    files = scan.rank(scan.scan_upload(spark.createDataFrame([("p", 1, "a.py", "x = 1"), ("q", 1, "README.md", "y"), ("r", 1, "README.md", "zz")], "project string, ord long, path string, content string")))
    at = lambda s: START + dt.timedelta(seconds=s)
    # One request a day: q and r have a result, p (without README) has none.
    rows = [(1, at(0), "x", False, "p"), (2, at(1), "y", False, "p"), (3, at(2), "x", False, "q"), (4, at(3), "z", False, "q"), (5, at(4), "x", False, "q"), (6, at(5), "y", False, "r"), (7, at(6), "w", True, "r"), (8, at(7), "y", False, "r"), (9, at(8), "v", False, "nowhere")]
    asked = spark.createDataFrame(rows, "request_id long, ts timestamp, client string, own_key boolean, project string").withColumns({"cache_key": F.lit("?"), "value": F.lit(1), "created_at": F.lit(2)})
    cached = spark.createDataFrame([], "key string, value string, created_at timestamp")
    flow = flows.overview(asked, files, cached, limit=1, serial=True)
    got = {}
    for r in flow.answers.collect():
        got.setdefault(r.request_id, [r.status, set()])[1].add(r.kind)
    told, hit = {"chunk", "result", "done"}, {"result", "done"}
    assert got == {1: [200, {"chunk", "raw", "done"}], 2: [200, {"chunk", "raw", "done"}], 3: [429, {"status"}], 4: [200, told], 5: [200, hit], 6: [429, {"status"}], 7: [200, told], 8: [200, hit], 9: [404, {"status"}]}
    entries = {r.key: r.created_at for r in flow.entries.collect()}
    by = {r.project: r.cache_key for r in keys.overview_keys(files).collect()}
    assert entries == {by["q"]: at(3), by["r"]: at(6)}
    assert sorted((r.client, r.requests) for r in flow.counts.collect()) == [("x", 1), ("y", 1), ("z", 1)]


def test_serial_annotations(spark):
    u = spark.createDataFrame([("p", 1, "a.py", "x = 1"), ("p", 2, "b.py", "x = 2")], "project string, ord long, path string, content string")
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [(1, at(0), "x", False, "p", "a.py"), (2, at(1), "x", False, "p", "a.py"), (3, at(2), "x", False, "p", "b.py"), (4, at(3), "y", False, "p", "b.py"), (5, at(4), "x", False, "p", "b.py"), (6, at(5), "x", True, "p", "c.py")]
    asked = spark.createDataFrame(rows, "request_id long, ts timestamp, client string, own_key boolean, project string, path string").withColumns({"language": F.lit("?"), "content": F.lit("?")})
    cached = spark.createDataFrame([], "key string, value string, created_at timestamp")
    flow = flows.annotate(asked, scan.contents(u), scan.scan_upload(u), cached, limit=1, serial=True)
    assert {r.request_id: (r.status, r.n_annotations) for r in flow.answers.collect()} == {1: (200, 1), 2: (200, 1), 3: (429, None), 4: (200, 1), 5: (200, 1), 6: (404, None)}
    assert sorted((r.client, r.requests) for r in flow.counts.collect()) == [("x", 1), ("y", 1)]

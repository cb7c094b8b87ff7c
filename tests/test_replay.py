"""The combined replay of cache and quota against one that goes through the log row by row."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import cache, replay

START = dt.datetime(2024, 3, 1)


def serial(log, limit, ttl, cached=(), used=()):
    """(id, hit, allowed, remaining) of rows (id, seconds, key, client, exempt, accepted), one after another."""
    entries, counts, out = dict(cached), dict(used), []
    for i, s, key, client, exempt, accepted in sorted(log, key=lambda r: (r[1], r[0])):
        day = s // 86400
        n = counts.get((client, day), 0)
        hit = key is not None and key in entries and s - entries[key] <= ttl
        allowed = hit or exempt or n < limit
        out.append((i, hit, allowed, max(0, limit - n)))
        if not hit and allowed:
            if not exempt:
                counts[client, day] = n + 1
            if accepted and key is not None:
                entries[key] = s
    return sorted(out), entries, counts


def frame(spark, log):
    rows = [(i, START + dt.timedelta(seconds=s), k, c, e, a) for i, s, k, c, e, a in log]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, key string, client string, own boolean, ok boolean")


def run(spark, log, limit, ttl, **state):
    out = replay.replay(frame(spark, log), exempt=F.col("own"), accepted=F.col("ok"), limit=limit, ttl=ttl, **state)
    return sorted((r.event_id, r.hit, r.allowed, r.remaining) for r in out.collect())


def test_a_denied_miss_makes_later_hits_misses(spark):
    log = [(1, 0, "a", "x", False, True), (2, 1, "b", "x", False, True), (3, 2, "b", "y", False, True), (4, 3, "b", "x", False, True), (5, 4, "c", "y", False, True), (6, 5, "c", "z", True, False), (7, 6, "c", "z", False, True)]
    got = {i: (hit, ok) for i, hit, ok, _ in run(spark, log, 1, 100, alone=0)}
    assert run(spark, log, 1, 100, alone=0) == run(spark, log, 1, 100)
    # 2 is denied, so 3 misses and stores, 4 hits; 5 is denied, 6 is exempt but has no result, 7 misses.
    assert got == {1: (False, True), 2: (False, False), 3: (False, True), 4: (True, True), 5: (False, False), 6: (False, True), 7: (False, True)}


@pytest.mark.parametrize(("seed", "limit", "ttl", "keys"), [(1, 1, 20_000, 6), (2, 2, 3000, 40), (3, 0, 5000, 5), (4, 3, 90_000, 200), (5, 1, 0, 3)])
def test_replay_equals_the_serial_one(spark, seed, limit, ttl, keys):
    rng = random.Random(seed)
    log = [(i, rng.randrange(300_000) // 50 * 50, rng.choice([f"k{rng.randrange(keys)}", "hot", "hot", None]), rng.choice([f"c{rng.randrange(9)}", "busy", None]), rng.random() < 0.1, rng.random() < 0.85) for i in range(900)]
    want, _, _ = serial(log, limit, ttl)
    assert run(spark, log, limit, ttl) == want
    if seed > 3:  # those that take few rounds
        assert run(spark, log, limit, ttl, alone=0) == want


def test_replay_goes_on_from_entries_and_counters(spark):
    rng = random.Random(9)
    log = sorted(((i, rng.randrange(250_000), f"k{rng.randrange(12)}", f"c{rng.randrange(4)}", False, rng.random() < 0.9) for i in range(600)), key=lambda r: (r[1], r[0]))
    first, second = log[:300], log[300:]
    want, _, _ = serial(log, 2, 30_000)
    _, entries, counts = serial(first, 2, 30_000)
    cached = spark.createDataFrame([(k, START + dt.timedelta(seconds=s)) for k, s in entries.items()], "key string, created_at timestamp")
    used = spark.createDataFrame([(c, (START + dt.timedelta(days=d)).date(), n) for (c, d), n in counts.items()], "client string, day date, requests long")
    assert sorted(run(spark, first, 2, 30_000) + run(spark, second, 2, 30_000, cached=cached, used=used)) == want
    few = run(spark, second[-40:], 2, 30_000, cached=cached, used=used)
    assert run(spark, second[-40:], 2, 30_000, cached=cached, used=used, alone=0) == few


def test_replay_of_nothing_and_of_clashing_names(spark):
    log = frame(spark, [(1, 0, "a", None, None, None), (1, 0, "a", None, None, None)])
    assert replay.replay(log.limit(0)).count() == 0
    more = log.withColumns({"row": F.lit(7), "hit": F.lit("x"), "day": F.lit(1), "created": F.lit(2), "stores": F.lit(3)})
    assert sorted(map(tuple, replay.replay(more, ttl=10).collect())) == [(1, False, True, 20), (1, True, True, 19)]
    alone = cache.ttl_replay(log, ttl=10)
    assert sorted(r.hit for r in alone.collect()) == [False, True]

"""One replay of quota and cache: a request log in order, where hits are free and denied misses store nothing.

Whether a request hits depends on which earlier misses of its key were allowed, and whether a miss is allowed on
which earlier requests of its client and day were misses. Both are settled by rounds: keys are replayed with what is
allowed so far, then clients with what hits so far, and again for the keys and client days that a change has touched,
until nothing changes. A round settles at least the earliest request that was wrong, so the rounds end, and where
nothing changes every request has been judged by right ones before it. Rounds after the first take only touched
keys and clients, whose rows are few where few are denied; there are as many as the longest chain of verdicts that
depend on each other. A log of at most ALONE rows is gone through row by row in one task, whose memory that bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import values as v
from tessella.operators.cache import micros
from tessella.scratch import discard, written


#: Rows of a log up to which one task goes through it.
ALONE = 200_000


def _serial(rows: DataFrame, ttl: int, limit: int) -> DataFrame:
    """row, hit, before, allowed of a bounded log, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        until: dict = {}
        counts: dict = {}
        for pdf in batches:
            out = []
            for row, key, client, day, at, free, stores, created, used in zip(*(pdf[c] for c in ("row", "key", "client", "day", "at", "free", "accepted", "created", "used"))):
                if key is not None and key not in until and created == created and created is not None:
                    until[key] = int(created) + ttl
                hit = key is not None and key in until and at <= until[key]
                own = (client, day)
                before = counts.get(own, 0 if used is None or used != used else int(used))
                allowed = hit or free or before < limit
                if not hit and not free:
                    counts[own] = before + 1  # denied ones as well: these only come when the quota is used up
                if not hit and allowed and stores:
                    until[key] = at + ttl
                out.append((row, hit, before, allowed))
            yield pd.DataFrame(out, columns=["row", "hit", "before", "allowed"])

    ordered = rows.select("row", "key", "client", "day", "at", "tie", "free", "accepted", "created", "used").coalesce(1).sortWithinPartitions("at", "tie", "row")
    return ordered.drop("tie").mapInPandas(run, "row long, hit boolean, before long, allowed boolean")


def _hits(rows: DataFrame, ttl: int) -> DataFrame:
    """row, hit of rows (row, key, at, tie, stores, created): each key in order, as a stream with one moment of state.

    A miss that stores makes an entry for ttl microseconds; created is the moment of the entry that the key had before.
    """

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, until = None, None
        for pdf in batches:
            keys, at, stores = pdf["key"].to_numpy(object), pdf["at"].to_numpy(np.int64), pdf["stores"].to_numpy(bool)
            n = len(keys)
            if not n:
                continue
            begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            end = np.append(begin[1:], n)
            hit = np.zeros(n, bool)
            source, created = np.flatnonzero(stores), pdf["created"].to_numpy(np.float64, na_value=np.nan)
            for a, b in zip(begin.tolist(), end.tolist()):
                if a or keys[0] != current:
                    until = None if np.isnan(created[a]) else int(created[a]) + ttl
                current = keys[a]
                while a < b:
                    if until is not None:
                        to = a + int(np.searchsorted(at[a:b], until, "right"))
                        hit[a:to] = True
                        a = to
                        until = until if a == b else None
                    else:  # the next miss that stores
                        k = int(np.searchsorted(source, a))
                        if k == len(source) or source[k] >= b:
                            break
                        a = int(source[k]) + 1
                        until = int(at[a - 1]) + ttl
            yield pd.DataFrame({"row": pdf["row"], "hit": hit})

    ordered = rows.select("row", "key", "at", "tie", "stores", "created").repartition("key").sortWithinPartitions("key", "at", "tie", "row")
    return ordered.mapInPandas(replay, "row long, hit boolean")


def _before(rows: DataFrame) -> Column:
    """Countable requests of the client and day before each row, those before the log included."""
    counted = F.when(F.col("free") | F.col("hit"), 0).otherwise(1)
    window = Window.partitionBy("client", "day").orderBy("at", "tie", "row").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(counted).over(window) - counted + F.coalesce("used", F.lit(0))


def replay(requests: DataFrame, key: str = "key", client: str = "client", at: str = "ts", tie: str = "event_id", exempt: Column | None = None, accepted: Column | None = None, limit: int = v.DAILY_QUOTA, ttl: int = v.CACHE_TTL_SECONDS, cached: DataFrame | None = None, used: DataFrame | None = None, alone: int = ALONE) -> DataFrame:
    """tie, hit, allowed, remaining of every request of a log, in order of time (then tie).

    A request whose key has a live entry hits, is free and allowed. Another is allowed if it is exempt or one of the
    first `limit` that its client makes on that day, hits and exempt ones not counted; remaining is what was left
    before it. An allowed miss makes an entry at its own time if its result is accepted; a denied one makes none.

    A null key is never stored. A null client is one client. Rows with equal time and tie are taken in any order, one
    after another. cached (key, created_at) and used (client, day, requests) are the entries and counters before the
    log; entries that aren't live at a request don't count for it. An empty log has no rows.
    """
    lasts = ttl * 1_000_000
    flag = lambda c, other: F.coalesce(c, F.lit(False)) if c is not None else F.lit(other)
    log = requests.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(client).alias("client"), F.to_date(F.col(at)).alias("day"), micros(at).alias("at"), F.col(tie).alias("tie"), flag(exempt, False).alias("free"), (flag(accepted, True) & F.col(key).isNotNull()).alias("accepted"))
    created = F.lit(None).cast("long")
    if cached is not None:
        log = log.join(cached.select(F.col("key").alias("_key"), micros("created_at").alias("created")), F.col("key") == F.col("_key"), "left").drop("_key")
    else:
        log = log.withColumn("created", created)
    if used is not None:
        past = used.select(F.col("client").alias("_client"), F.col("day").alias("_day"), F.col("requests").alias("used"))
        log = log.join(past, F.col("client").eqNullSafe(F.col("_client")) & (F.col("day") == F.col("_day")), "left").drop("_client", "_day")
    else:
        log = log.withColumn("used", F.lit(0).cast("long"))
    log = written(log, "log")

    shown = lambda df: df.select(F.col("tie").alias(tie), "hit", "allowed", F.greatest(F.lit(0), F.lit(limit) - F.col("before")).cast("long").alias("remaining"))
    if log.count() <= alone:
        return shown(log.select("row", "tie").join(_serial(log, lasts, limit), "row"))

    # The first round: every miss allowed, then the quota over what doesn't hit.
    hits = _hits(log.withColumn("stores", F.col("accepted")), lasts)
    state = log.join(hits, "row")
    state = written(state.withColumn("before", _before(state)), "judged").withColumn("allowed", F.col("free") | F.col("hit") | (F.col("before") < limit))
    touched = written(state.filter(~F.col("allowed") & F.col("accepted")).select("key").distinct(), "keys")
    changes: DataFrame | None = None  # row, hit, before, allowed of rows that differ from state
    names = ["row", "hit", "before", "allowed"]

    def current(rows: DataFrame) -> DataFrame:
        if changes is None:
            return rows
        new = changes.toDF("row", *(f"_{c}" for c in names[1:]))
        rows = rows.join(new, "row", "left")
        return rows.withColumns({c: F.coalesce(f"_{c}", c) for c in names[1:]}).drop(*(f"_{c}" for c in names[1:]))

    def merged(fresh: DataFrame) -> DataFrame:
        nonlocal changes
        rest = fresh if changes is None else fresh.unionByName(changes.join(fresh.select("row"), "row", "left_anti"))
        old, changes = changes, written(rest, "changes")
        discard(old)
        return changes

    while not touched.isEmpty():
        rows = current(state.join(touched, "key", "left_semi"))
        again = _hits(rows.withColumn("stores", F.col("accepted") & F.col("allowed")), lasts).withColumnRenamed("hit", "_hit")
        moved = written(rows.join(again, "row").filter(F.col("hit") != F.col("_hit")).withColumn("hit", F.col("_hit")).select("client", "day", *names), "moved")
        discard(touched)
        merged(moved.select(names))
        days = moved.select("client", "day").distinct()
        of = state["client"].eqNullSafe(days["client"]) & state["day"].eqNullSafe(days["day"])
        rows = current(state.join(days, of, "left_semi"))
        judged = rows.withColumn("_before", _before(rows)).withColumn("_allowed", F.col("free") | F.col("hit") | (F.col("_before") < limit))
        judged = written(judged.filter((F.col("before") != F.col("_before")) | (F.col("allowed") != F.col("_allowed"))).select("row", "key", "accepted", "hit", F.col("_before").alias("before"), F.col("_allowed").alias("allowed"), F.col("allowed").alias("_was")), "judged-again")
        discard(moved)
        merged(judged.select(names))
        touched = written(judged.filter((F.col("allowed") != F.col("_was")) & F.col("accepted")).select("key").distinct(), "keys")
        discard(judged)
    discard(touched, log)
    return shown(current(state))

"""Key-value caching with a time to live, and daily quotas, replayed over request logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import values as v


def micros(at: str | Column) -> Column:
    """Microseconds of a moment, with or without a time zone (then the session's)."""
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def is_live(created: str | Column, now: str | Column, ttl: int = v.CACHE_TTL_SECONDS) -> Column:
    """An entry exactly ttl seconds old still counts."""
    created, now = (F.col(x) if isinstance(x, str) else x for x in (created, now))
    return micros(now) - micros(created) <= ttl * 1_000_000


def has_result(value: str = "value") -> Column:
    """Empty objects, arrays, strings and nulls count as no result."""
    return F.col(value).isNotNull() & ~F.col(value).isin("{}", "[]", "null", '""', "0", "false", "")


def upsert(writes: DataFrame, key: str = "key", value: str = "value", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last write of each key: key, value, created_at. Combined before the shuffle."""
    last = F.max_by(F.struct(F.col(value).alias("value"), F.col(at).alias("created_at")), F.struct(at, tie))
    return writes.groupBy(F.col(key).alias("key")).agg(last.alias("last")).select("key", "last.value", "last.created_at")


def lookup(requests: DataFrame, cache: DataFrame, key: str = "key", at: str = "ts", ttl: int = v.CACHE_TTL_SECONDS) -> DataFrame:
    """requests with `value` and `hit`: found, alive at the request's time, and not an empty result.

    Columns of requests with these two names are replaced; all others stay as they are.
    """
    requests = requests.drop("value", "hit")
    taken = {c.lower() for c in requests.columns}
    own, value, created = (next(n for i in range(len(taken) + 1) if (n := "_" * i + c) not in taken) for c in ("entry_key", "entry_value", "entry_created"))
    entries = cache.select(F.col("key").alias(own), F.col("value").alias(value), F.col("created_at").alias(created))
    live = is_live(created, at, ttl) & has_result(value)
    joined = requests.join(entries, F.col(key) == F.col(own), "left")
    return joined.withColumns({"hit": F.coalesce(live, F.lit(False)), "value": F.when(live, F.col(value))}).drop(own, value, created)


def purge(cache: DataFrame, now: Column, ttl: int = v.CACHE_TTL_SECONDS) -> DataFrame:
    return cache.filter(is_live("created_at", now, ttl))


def ttl_replay(requests: DataFrame, key: str = "key", at: str = "ts", tie: str = "event_id", ttl: int = v.CACHE_TTL_SECONDS) -> DataFrame:
    """tie, hit of every request: a miss makes an entry that serves the key for ttl seconds; hits don't renew it.

    A null key is never stored, so its requests are misses. Requests are sorted by key and time within
    partitions and read as a stream with one moment of state, so a key of any size needs no more
    memory than a batch. Within a batch all keys go on from miss to miss at once.
    """
    rows = requests.select(F.col(key).alias("key"), micros(at).alias("at"), F.col(tie).alias("tie"))
    rows = rows.repartition("key").sortWithinPartitions("key", "at", "tie")
    kind = rows.schema["tie"].dataType.simpleString()
    lasts = ttl * 1_000_000

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, until = None, 0
        for pdf in batches:
            keys, at = pdf["key"].to_numpy(object), pdf["at"].to_numpy(np.int64)
            n = len(keys)
            first = np.ones(n, bool)
            first[1:] = keys[1:] != keys[:-1]
            hit = np.array([k is not None for k in keys])
            begin = np.flatnonzero(first)
            end = np.append(begin[1:], n)
            # Moments as whole numbers that grow over all runs of keys, so that one search serves every run.
            low = at.min(initial=0)
            span = int(at.max(initial=0) - low) + lasts + 2
            run = np.cumsum(first) - 1
            place = run.astype(object) * span + (at - low) if len(begin) * span > 1 << 62 else run * span + (at - low)
            to = begin.copy()  # in each run, the next request that no entry serves
            if n and keys[0] is not None and keys[0] == current:
                to[0] = np.searchsorted(at[: end[0]], until, "right")
            open_ = np.flatnonzero(to < end)
            while len(open_):
                miss = to[open_]
                hit[miss] = False
                to[open_] = np.searchsorted(place, place[miss] + lasts, "right")
                open_ = open_[(to[open_] < end[open_])]
            if n:
                missed = np.flatnonzero(~hit[begin[-1] :])
                if len(missed):
                    until = int(at[begin[-1] + missed[-1]]) + lasts
                current = keys[-1]
            yield pd.DataFrame({"tie": pdf["tie"], "hit": hit})

    return rows.mapInPandas(replay, f"tie {kind}, hit boolean").withColumnRenamed("tie", tie)


def quota(requests: DataFrame, client: str = "client", at: str = "ts", tie: str = "event_id", exempt: Column | None = None, limit: int = v.DAILY_QUOTA, used: DataFrame | None = None) -> DataFrame:
    """requests with `allowed` and `remaining` (before the request): the first `limit` of a client and day that are not exempt.

    used (client, day, requests) is the counter table so far.
    """
    free = F.coalesce(exempt if exempt is not None else F.lit(False), F.lit(False))
    day = F.to_date(F.col(at))
    counted = F.sum(F.when(free, 0).otherwise(1)).over(Window.partitionBy(client, day).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0))
    before = counted - F.when(free, 0).otherwise(1)
    if used is None:
        return requests.withColumns({"allowed": free | (before < limit), "remaining": F.greatest(F.lit(0), F.lit(limit) - before).cast("long")})
    past = used.select(F.col("client").alias("_client"), F.col("day").alias("_day"), F.col("requests").alias("_used"))
    counted = requests.withColumn("_before", before).join(past, (F.col(client) == F.col("_client")) & (day == F.col("_day")), "left")
    all_ = F.col("_before") + F.coalesce("_used", F.lit(0))
    return counted.withColumns({"allowed": free | (all_ < limit), "remaining": F.greatest(F.lit(0), F.lit(limit) - all_).cast("long")}).drop("_client", "_day", "_used", "_before")


def quota_counts(requests: DataFrame, client: str = "client", at: str = "ts") -> DataFrame:
    """client, day, requests: the counter table."""
    return requests.groupBy(F.col(client).alias("client"), F.to_date(F.col(at)).alias("day")).agg(F.count("*").alias("requests"))

"""Whole request flows: look up, admit, complete, parse, keep, and answer.

A flow takes a batch of requests against the cache and the counters as they stand. Requests of one batch are
concurrent, so that none sees what another of them stores, or else (serial) one after another by time and id, so
that each sees what those before it stored and used up. Equal keys are completed once. A flow's parts are
DataFrames: the answers, the entries to upsert, and the counters to add. Ids of requests are unique.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import jsonx
from tessella.functions import values as v
from tessella.operators import cache, completion, keys, prompts, replay, scan
from tessella.scratch import discard, written
from tessella.streaming import sse

#: The answers' states.
OK, MISSING, OVER_QUOTA = 200, 404, 429


class Flow(NamedTuple):
    answers: DataFrame
    entries: DataFrame
    counts: DataFrame


def admit(requests: DataFrame, cached: DataFrame, used: DataFrame | None = None, limit: int = v.DAILY_QUOTA, ttl: int = v.CACHE_TTL_SECONDS) -> DataFrame:
    """requests (request_id, ts, client, own_key, cache_key) with hit, value and status.

    A null cache_key means that there is nothing to answer about. Hits are free, as are requests with
    a key of their own; of the others the first `limit` of a client and day are admitted.
    """
    found = cache.lookup(requests, cached, key="cache_key", at="ts", ttl=ttl)
    free = F.col("own_key") | F.col("hit") | F.col("cache_key").isNull()
    judged = cache.quota(found, tie="request_id", exempt=free, limit=limit, used=used)
    status = F.when(F.col("cache_key").isNull(), MISSING).when(F.col("allowed"), OK).otherwise(OVER_QUOTA)
    return judged.withColumn("status", status).drop("allowed", "remaining")


def judge(asked: DataFrame, cached: DataFrame, complete: Callable[[DataFrame], DataFrame], used: DataFrame | None = None, limit: int = v.DAILY_QUOTA, ttl: int = v.CACHE_TTL_SECONDS) -> tuple[DataFrame, DataFrame]:
    """What admit() gives, of requests one after another; and the completions (key, accepted, value, ...) that they ask for.

    complete takes a table of keys. Which keys are asked for depends on which results are accepted, as these serve
    later requests: so a key's result counts as accepted until it is there, and the log is judged again with those
    that are, until no other key is asked for.
    """
    live = cached.filter(cache.has_result())
    found = cache.lookup(asked, live, key="cache_key", at="ts", ttl=ttl).withColumnsRenamed({"hit": "_live", "value": "_kept"})
    known: DataFrame | None = None
    while True:
        rows = found if known is None else found.join(known.select(F.col("key").alias("cache_key"), F.col("accepted").alias("_accepted")), "cache_key", "left")
        accepted = F.lit(True) if known is None else F.coalesce("_accepted", F.lit(True))
        free = F.coalesce("own_key", F.lit(False)) | F.col("cache_key").isNull()
        verdict = replay.replay(rows, "cache_key", "client", "ts", "request_id", free, accepted, limit, ttl, live, used)
        verdict = written(verdict.select("request_id", F.col("hit").alias("hit"), F.col("allowed").alias("_allowed")), "verdicts")
        todo = found.join(verdict, "request_id").filter(F.col("_allowed") & ~F.col("hit") & F.col("cache_key").isNotNull()).select(F.col("cache_key").alias("key")).distinct()
        todo = written(todo if known is None else todo.join(known.select("key"), "key", "left_anti"), "asked-keys")
        if known is not None and todo.isEmpty():
            break
        new = complete(todo)
        known = new if known is None else known.unionByName(new)
        if new.filter("accepted").count() == new.count():
            break  # as was assumed
        discard(todo)
    own = known.filter("accepted").select(F.col("key").alias("cache_key"), F.col("value").alias("_own"))
    status = F.when(F.col("cache_key").isNull(), MISSING).when(F.col("_allowed"), OK).otherwise(OVER_QUOTA)
    out = found.join(verdict, "request_id").join(own, "cache_key", "left").withColumn("status", status)
    value = F.when(F.col("_live"), F.col("_kept")).when(F.col("hit"), F.col("_own"))
    return written(out.withColumn("value", value).drop("_live", "_kept", "_own", "_allowed"), "admitted"), known


def _counts(admitted: DataFrame) -> DataFrame:
    counted = admitted.filter((F.col("status") == OK) & ~F.col("hit") & ~F.coalesce("own_key", F.lit(False)))
    return cache.quota_counts(counted)


def _asked(admitted: DataFrame) -> DataFrame:
    return admitted.filter((F.col("status") == OK) & ~F.col("hit"))


def _entries(parsed: DataFrame, admitted: DataFrame, serial: bool = False) -> DataFrame:
    """Results with the time of the first miss that asked for them; of misses one after another, the last."""
    first = _asked(admitted).groupBy(F.col("cache_key").alias("key")).agg((F.max if serial else F.min)("ts").alias("created_at"))
    return parsed.filter("accepted").select("key", "value").join(first, "key")


def cached_replay(admitted: DataFrame) -> DataFrame:
    """request_id, i, kind, payload of the hits: one result, then the end mark."""
    hits = admitted.filter("hit").select("request_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit("result").alias("kind"), F.col("value").alias("payload")), F.struct(F.lit(1).cast("long").alias("i"), F.lit("done").alias("kind"), F.lit(None).cast("string").alias("payload")))).alias("e"))
    return hits.select("request_id", "e.*")


def finish(chunks: DataFrame) -> DataFrame:
    """key, response, kind, payload, accepted, value, chunks of streamed completions (key, seq, chunk).

    The assembled text is parsed; an object that isn't empty is the result, any other text stays raw.
    """
    whole = chunks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk"))).alias("c"), F.max("seq").alias("last"))
    whole = whole.select("key", "last", F.array_join(F.transform("c", lambda x: x["chunk"]), "").alias("response"))
    parsed = whole.withColumn("found", jsonx.extract_json("response"))
    accepted = F.coalesce(jsonx.accepted_overview(F.col("found")), F.lit(False))
    parsed = parsed.select("key", "last", "response", accepted.alias("accepted"), F.col("found.value").alias("value"))
    return parsed.withColumns({"kind": F.when(F.col("accepted"), "result").otherwise("raw"), "payload": F.when(F.col("accepted"), F.col("value")).otherwise(F.col("response"))})


def overview(requests: DataFrame, files: DataFrame, cached: DataFrame, streamer: completion.Streamer = completion.stub_overview, used: DataFrame | None = None, limit: int = v.DAILY_QUOTA, ttl: int = v.CACHE_TTL_SECONDS, serial: bool = False) -> Flow:
    """Overviews of projects: requests (request_id, ts, client, own_key, project) over ranked files.

    Answers are events (request_id, status, i, kind, payload): of a hit its result and the end mark; of
    an admitted request its chunks, then result or raw, then the end mark; others have one row with
    kind `status`. Results are stored, raw texts aren't. Completions run once and are written.
    """
    requests = requests.select("request_id", "ts", "client", "own_key", "project")
    asked = requests.join(keys.overview_keys(files), "project", "left")
    parts: list[DataFrame] = []

    def complete(todo: DataFrame) -> DataFrame:
        pairs = asked.select("project", F.col("cache_key").alias("key")).distinct().join(todo, "key")
        parts.append(written(completion.stream(pairs.join(prompts.overview_prompts(files), "project"), streamer), "chunks"))
        return written(finish(parts[-1]), "overviews")

    if serial:
        admitted, done = judge(asked, cached, complete, used, limit, ttl)
    else:
        admitted = written(admit(asked, cached, used, limit, ttl), "admitted")
        done = complete(_asked(admitted).select(F.col("cache_key").alias("key")).distinct())
    parts = functools.reduce(DataFrame.unionByName, parts)
    closing = done.select("key", F.explode(F.array(
        F.struct((F.col("last") + 1).alias("i"), "kind", "payload"),
        F.struct((F.col("last") + 2).alias("i"), F.lit("done").alias("kind"), F.lit(None).cast("string").alias("payload")))).alias("e")).select("key", "e.*")
    events = parts.select("key", F.col("seq").alias("i"), F.when(F.col("error").isNull(), "chunk").otherwise("error").alias("kind"), F.coalesce("chunk", "error").alias("payload")).unionByName(closing)
    told = _asked(admitted).select("request_id", F.col("cache_key").alias("key")).join(events, "key").drop("key")
    refused = admitted.filter(F.col("status") != OK).select("request_id", F.lit(0).cast("long").alias("i"), F.lit("status").alias("kind"), F.col("status").cast("string").alias("payload"))
    status = F.when(F.col("kind") == "status", F.col("payload").cast("int")).otherwise(OK)
    answers = cached_replay(admitted).unionByName(told).unionByName(refused).withColumn("status", status)
    return Flow(answers.select("request_id", "status", "i", "kind", "payload"), _entries(done, admitted, serial), _counts(admitted))


def annotate(requests: DataFrame, stored: DataFrame, scanned: DataFrame, cached: DataFrame, completer: completion.Completer = completion.stub, used: DataFrame | None = None, limit: int = v.DAILY_QUOTA, ttl: int = v.CACHE_TTL_SECONDS, serial: bool = False) -> Flow:
    """Annotations of files: requests (request_id, ts, client, own_key, project, path); other columns of theirs are not read.

    stored has project, path, content; scanned the scanned files with their language. Answers are
    (request_id, status, language, annotations as a JSON array, n_annotations). Only arrays that
    aren't empty are stored; an answer that has none is empty.
    """
    requests = requests.select("request_id", "ts", "client", "own_key", "project", "path")
    wanted = requests.select("project", "path").distinct()
    known = scan.file_lookup(wanted, stored, scanned).withColumn("cache_key", keys.annotation_key())
    known = written(known.select("project", "path", "content", F.col("annotation_language").alias("language"), "cache_key"), "files")
    asked = requests.join(known.drop("content"), ["project", "path"], "left")
    texts = known.groupBy(F.col("cache_key").alias("key")).agg(F.min(F.struct("project", "path", "content", "language")).alias("f")).select("key", "f.content", "f.language")

    def complete(todo: DataFrame) -> DataFrame:
        said = written(completion.complete(todo.join(texts, "key").select("key", prompts.annotation_prompt().alias("prompt")), completer), "answers")
        found = said.select("key", jsonx.extract_json("response").alias("found"))
        return written(found.select("key", F.coalesce(jsonx.accepted_annotations(F.col("found")), F.lit(False)).alias("accepted"), F.col("found.value").alias("value")), "annotations")

    if serial:
        admitted, parsed = judge(asked, cached, complete, used, limit, ttl)
    else:
        admitted = written(admit(asked, cached, used, limit, ttl), "admitted")
        parsed = complete(_asked(admitted).select(F.col("cache_key").alias("key")).distinct())
    own = parsed.filter("accepted").select(F.col("key").alias("cache_key"), F.col("value").alias("_own"))
    answers = admitted.join(own, "cache_key", "left")
    given = F.when(F.col("status") == OK, F.coalesce(F.when(F.col("hit"), F.col("value")).otherwise(F.col("_own")), F.lit("[]")))
    answers = answers.select("request_id", "status", F.when(F.col("status") == OK, F.col("language")).alias("language"), given.alias("annotations"))
    return Flow(answers.withColumn("n_annotations", F.json_array_length("annotations").cast("long")), _entries(parsed, admitted, serial), _counts(admitted))

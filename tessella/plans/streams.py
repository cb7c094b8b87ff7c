"""Queries that run streams to their end, each with the SQL of its batch form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import values as v
from tessella.operators import completion, flows, prompts
from tessella.operators.cache import micros
from tessella.plans import queries as q
from tessella.scratch import scratch_dir
from tessella.streaming import live, serve, sink

#: Batches that a table comes in.
BATCHES = 3


def _stream(rows: DataFrame, order: str, files: int = 2) -> DataFrame:
    """The rows as a stream of BATCHES batches, by quantiles of a column."""
    spark = rows.sparkSession
    cuts = rows.approxQuantile(order, [i / BATCHES for i in range(1, BATCHES)], 0.001)
    place = sum((F.when(F.col(order) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    source = scratch_dir(spark, "source")
    for part in range(BATCHES):
        rows.filter(place == part).repartition(files).write.mode("append").parquet(source)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(source)


def _ended(rows: DataFrame) -> DataFrame:
    """What a stream gives, run to its end."""
    spark, out = rows.sparkSession, scratch_dir(rows.sparkSession, "out")
    with live.rocksdb(spark):
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_dir(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def _by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(q.requests(spark, sf_dir).withColumn("us", micros("ts").cast("double")), "us")


def ttl_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ended(live.hits(_by_time(spark, sf_dir), key="props"))


def quota_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ended(live.quota(_by_time(spark, sf_dir), exempt=F.col("event_type") == "signup", limit=q.QUOTA))


def chunk_assembly_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's turns as chunks that come in batches, with an end mark behind the last."""
    c = q.chunks(spark, sf_dir)
    ends = c.groupBy("request_id").agg((F.max("seq") + 1).alias("seq")).withColumn("chunk", F.lit(None).cast("string"))
    rows = c.select("request_id", "seq", "chunk", F.lit(False).alias("done")).unionByName(ends.withColumn("done", F.lit(True)))
    order = rows.withColumn("n", F.col("seq").cast("double") + F.when(F.col("done"), 1e9).otherwise(0))
    return _ended(live.assemble(_stream(order, "n"), remembered=None)).select("request_id", "response")


def flow_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache and quota together over events that come in batches, each seeing what those before it stored and used up."""
    log = _by_time(spark, sf_dir)
    stores = serve.Stores(spark, scratch_dir(spark, "stores"), ttl=q.REPLAY_TTL, together=2)
    judge = serve.replay_judge("props", "client", exempt=F.col("event_type") == "signup", accepted=F.col("event_id") % 7 != 0, limit=q.REPLAY_QUOTA, ttl=q.REPLAY_TTL)
    serve.serve(log, judge, stores, scratch_dir(spark, "progress"), availableNow=True).awaitTermination()
    return stores.answers().drop("batch")


def overview_flow_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.overview(*q._overviews(spark, sf_dir), limit=q.QUOTA, serial=True).answers


def completion_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project's overview prompt, twice, through the table function: equal keys are one completion."""
    prompt = prompts.overview_prompts(q.ranked_files(spark, sf_dir, v.MAX_FILES)).withColumnRenamed("project", "key")
    completion.register_stream(spark)
    asked = prompt.unionByName(prompt)
    return spark.sql("SELECT key, seq, chunk, error FROM stream_completion(TABLE({asked}) PARTITION BY key ORDER BY prompt)", asked=asked)


def events_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's turns through the event sink, and read back."""
    sink.register(spark)
    folder = scratch_dir(spark, "events")
    if not folder.startswith(("file:", "/")):
        raise ValueError("the event sink needs a shared folder that all executors mount")
    folder = "/" + folder.removeprefix("file:").lstrip("/")
    c = q.chunks(spark, sf_dir).select("request_id", F.col("seq").alias("i"), F.lit("chunk").alias("kind"), F.col("chunk").alias("payload"))
    sink.rows(c).write.format("sse").mode("append").option("path", folder).save()
    return sink.read_events(spark, folder).select(F.col("request_id").cast("long").alias("request_id"), "i", F.md5("event").alias("event_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (ttl_live, quota_live, chunk_assembly_live, flow_stream, overview_flow_serial, completion_function, events_written)}

_OWN = q._quote('{"summary": "') + " || length(prompt) || " + q._quote(' characters"}')
_source = q._projects[: q._projects.index(",\nh AS (SELECT *, missing OR hit")].replace("WITH ", "WITH RECURSIVE ", 1)
_step = lambda where, i, kind, payload: f"SELECT request_id, CAST(status AS INT) AS status, CAST({i} AS BIGINT) AS i, '{kind}' AS kind, {payload} AS payload FROM a WHERE {where}"
_hit, _told, _raw = "status = 200 AND hit", "status = 200 AND NOT hit AND contains(prompt, 'README')", "status = 200 AND NOT hit AND NOT contains(prompt, 'README')"
_serial = f"""{_source},
l AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ts, request_id) AS n, request_id, client, CAST(ts AS DATE) AS day, epoch_us(ts) AS us, own_key OR missing AS free, hit AS kept, project AS k, contains(prompt, 'README') AS accepted FROM m),
z AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS request_id, false AS kept, false AS hit, true AS allowed, CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)) AS entries, CAST(MAP {{}} AS MAP(BIGINT, BIGINT)) AS counts, CAST(NULL AS DATE) AS day
  UNION ALL
  SELECT n, request_id, kept, hit, free OR hit OR used < {q.QUOTA}, CASE WHEN NOT hit AND accepted AND (free OR used < {q.QUOTA}) THEN map_concat(entries, map([k], [us])) ELSE entries END,
    CASE WHEN NOT hit AND NOT free AND used < {q.QUOTA} THEN map_concat(counts, map([client], [used + 1])) ELSE counts END, day
  FROM (SELECT l.*, entries, l.kept OR coalesce(l.us - entries[l.k] <= {v.CACHE_TTL_SECONDS * 1_000_000}, false) AS hit, CASE WHEN z.day = l.day THEN z.counts ELSE CAST(MAP {{}} AS MAP(BIGINT, BIGINT)) END AS counts,
               coalesce(CASE WHEN z.day = l.day THEN z.counts[l.client] END, 0) AS used FROM z JOIN l ON l.n = z.n + 1)),
a AS (SELECT m.request_id, m.prompt, z.kept, z.hit, CASE WHEN m.missing THEN 404 WHEN z.allowed THEN 200 ELSE 429 END AS status FROM m JOIN z USING (request_id))
"""
SQL: dict[str, str] = {
    "ttl_live": q.SQL["ttl_cache_replay"],
    "quota_live": q.SQL["quota_daily"],
    "chunk_assembly_live": q.SQL["chunk_assembly"],
    "flow_stream": q.SQL["replay_combined"],
    "overview_flow_serial": _serial + " UNION ALL ".join([
        _step(_hit, 0, "result", f"CASE WHEN kept THEN {q._quote(q.KEPT_OVERVIEW)} ELSE {_OWN} END"), _step(_hit, 1, "done", q._none),
        _step(_told, 0, "chunk", q._quote('{"summary": "')), _step(_told, 1, "chunk", "length(prompt) || ' characters'"), _step(_told, 2, "chunk", q._quote('"}')), _step(_told, 3, "result", _OWN), _step(_told, 4, "done", q._none),
        _step(_raw, 0, "chunk", "'no '"), _step(_raw, 1, "chunk", "'JSON'"), _step(_raw, 2, "raw", "'no JSON'"), _step(_raw, 3, "done", q._none),
        _step("status <> 200", 0, "status", "CAST(status AS VARCHAR)"),
    ]),
}
SQL["completion_function"] = q._prompts.replace("FROM p)\nop AS", "FROM p),\nop AS") + """,
said AS (SELECT project, unnest(CASE WHEN contains(prompt, 'README') THEN ['{"summary": "', length(prompt) || ' characters', '"}'] ELSE ['no ', 'JSON'] END) AS chunk, unnest(CASE WHEN contains(prompt, 'README') THEN [0, 1, 2] ELSE [0, 1] END) AS seq FROM op)
SELECT project AS key, CAST(seq AS BIGINT) AS seq, chunk, CAST(NULL AS VARCHAR) AS error FROM said"""
SQL["events_written"] = "SELECT conv_id AS request_id, turn AS i, md5('data: ' || to_json({'chunk': text})::VARCHAR || chr(10) || chr(10)) AS event_md5 FROM conversations"

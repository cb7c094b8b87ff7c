"""The event sink: batches are seen whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from tessella.scratch import scratch_dir
from tessella.streaming import sink, sse

EVENTS = [("a", 0, "chunk", 'he said "é"\n'), ("a", 1, "result", '{"x": 1}'), ("a", 2, "done", None), ("b", 0, "raw", None), ("b", 1, "result", None), ("c", 0, "error", "E: x")]
SCHEMA = "request_id string, i long, kind string, payload string"


def told(spark, folder):
    return sorted((r.request_id, r.i, r.event) for r in sink.read_events(spark, folder).collect())


def test_batches_equal_encode(spark, tmp_path):
    sink.register(spark)
    folder = str(tmp_path / "out")
    df = spark.createDataFrame(EVENTS, SCHEMA)
    want = sorted((r.request_id, r.i, r.e) for r in df.select("request_id", "i", sse.encode("kind", "payload").alias("e")).collect())
    assert told(spark, folder) == []
    sink.rows(df.repartition(3)).write.format("sse").mode("append").option("path", folder).save()
    assert told(spark, folder) == want
    sink.rows(df.limit(0)).write.format("sse").mode("append").option("path", folder).save()
    sink.rows(df.filter("request_id = 'c'")).write.format("sse").mode("append").option("path", folder).save()
    assert told(spark, folder) == sorted([*want, ("c", 0, want[-1][2])])


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    sink.register(spark)
    folder = str(tmp_path / "out")
    df = spark.createDataFrame(EVENTS, SCHEMA).repartitionByRange(3, "request_id", "i")
    bad = df.withColumn("payload", F.when(F.col("request_id") == "c", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="lost"):
        sink.rows(bad).write.format("sse").mode("append").option("path", folder).save()
    assert told(spark, folder) == [] and not [n for n in os.listdir(folder) if n.endswith(".jsonl")]


def test_stream(spark, tmp_path):
    sink.register(spark)
    source, folder, progress = scratch_dir(spark, "events"), str(tmp_path / "out"), scratch_dir(spark, "progress")
    for i in range(0, 6, 2):
        spark.createDataFrame(EVENTS[i : i + 2], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # a second run finds nothing new
        sink.rows(stream).writeStream.format("sse").option("path", folder).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    df = spark.createDataFrame(EVENTS, SCHEMA)
    assert told(spark, folder) == sorted((r.request_id, r.i, r.e) for r in df.select("request_id", "i", sse.encode("kind", "payload").alias("e")).collect())
    assert sorted(n for n in os.listdir(os.path.join(folder, sink.LEDGER))) == ["0", "1", "2"]


def test_completion_as_a_table_function(spark):
    from tessella.operators import completion

    def streamer(prompt):
        yield "a"
        yield ""
        yield prompt
        if prompt == "bad":
            raise RuntimeError("no provider")

    completion.register_stream(spark, "stream_test", streamer)
    rows = [("k", "p2", 1), ("k", "p1", 2), ("x", "bad", 3), ("n", None, 4), ("k", "p1", 5)]
    spark.createDataFrame(rows, "key string, prompt string, more int").createOrReplaceTempView("asked_test")
    got = spark.sql("SELECT * FROM stream_test(TABLE(asked_test) PARTITION BY key ORDER BY prompt)").collect()
    assert sorted(map(tuple, got), key=str) == [("k", 0, "a", None), ("k", 1, "p1", None), ("x", 0, "a", None), ("x", 1, "bad", None), ("x", 2, None, "RuntimeError: no provider")]

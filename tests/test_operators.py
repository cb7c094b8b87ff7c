"""Operators on small tables with expected rows, and every query against its SQL."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.functions import jsonx
from tessella.operators import annotations, cache, completion, keys, scan
from tessella.plans import queries as plans
from tessella.sources.tree import read_tree, tree_megabytes
from tessella.streaming import sse

SF = "/root/testdata/sf0.001"


def test_upload_rules(spark):
    rows = [("a.py", ""), ("b.py", "x" * 102_401), ("c.py", "語" * 102_400), ("../d.py", "x"), ("e.PNG", "x"), ("node_modules/f.js", "x"), ("g.py", "a\0b")]
    df = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(rows)], "ord int, path string, content string")
    got = {r.path: (r.r, r.octets) for r in df.select("path", scan.upload_reject_reason().alias("r"), F.octet_length("content").alias("octets")).collect()}
    assert got["a.py"][0] is None and got["c.py"] == (None, 307_200) and got["node_modules/f.js"][0] is None and got["g.py"][0] is None
    assert (got["b.py"][0], got["../d.py"][0], got["e.PNG"][0]) == ("too_large", "unsafe_path", "extension")


def test_cap_rank_and_contents(spark):
    df = spark.createDataFrame([("p", 0, "b.py", "1"), ("p", 1, "a/README.md", "2"), ("p", 2, "Dockerfile", "3"), ("p", 3, "z.py", "4"), ("p", 4, "b.py", "5")], "project string, ord long, path string, content string")
    ranked = scan.rank(scan.cap(df, 4)).orderBy("rank").collect()
    assert [r.path for r in ranked] == ["Dockerfile", "a/README.md", "b.py", "z.py"]
    assert {r.path: r.content for r in scan.contents(df).collect()}["b.py"] == "5"
    meta = scan.project_meta(scan.rank(scan.scan_upload(df))).first()
    assert meta.total_files == 5 and [f.path for f in meta.files] == ["Dockerfile", "a/README.md", "b.py", "b.py", "z.py"]
    assert scan.rank(scan.cap(df.limit(0))).count() == 0


def test_overview_key_is_of_path_and_size(spark):
    df = spark.createDataFrame([("p", 0, "b.py", "x"), ("p", 1, "a.py", "yy")], "project string, ord long, path string, content string")
    import hashlib

    got = keys.overview_keys(scan.rank(scan.scan_upload(df))).first().cache_key
    assert got == "overview:" + hashlib.sha256(b"a.py:2|b.py:1").hexdigest()[:24]


def test_ttl_boundary_and_replay(spark):
    log = spark.sql("""SELECT * FROM VALUES (0, 'k', timestamp'2024-01-01 00:00:00'), (1, 'k', timestamp'2024-01-08 00:00:00'), (2, 'k', timestamp'2024-01-08 00:00:00.000001'), (3, 'k', timestamp'2024-01-09'), (4, NULL, timestamp'2024-01-09'), (5, 'j', timestamp'2024-01-01') t(event_id, key, ts)""")
    got = {r.event_id: r.hit for r in cache.ttl_replay(log).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False, 5: False}


def test_quota(spark):
    log = spark.sql("SELECT id AS event_id, 'c' AS client, timestamp'2024-01-01' AS ts FROM range(22)")
    got = {r.event_id: (r.allowed, r.remaining) for r in cache.quota(log, exempt=F.col("event_id") == 5).collect()}
    assert (got[0], got[19], got[20], got[21]) == ((True, 20), (True, 2), (True, 1), (False, 0))
    assert got[5][0] and sum(a for a, _ in got.values()) == 21


def test_lookup_and_upsert(spark):
    writes = spark.sql("""SELECT * FROM VALUES (0, 'a', '{"x":1}', timestamp'2024-01-01'), (1, 'a', '{}', timestamp'2024-01-02'), (2, 'b', '[1]', timestamp'2024-01-01') t(event_id, key, value, ts)""")
    stored = cache.upsert(writes)
    asks = spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-03'), ('b', timestamp'2024-01-08'), ('b', timestamp'2024-01-08 00:00:01'), ('c', timestamp'2024-01-03') t(key, ts)")
    got = sorted((r.key, str(r.ts), r.hit, r.value) for r in cache.lookup(asks, stored).collect())
    assert [(k, h, v) for k, _, h, v in got] == [("a", False, None), ("b", True, "[1]"), ("b", False, None), ("c", False, None)]


def test_annotation_lookup(spark):
    notes = annotations.explode_annotations(spark.sql("SELECT 1 AS doc_id, array(named_struct('line_start', 1, 'line_end', 3, 'annotation', 'first'), named_struct('line_start', 2, 'line_end', 1000000000, 'annotation', 'second'), named_struct('line_start', 9, 'line_end', 8, 'annotation', 'reversed')) AS annotations"))
    lines = spark.sql("SELECT 1 AS doc_id, explode(array(2, 4, 9)) AS line UNION ALL SELECT 2, 1")
    got = {(r.doc_id, r.line): r.annotation for r in annotations.lookup(lines, notes, ("doc_id",)).collect()}
    assert got == {(1, 2): "first", (1, 4): "second", (1, 9): "second", (2, 1): None}


def test_json_extraction(spark):
    texts = {'```json\n{"a": 1}\n```': ("object", '{"a": 1}'), 'ok: {"a":1} bye': ("object", '{"a": 1}'), 'x {"f":[1]} y': ("array", "[1]"), "nope": ("none", None), None: ("none", None), "```\n[1": ("none", None), "```\n[1]``": ("array", "[1]"), "```[2]\n[1]\n``` ```": ("array", "[1]"), " 7 ": ("scalar", "7"), "] [": ("none", None), "null": ("none", None), '{"é": [1, 2': ("none", None)}
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", jsonx.extract_json("x").alias("f")).collect()
    assert {r.x: tuple(r.f) for r in rows} == texts


def test_plain_json_is_what_python_writes(spark):
    import json
    import random

    import pandas as pd

    rng = random.Random(1)
    scalar = lambda: rng.choice([1, -5, 0, -0.0, 1.5, 0.25, 0.0001, 1e-5, 1e16, 123456789012345, 1234567890123456, True, None, "x", 'é"q', "a\\b", "k\n", "", 0.1 + 0.2, 12.0, float("nan"), "{}", "[1]", 'a": 1'])
    flat = lambda: {rng.choice(["a", "b", "c d", "é", 'q"']): scalar() for _ in range(rng.randrange(3))}
    value = lambda: rng.choice([flat(), flat(), [rng.choice([scalar(), flat()]) for _ in range(rng.randrange(4))], {"n": {"x": 1}}, [[1]], "s", 3])
    odd = ['{"a": 1, "a": 2}', '[{"a": 1, "a": 2}]', '[{"a": 1}, {"a": 2}]', '{"a":1}', '{"a": 01}', '{"a": -0}', "[-0]", "[-0.5]", '{"a": 1.50}', "[1] x", '{"a": NaN}', '{"a": 1e5}', "[1, 2", '{"k": "x\ty"}', "", "null", "[0.12345]", "[1.0, 2.5]", '{"a": "b"} ', '```json\n{"a": 1}\n```', '{"a": 1}, {"b": 2}', "[ 1]", "[1,2]"]
    texts = [json.dumps(value(), ensure_ascii=False) for _ in range(1500)] + odd
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", jsonx.extract_json("t").alias("f"), jsonx.is_plain("t").alias("p"), jsonx.candidates("t").alias("c")).orderBy("i").collect()
    want = jsonx._first_json(pd.Series([r.c for r in rows]))
    assert [tuple(r.f) for r in rows] == list(zip(want.kind, want.value))
    assert 300 < sum(r.p for r in rows) < 1500


def test_typed_annotations(spark):
    value = '[{"line_start": 1, "line_end": 3, "annotation": "a"}, {"line_start": "2", "line_end": 3, "annotation": 5}, {"line_start": 9, "line_end": 3}, 7, {"line_start": 1.5, "line_end": 99999999999, "annotation": null}, null]'
    rows = spark.createDataFrame([(1, value, "x"), (2, '{"a": 1}', "x"), (3, "[1", "x"), (4, None, "x"), (5, "[]", "x")], "i int, value string, RAW string")
    got = [(r.i, r.idx, r.line_start, r.line_end, r.annotation) for r in jsonx.typed_annotations(rows).collect()]
    assert got == [(1, 0, 1, 3, "a"), (1, 1, None, 3, None), (1, 2, None, None, None), (1, 3, None, None, None), (1, 4, None, None, None), (1, 5, None, None, None)]


def test_completion_dedupes_and_keeps_errors(spark):
    def failing(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    df = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "bad")], "key string, prompt string")
    got = sorted((r.key, r.response, r.error) for r in completion.complete(df, failing).collect())
    assert got[:2] == [("k1", "A", None)] * 2 and got[2][1:] == (None, "ValueError: no")


def test_sse_decode(spark):
    text = 'data: {"chunk":"a\\nb"}\n\n: note\ndata: bad\ndata: {"result":{"x":1}}\n\ndata: [DONE]\n\ndata: {"chunk":"late"}\n\n'
    got = spark.createDataFrame([(text,), ('data: {"raw":"r"}\n\ndata: {"chunk":"cut',), ("",)], "s string").select(F.explode(sse.decode("s")).alias("e")).collect()
    assert [(r.e.kind, r.e.payload) for r in got] == [("chunk", "a\nb"), ("result", '{"x":1}'), ("raw", "r")]


def streamed(spark, path, schema, parts, run, name):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    q = run(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_stream_assembly(spark, tmp_path):
    rows = [("r1", 1, "lo", False), ("r1", 0, "hel", False), ("r2", 0, "x", True), ("r1", 2, "", True), ("r1", 3, "late", False), ("r2", 1, "late", True)]
    got = streamed(spark, tmp_path, "request_id string, seq long, chunk string, done boolean", (rows[:2], rows[2:4], rows[4:]), lambda s: sse.assemble_stream(s, None), "assembled")
    assert got == [("r1", "hello", 2), ("r2", "x", 1)]


def test_stream_decoding_carries_cut_lines_and_characters(spark, tmp_path):
    data = 'data: {"chunk":"é語"}\n\n: note\ndata: bad\ndata: {"result":{"x":[1]}}\n\ndata: [DONE]\ndata: {"chunk":"late"}\n\n'.encode()
    parts = [[("r", k, bytearray(data[k : k + 1])) for k in range(a, min(a + 40, len(data)))][::-1] for a in range(0, len(data), 40)]
    got = streamed(spark, tmp_path, "request_id string, seq long, data binary", [*parts, [("r", 999, bytearray(b'data: {"chunk":"x"}\n'))]], lambda s: sse.decode_stream(s, None), "decoded")
    assert got == [("r", 0, "chunk", "é語"), ("r", 1, "result", '{"x":[1]}')]


def test_sse_encoding_of_null(spark):
    row = spark.sql("SELECT CAST(NULL AS STRING) AS p").select(sse.encode(F.lit("chunk"), "p").alias("a"), sse.encode(F.lit("result"), "p").alias("b"), sse.encode(F.lit("done"), "p").alias("c")).first()
    assert tuple(row) == ('data: {"chunk":null}\n\n', 'data: {"result":null}\n\n', "data: [DONE]\n\n")


def test_source_tree(spark, tmp_path):
    files = {"a.py": b"x", ".env.example": b"y", "_z/__init__.py": b"z", "empty.py": b"", "node_modules/m.js": b"m", "p.png": b"p", "nul.py": b"a\0b", "big.py": b"b" * 102_401, "edge.py": b"b" * 102_400, "d.egg-info/x.txt": b"x"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    assert sorted(r.path for r in read_tree(spark, str(tmp_path)).collect()) == [".env.example", "_z/__init__.py", "a.py", "edge.py"]
    scanned = scan.scan_tree(spark, str(tmp_path)).collect()
    assert {r.path: r.language for r in scanned}["a.py"] == "python"
    assert tree_megabytes(spark, str(tmp_path)) == pytest.approx(sum(map(len, files.values())) / 1048576)


def test_annotation_language_of_unknown_and_unscanned_files(spark):
    # Of a scanned file the language counts, be it unknown; python stands for paths that weren't scanned.
    files = spark.createDataFrame([("p", 0, "Makefile", "all:"), ("p", 1, "a.go", "x"), ("p", 2, "b.lock", "y")], "project string, ord long, path string, content string")
    wanted = files.select("project", "path").union(spark.sql("SELECT 'p', 'none'"))
    got = {r.path: (r.language, r.annotation_language) for r in scan.file_lookup(wanted, scan.contents(files), scan.scan_upload(files)).collect()}
    assert got == {"Makefile": ("unknown", "unknown"), "a.go": ("go", "go"), "b.lock": ("unknown", "python"), "none": ("unknown", "python")}


def test_guards(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x" * 2000)
    assert [r.path for r in scan.scan_project(spark, str(tmp_path)).collect()] == ["a.py"]
    with pytest.raises(ValueError, match="MB"):
        scan.scan_project(spark, str(tmp_path), most_mb=0.001)
    (tmp_path / "a.py").unlink()
    with pytest.raises(ValueError, match="no readable"):
        scan.scan_project(spark, str(tmp_path))
    empty = spark.createDataFrame([], "project string, ord long, path string, content string")
    with pytest.raises(ValueError, match="uploaded"):
        scan.upload_project(empty)


def test_large_folders_are_split(spark, tmp_path, monkeypatch):
    from tessella.sources import tree

    monkeypatch.setattr(tree, "NAMES", 10)
    for i in range(45):
        (tmp_path / f"d{i % 2}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 2}" / f"{i}.py").write_text("x")
    parts = tree._Reader({"path": str(tmp_path)}).partitions()
    assert sorted(len(p.names) for p in parts) == [2, 3, 10, 10, 10, 10]
    assert read_tree(spark, str(tmp_path)).count() == 45


def test_long_and_overlapping_ranges(spark):
    import random

    rng = random.Random(3)
    ranges = [(i, a := rng.randint(-5, 900), a + rng.choice([-1, 0, 3, 62, 64, 130, 700])) for i in range(60)]
    notes = spark.createDataFrame([(1, i, a, b, f"n{i}") for i, a, b in ranges], "doc_id int, idx int, line_start int, line_end int, annotation string")
    lines = spark.createDataFrame([(1, n) for n in range(1, 1000)] + [(1, 64)], "doc_id int, line int")
    got = sorted((r.line, r.annotation) for r in annotations.lookup(lines, notes, ("doc_id",)).collect())
    want = [(n, next((f"n{i}" for i, a, b in ranges if a <= n <= b), None)) for n in [*range(1, 1000), 64]]
    assert got == sorted(want)


def test_replay_over_batches(spark):
    import random

    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None, *[f"k{j}" for j in range(30)]]), rng.randint(0, 40 * 86_400)) for i in range(1500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        log = spark.createDataFrame(rows, "event_id int, key string, at int").selectExpr("event_id", "key", "timestamp_seconds(at) AS ts")
        got = {r.event_id: r.hit for r in cache.ttl_replay(log).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, until = {}, {}
    for i, k, at in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = k is not None and at <= until.get(k, -1)
        if not want[i]:
            until[k] = at + 7 * 86_400
    assert got == want


def test_flows(spark):
    from tessella.operators import flows

    def streamer(prompt):
        if "bad.py" in prompt:
            raise ValueError("no")
        yield from ("[1", "", "]") if "list.py" in prompt else ('{"a"', ": 1}")

    files = spark.createDataFrame([(p, 0, f"{p}.py", "x") for p in ("good", "bad", "list", "kept")], "project string, ord long, path string, content string")
    ranked = scan.rank(scan.scan_upload(files))
    keyed = {r.project: r.cache_key for r in keys.overview_keys(ranked).collect()}
    cached = spark.createDataFrame([(keyed["kept"], '{"k": 2}')], "key string, value string").selectExpr("*", "timestamp'2024-01-01' AS created_at")
    asked = spark.createDataFrame([(1, "c", False, "good"), (2, "c", False, "kept"), (3, "c", False, "none"), (4, "c", False, "good"), (5, "c", False, "bad"), (6, "c", True, "list")], "request_id long, client string, own_key boolean, project string").selectExpr("*", "timestamp'2024-01-02' AS ts")
    used = spark.sql("SELECT 'c' AS client, date'2024-01-02' AS day, 1L AS requests")
    flow = flows.overview(asked, ranked, cached, streamer, used, limit=3)
    got = {}
    for r in sorted(flow.answers.collect()):
        got.setdefault((r.request_id, r.status), []).append((r.kind, r.payload))
    told = [("chunk", '{"a"'), ("chunk", ": 1}"), ("result", '{"a": 1}'), ("done", None)]
    assert got == {(1, 200): told, (2, 200): [("result", '{"k": 2}'), ("done", None)], (3, 404): [("status", "404")], (4, 200): told, (5, 429): [("status", "429")], (6, 200): [("chunk", "[1"), ("chunk", "]"), ("raw", "[1]"), ("done", None)]}
    assert [(r.key, r.value) for r in flow.entries.collect()] == [(keyed["good"], '{"a": 1}')]
    assert [tuple(r)[2] for r in flow.counts.collect()] == [2]
    failed = flows.overview(asked.filter("request_id = 5"), ranked, cached, streamer).answers.collect()
    assert [(r.kind, r.payload) for r in sorted(failed)] == [("error", "ValueError: no"), ("raw", ""), ("done", None)]


def test_tables_are_created_once(spark):
    from tessella.operators import store

    store.create_tables(spark)
    store.create_tables(spark)
    assert {"cache", "projects", "rate_limits"} <= {t.name for t in spark.catalog.listTables("default")}
    for name in store.TABLES:
        spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in ("documents", "events", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = plans.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(plans.SQL[name])
    assert sorted(want.columns) == cols
    norm = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert norm(tuple(r[c] for c in cols) for r in got.collect()) == norm(want.select(*[f'"{c}"' for c in cols]).fetchall())


@pytest.mark.parametrize("name", ["project_rank_cap", "overview_key", "project_meta", "overview_prompt"])
def test_default_forms_keep_500_files(spark, tmp_path, name):
    import duckdb

    rows = [(i, f"text {i}", "src1" if i < 700 else "src2") for i in range(740)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = plans.QUERIES[f"{name}_default"](spark, str(tmp_path))
    cols = sorted(got.columns)
    rows = sorted(tuple(r[c] for c in cols) for r in got.collect())
    assert rows == sorted(con.sql(plans.SQL[f"{name}_default"]).select(*[f'"{c}"' for c in cols]).fetchall())
    files = {p: sum(i % 14 not in (2, 5, 6) for i in ids) for p, ids in (("src1", range(700)), ("src2", range(700, 740)))}
    assert files["src1"] > 500 and files["src2"] > plans.CAP
    kept = {p: min(n, 500) for p, n in files.items()}
    if name == "project_meta":
        assert {r.project: r.total_files for r in got.collect()} == kept
    if name == "overview_prompt":
        assert {r.project: r.prompt.count("\n### ") for r in got.collect()} == kept


def test_default_preview_keeps_80_lines(spark, tmp_path):
    import duckdb

    html = "\n".join(f"line {i}" for i in range(1, 101))
    spark.createDataFrame([(1, "u", html), (2, "u", "a\nb")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(tuple(r) for r in plans.QUERIES["html_preview_default"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(plans.SQL["html_preview_default"]).fetchall())
    assert got[0][1] == "\n".join(f"line {i}" for i in range(1, 81)) and got[1][1] == "a\nb"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_lines_are_looked_up_in_tasks_of_some_size(spark, monkeypatch):
    """Small rows, which would all fit in one partition by their bytes."""
    monkeypatch.setattr(annotations, "TASK_LINES", 100, raising=False)
    lines = spark.createDataFrame([(d, n) for d in range(10) for n in range(1, 201)], "doc_id int, line int")
    notes = spark.createDataFrame([(d, 0, 5, 150, "n") for d in range(10)], "doc_id int, idx int, line_start int, line_end int, annotation string")
    found = annotations.lookup(lines, notes, ("doc_id",))
    assert found.count() == 2000 and found.filter("annotation = 'n'").count() == 10 * 146
    assert found.rdd.getNumPartitions() >= 20

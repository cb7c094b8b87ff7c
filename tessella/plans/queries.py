"""Queries of the source-corpus operators over the driver's tables, each with its SQL.

The tables have no source files, so documents stand in for uploads: source is the project, doc_id the
input order, and the path is derived from both. Events stand in for request logs, conversations for
streamed chunks, pages for links.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import jsonx
from tessella.functions import text as t
from tessella.functions import values as v
from tessella.operators import annotations, cache, completion, flows, keys, prompts, replay, scan, store
from tessella.scratch import scratch_dir, written
from tessella.sources.tree import write_tree
from tessella.streaming import sse

Query = Callable[[SparkSession, str], DataFrame]

#: File names that documents get by doc_id modulo 14, in order; {} is the doc_id.
NAMES = ("{}.py", "{}/README.md", "{}.png", "{}.TS", "node_modules/{}.js", "{}/yarn.lock", "../../{}.py", "a/../{}.go", "x.egg-info/{}.txt", ".env", "{}.R", "{}/Makefile", "{}/config.py", "..{}/x.rs")
#: Files of a project that the capped queries keep: low enough to bite on small tables. Their _default forms keep MAX_FILES.
CAP = 20
#: A low quota, which these events reach.
QUOTA = 3
PAIR_LINES, PAIR_CHARS = 5, 600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("doc_id") % len(NAMES) + 1).cast("int"))
    path = F.concat(F.col("source"), F.lit("/"), F.replace(names, F.lit("{}"), F.col("doc_id").cast("string")))
    return docs.select(F.col("source").alias("project"), F.col("doc_id").alias("ord"), path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))


# --- SQL building blocks -----------------------------------------------------------------------
_list = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_END = r"(?:\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}])"
_BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_name = lambda p: rf"regexp_extract(regexp_replace({p}, '(?:/\.?)+$', ''), '([^/]*)$', 1)"
_ext = lambda p: rf"lower(regexp_extract({_name(p)}, '(?s)^.+(\.[^.]+)$', 1))"
_lines = lambda x: f"(CASE WHEN {x} = '' THEN [] ELSE string_split_regex(regexp_replace({x}, '{_END}\\z', ''), '{_END}') END)"
_strip = lambda x: f"regexp_replace(regexp_replace({x}, '\\A{_BLANK}', ''), '{_BLANK}\\z', '')"
_config = lambda p: f"{_name(p)} IN ({_list(v.CONFIG_NAMES)})"
_language = lambda p: "CASE " + _ext(p) + " " + " ".join(f"WHEN '{e}' THEN '{x}'" for e, x in v.LANGUAGES.items()) + " ELSE 'unknown' END"
_fold = """list_reduce(list_prepend('', string_split(path, '/')), lambda a, x: CASE WHEN x IN ('', '.') THEN a
   WHEN x = '..' THEN CASE WHEN a = '' THEN '..' WHEN a = '..' OR a LIKE '%/..' THEN a || '/..' ELSE regexp_replace(a, '/?[^/]+$', '') END
   WHEN a = '' THEN x ELSE a || '/' || x END)"""
_safe = f"(NOT starts_with(path, '/') AND NOT starts_with({_fold}, '..'))"
_hash = lambda x: f"substr(sha256({x}), 1, 24)"
_uploads = f"""u AS (SELECT source AS project, doc_id AS ord, source || '/' || replace([{_list(NAMES)}][doc_id % {len(NAMES)} + 1], '{{}}', CAST(doc_id AS VARCHAR)) AS path, coalesce(text, '') AS content FROM documents)"""
_reason = f"CASE WHEN NOT {_safe} THEN 'unsafe_path' WHEN {_ext('path')} IN ({_list(v.SKIP_EXTENSIONS)}) THEN 'extension' WHEN length(content) > {v.MAX_FILE_SIZE} THEN 'too_large' END"
_scanned = f"""{_uploads},
r AS (SELECT *, {_reason} AS reject_reason FROM u),
s AS (SELECT project, ord, path, content, CAST(strlen(content) AS BIGINT) AS size, {_language('path')} AS language,
      CASE WHEN {_config('path')} THEN content ELSE array_to_string(list_slice({_lines('content')}, 1, {v.PREVIEW_LINES}), chr(10)) END AS preview FROM r WHERE reject_reason IS NULL)"""
_ranked = f"""{_scanned},
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY project ORDER BY ord) <= {CAP}),
k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY CASE WHEN {_config('path')} THEN 0 ELSE 1 END, path, ord) AS rank FROM c)"""


_ranked_default = _ranked.replace(f"<= {CAP})", f"<= {v.MAX_FILES})")


def ranked_files(spark: SparkSession, sf_dir: str, most: int = CAP) -> DataFrame:
    return scan.rank(scan.cap(scan.scan_upload(uploads(spark, sf_dir)), most))


# --- queries -----------------------------------------------------------------------------------
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_upload(uploads(spark, sf_dir)).select("project", "ord", "path", "size", "language", "preview")


def project_rank_cap(spark: SparkSession, sf_dir: str, most: int = CAP) -> DataFrame:
    return ranked_files(spark, sf_dir, most).select("project", "ord", "path", F.col("rank").cast("long").alias("rank"))


def project_rank_cap_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_rank_cap(spark, sf_dir, v.MAX_FILES)


def content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads(spark, sf_dir).select("ord", t.content_hash("content").alias("content_hash"), keys.annotation_key().alias("cache_key"), t.url_hash("path").alias("path_hash"))


def overview_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.overview_keys(ranked_files(spark, sf_dir))


def overview_key_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.overview_keys(ranked_files(spark, sf_dir, v.MAX_FILES))


def project_meta(spark: SparkSession, sf_dir: str, most: int = CAP) -> DataFrame:
    meta = scan.project_meta(ranked_files(spark, sf_dir, most))
    return meta.select("project", "total_files", "total_size", F.array_join(F.transform("files", lambda f: F.concat(f["path"], F.lit(":"), f["language"], F.lit(":"), f["preview"])), "|").alias("files"))


def project_meta_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_meta(spark, sf_dir, v.MAX_FILES)


def reject_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = uploads(spark, sf_dir)
    return u.select("ord", scan.upload_reject_reason().alias("upload_reason"), F.coalesce(F.when(t.in_skipped_dir("path"), F.lit("directory")), F.when(t.is_skipped_extension("path"), F.lit("extension")), F.when(F.octet_length("content") > v.MAX_FILE_SIZE, F.lit("too_large")), F.when(F.octet_length("content") == 0, F.lit("empty")), F.when(t.is_binary(F.encode("content", "UTF-8")), F.lit("binary"))).alias("tree_reason"), scan.client_reject_reason().alias("client_reason"))


def file_content_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = uploads(spark, sf_dir)
    stored, scanned = scan.contents(u), scan.scan_upload(u)
    wanted = u.select("project", "path").distinct()
    found = scan.file_lookup(wanted, stored, scanned)
    return found.select("project", "path", "language", "annotation_language", t.content_hash("content").alias("content_hash"))


def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_upload(uploads(spark, sf_dir)).groupBy("language").agg(F.count("*").alias("files"), F.sum("size").alias("total_size"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("client"), "event_type", "props")


def quota_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = requests(spark, sf_dir)
    return cache.quota(log, exempt=F.col("event_type") == "signup", limit=QUOTA).select("event_id", "allowed", "remaining")


def quota_daily_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.quota(requests(spark, sf_dir)).select("event_id", "allowed", "remaining")


def quota_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.quota_counts(requests(spark, sf_dir)).select("client", F.col("day").cast("string").alias("day"), "requests")


def ttl_cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.ttl_replay(requests(spark, sf_dir), key="props")


#: A short time to live and a low quota, under which these events hit, miss and are denied in turn.
REPLAY_TTL, REPLAY_QUOTA = 6 * 3600, 1


def replay_combined(spark: SparkSession, sf_dir: str, limit: int = REPLAY_QUOTA, ttl: int = REPLAY_TTL) -> DataFrame:
    """Cache and quota together over all events: one event in seven has no result to store."""
    log = requests(spark, sf_dir)
    return replay.replay(log, key="props", exempt=F.col("event_type") == "signup", accepted=F.col("event_id") % 7 != 0, limit=limit, ttl=ttl)


def replay_combined_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_combined(spark, sf_dir, v.DAILY_QUOTA, v.CACHE_TTL_SECONDS)


def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = requests(spark, sf_dir).withColumn("value", F.concat_ws("-", "event_type", F.col("event_id").cast("string")))
    return cache.upsert(log, key="client").withColumn("created_at", cache.micros("created_at"))


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = requests(spark, sf_dir)
    early = log.filter("event_id % 10 < 3").withColumn("value", F.when(F.col("event_id") % 3 == 0, F.lit("{}")).otherwise(F.col("props")))
    stored = cache.upsert(early, key="client")
    late = log.filter("event_id % 10 >= 3").withColumnRenamed("client", "key")
    return cache.lookup(late, stored).select("event_id", "hit", "value")


def cache_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as writes, and all of them looked up, up to 14 days later."""
    log = requests(spark, sf_dir)
    stored = cache.upsert(log.withColumn("value", F.when(F.col("event_id") % 3 == 0, F.lit("{}")).otherwise(F.col("props"))), key="client")
    late = log.withColumn("ts", F.col("ts") + F.make_dt_interval((F.col("event_id") % 15).cast("int"))).withColumnRenamed("client", "key")
    return cache.lookup(late, stored).select("event_id", "hit", "value")


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n of the documents that have lines."""
    return uploads(spark, sf_dir).select(F.col("ord").alias("doc_id"), t.count_lines("content").alias("n")).filter("n > 0")


def file_lines(counts: DataFrame) -> DataFrame:
    return counts.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("line"))


def file_annotations(counts: DataFrame) -> DataFrame:
    odd = F.transform(F.sequence(F.lit(1), F.col("n"), F.lit(2)), lambda s: F.struct(s.alias("line_start"), (s + (F.col("doc_id") % 3).cast("int")).alias("line_end"), F.concat(F.lit("note "), s.cast("string")).alias("annotation")))
    return annotations.explode_annotations(counts.select("doc_id", odd.alias("annotations")))


def annotation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = written(line_counts(spark, sf_dir), "line-counts")  # texts are read once
    parts = annotations.tasks(spark, counts.agg(F.sum("n")).first()[0] or 0)
    spread = counts.repartition(parts, "doc_id")  # a small table of many lines
    return annotations.lookup(file_lines(spread), file_annotations(spread), ("doc_id",), parts)


def annotation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.labels(file_annotations(line_counts(spark, sf_dir))).select("doc_id", "line_start", "label")


def overview_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.overview_prompts(ranked_files(spark, sf_dir))


def overview_prompt_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.overview_prompts(ranked_files(spark, sf_dir, v.MAX_FILES))


def annotation_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = scan.scan_upload(uploads(spark, sf_dir))
    return files.select("ord", prompts.annotation_prompt().alias("prompt"), F.md5(prompts.annotation_prompt(most=PAIR_LINES)).alias("short_prompt_md5"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.when(F.col("page_id") % 5 == 0, F.lit("http://")).otherwise(F.lit("https://")), F.when(F.col("page_id") % 7 == 0, F.lit("example.org/")).otherwise(F.lit("github.com/")), F.lit("o"), (F.col("page_id") % 11).cast("string"), F.lit("/r"), F.col("page_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("", ".git", ".git/", "/tree/main", ".github.io", "//")]), (F.col("page_id") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("link"), "url")


def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = t.repo_parts("link")
    return links(spark, sf_dir).select("page_id", t.is_repo_url("link").alias("is_repo"), parts["owner"].alias("owner"), parts["repo"].alias("repo"), t.clone_url("link").alias("clone_url"), t.clone_folder("link").alias("folder"), t.repo_name("link").alias("name"), t.repo_name("url").alias("page_name"))


def html_preview(spark: SparkSession, sf_dir: str, most: int = PAIR_LINES) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("html", F.coalesce("html", F.lit("")))
    return pages.select("page_id", t.first_lines("html", most).alias("preview"), F.size(t.splitlines("html")).alias("lines"), t.strip("html").alias("stripped"))


def html_preview_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_preview(spark, sf_dir, v.PREVIEW_LINES)


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = requests(spark, sf_dir)
    wrap = F.element_at(F.array(F.col("props"), F.concat(F.lit("```json\n"), "props", F.lit("\n```")), F.concat(F.lit("Here: "), "props", F.lit(" bye")), F.concat(F.lit("x {\"f\": [1], \"p\": "), "props", F.lit("} y")), F.lit("nope"), F.concat(F.lit("["), "props", F.lit(", "), "props", F.lit("]"))), (F.col("event_id") % 6 + 1).cast("int"))
    found = log.select("event_id", jsonx.extract_json(wrap).alias("found"))
    return found.select("event_id", "found.kind", "found.value", F.coalesce(jsonx.accepted_overview(F.col("found")), F.lit(False)).alias("overview"), F.coalesce(jsonx.accepted_annotations(F.col("found")), F.lit(False)).alias("annotations"))


def typed_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer to every event, with line numbers that are numbers, strings, fractions, missing or reversed, as typed columns."""
    n = F.col("event_id")
    start = F.element_at(F.array(F.lit('"3"'), n.cast("string"), n.cast("string"), F.lit("2.5"), n.cast("string")), (n % 5 + 1).cast("int"))
    end = F.element_at(F.array(F.lit("7"), (n - 1).cast("string"), F.lit("null"), n.cast("string"), (n + 4).cast("string")), (n % 5 + 1).cast("int"))
    answer = F.concat(F.lit('Lines:\n[{"line_start": '), start, F.lit(', "line_end": '), end, F.lit(', "annotation": "'), F.col("event_type"), F.lit('"}, '), n.cast("string"), F.lit(", "), F.col("props"), F.lit("]"))
    found = requests(spark, sf_dir).select("event_id", jsonx.extract_json(answer).alias("f"))
    typed = jsonx.typed_annotations(found.filter(jsonx.accepted_annotations(F.col("f"))).select("event_id", F.col("f.value").alias("value")))
    return typed.select("event_id", "idx", "line_start", "line_end", "annotation", F.get_json_object("raw", "$.line_start").alias("raw_start"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.col("text").alias("chunk"), "role")


def chunk_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sse.assemble(chunks(spark, sf_dir))


def sse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    parts = c.select("request_id", "seq", sse.encode(F.lit("chunk"), F.col("chunk")).alias("chunk"))
    end = c.groupBy("request_id").agg((F.max("seq") + 1).alias("seq")).withColumn("chunk", sse.encode(F.lit("done"), F.lit("")))
    late = c.groupBy("request_id").agg((F.max("seq") + 2).alias("seq")).withColumn("chunk", F.lit("data: {\"chunk\":\"late\"}\n\n"))
    stream = sse.assemble(parts.unionByName(end).unionByName(late))
    events = stream.select("request_id", F.posexplode(sse.decode("response")).alias("i", "e"))
    return events.select("request_id", F.col("i").cast("long").alias("i"), "e.kind", "e.payload")


def completed_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = scan.scan_upload(uploads(spark, sf_dir)).withColumns({"key": keys.annotation_key(), "prompt": F.col("content")})
    done = completion.complete(files.select("ord", "key", "prompt"), completion.stub)
    found = done.select("ord", jsonx.extract_json("response").alias("f"), "error")
    return found.select("ord", "f.kind", F.get_json_object("f.value", "$[0].annotation").alias("annotation"), "error")


def ui_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = uploads(spark, sf_dir)
    forwarded = F.when(F.col("ord") % 3 == 0, F.concat(F.lit(" 10.0.0."), (F.col("ord") % 250).cast("string"), F.lit(" , 5.6.7.8"))).when(F.col("ord") % 3 == 1, F.lit(""))
    host = F.when(F.col("ord") % 2 == 0, F.lit("192.168.0.1"))
    importance = F.element_at(F.array(*[F.lit(x) for x in ("high", "medium", "low", "?")]), (F.col("ord") % 4 + 1).cast("int"))
    relative = F.when(F.col("ord") % 4 < 2, F.col("path")).otherwise(F.lit(""))
    rows = u.withColumns({"relative": relative, "name": t.basename("path"), "forwarded": forwarded, "host": host, "importance": importance})
    names = scan.project_names(rows).withColumnRenamed("name", "project_name")
    return rows.join(names, "project").select("ord", scan.client_path().alias("client_path"), t.client_ip("forwarded", "host").alias("client_ip"), t.importance_bucket("importance").alias("icon"), t.highlight_language(t.language("path")).alias("highlight"), scan.client_reject_reason().alias("client_reason"), "project_name")


# --- whole flows
#: When the entries of the flows' caches were made, and what they hold.
KEPT_AT, KEPT_OVERVIEW, KEPT_NOTES = "2024-01-10 00:00:00", '{"summary": "kept"}', '[{"line_start": 1, "line_end": 2, "annotation": "kept"}]'


def flow_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = requests(spark, sf_dir)
    return log.select(F.col("event_id").alias("request_id"), "ts", "client", (F.col("event_type") == "signup").alias("own_key"))


def _overviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests about projects, some of which don't exist; ranked files; and a cache of every other project, half of it empty."""
    asked = flow_requests(spark, sf_dir).withColumn("project", F.concat(F.lit("src"), (F.col("request_id") % 23).cast("string")))
    files = ranked_files(spark, sf_dir, v.MAX_FILES)
    number = F.substring("project", 4, 9).cast("int")
    known = keys.overview_keys(files).filter(number % 2 == 0)
    cached = known.select(F.col("cache_key").alias("key"), F.when(number % 4 == 0, KEPT_OVERVIEW).otherwise("{}").alias("value"), F.lit(KEPT_AT).cast("timestamp").alias("created_at"))
    return asked, files, cached


def overview_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.overview(*_overviews(spark, sf_dir), limit=QUOTA).answers


def cached_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, files, cached = _overviews(spark, sf_dir)
    admitted = flows.admit(asked.join(keys.overview_keys(files), "project", "left"), cached)
    return flows.cached_replay(admitted).select("request_id", "i", sse.encode("kind", "payload").alias("event"))


def annotate_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = uploads(spark, sf_dir)
    asked = flow_requests(spark, sf_dir).withColumn("ord", F.col("request_id") % max(1, u.count())).join(u.select("ord", "project", "path"), "ord", "left")
    asked = asked.select("request_id", "ts", "client", "own_key", F.coalesce("project", F.lit("none")).alias("project"), F.coalesce("path", F.lit("none")).alias("path"))
    kept = u.filter(F.col("ord") % 5 == 0).groupBy(keys.annotation_key().alias("key")).agg(F.max(F.when(F.col("ord") % 10 == 0, KEPT_NOTES).otherwise("[]")).alias("value"))
    cached = kept.withColumn("created_at", F.lit(KEPT_AT).cast("timestamp"))
    return flows.annotate(asked, scan.contents(u), scan.scan_upload(u), cached, limit=QUOTA).answers


def sse_stream_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's events as bytes, cut into short pieces that come in two batches, through the streaming decoder."""
    c = chunks(spark, sf_dir)
    whole = c.select("request_id", "seq", sse.encode(F.lit("chunk"), F.col("chunk")).alias("chunk"))
    ends = c.groupBy("request_id").agg((F.max("seq") + 1).alias("seq")).withColumn("chunk", F.lit("data: [DONE]\n\ndata: {\"chunk\":\"late\"}\n\n"))
    data = F.encode("response", "UTF-8")
    piece = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("response") - 1) / 13).cast("int")), lambda i: F.struct(i.cast("long").alias("seq"), F.substring(data, i * 13 + 1, F.lit(13)).alias("data")))
    path, files = scratch_dir(spark, "pieces"), max(8, spark.sparkContext.defaultParallelism)
    responses = written(sse.assemble(whole.unionByName(ends)), "responses")  # whole ones are dealt out, and cut where they arrive
    texts = responses.select(F.col("request_id").cast("string").alias("request_id"), "response").repartition(files, "request_id")
    texts = texts.select("request_id", F.explode(piece).alias("p"), F.octet_length("response").alias("n"))
    for half in (F.col("p.seq") * 26 < F.col("n"), F.col("p.seq") * 26 >= F.col("n")):
        texts.filter(half).select("request_id", "p.seq", "p.data").write.mode("append").parquet(path)
    stream = spark.readStream.schema("request_id string, seq long, data binary").option("maxFilesPerTrigger", files).parquet(path)
    out = scratch_dir(spark, "events")
    query = sse.decode_stream(stream, remembered=None).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_dir(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("request_id string, i long, kind string, payload string").parquet(out).withColumn("request_id", F.col("request_id").cast("long"))


#: File names of the tree that documents become, by doc_id modulo 9, in order.
TREE_NAMES = ("{}.py", "{}/README.md", "{}.PNG", "node_modules/{}.js", "{}/x.egg-info/y.txt", "_{}/.env", "{}.R", "a/b/{}.go", "{}/Makefile")
TREE_FILES = 60


def tree_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as the files of a tree (some with a NUL, malformed or empty), scanned, capped and ranked."""
    docs = table(spark, sf_dir, "documents")
    names = F.element_at(F.array(*[F.lit(n) for n in TREE_NAMES]), (F.col("doc_id") % len(TREE_NAMES) + 1).cast("int"))
    before = F.when(F.col("doc_id") % 11 == 0, F.lit(b"a\0")).when(F.col("doc_id") % 17 == 0, F.lit(b"\xff")).otherwise(F.lit(b""))
    content = F.when(F.col("doc_id") % 13 == 0, F.lit(b"")).otherwise(F.concat(before, F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    files = docs.select(F.concat("source", F.lit("/"), F.replace(names, F.lit("{}"), F.col("doc_id").cast("string"))).alias("path"), content.alias("content"))
    root = scratch_dir(spark, "tree")
    if not root.startswith(("file:", "/")):
        raise ValueError("a tree of files needs a shared folder that all executors mount")
    root = "/" + root.removeprefix("file:").lstrip("/")
    write_tree(files, root)
    tree = written(scan.scan_tree(spark, root), "scanned")
    ranked = scan.rank(scan.cap(tree, TREE_FILES)).select("path", F.col("rank").cast("long").alias("rank"))
    return tree.select("path", "size", "language", F.md5("preview").alias("preview_md5")).join(ranked, "path", "left")


def uri_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.concat(F.col("url"), F.lit(" é'(x)*~!+%20 語"))
    return table(spark, sf_dir, "pages").select("page_id", t.encode_uri(odd).alias("encoded"), t.decode_uri(t.encode_uri(odd)).alias("decoded"))


def project_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects as JSON rows, read back: even ones from memory, the others from the table while they are live."""
    u = uploads(spark, sf_dir)
    number = F.substring("id", 4, 9).cast("int")
    rows = store.project_rows(scan.project_meta(ranked_files(spark, sf_dir, v.MAX_FILES)), F.lit(None).cast("timestamp"))
    rows = written(rows.withColumn("created_at", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(number % 10)), "projects")
    wanted = u.groupBy(F.col("project").alias("id")).agg(F.max("path").alias("path"))
    found = store.resolve(wanted, rows.filter(number % 2 == 0), rows, F.lit("2024-01-12").cast("timestamp"))
    found = store.files_of(found, store.file_rows(scan.contents(u)))
    return found.select("id", F.col("data").isNotNull().alias("found"), F.get_json_object("data", "$.total_files").cast("long").alias("total_files"), t.content_hash("content").alias("content_hash"))


def project_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as uploads that become projects with random ids; every path is looked up again in the stored files."""
    u = uploads(spark, sf_dir).withColumnRenamed("project", "upload").withColumn("relative", F.col("path"))
    saved = store.save_uploads(u, F.lit(KEPT_AT).cast("timestamp"))
    projects, files = written(saved.projects, "projects"), written(saved.files, "project-files")
    looked = store.files_of(files.select("id", "path").join(projects, "id"), files)
    total = F.get_json_object("data", "$.total_files").cast("long")
    return looked.select(F.get_json_object("data", "$.name").alias("name"), "path", total.alias("total_files"), (F.length("id") == 12).alias("has_id"), t.content_hash("content").alias("content_hash"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (file_scan, project_rank_cap, content_key, overview_key, project_meta, reject_audit, file_content_lookup, language_histogram, quota_daily, quota_daily_default, quota_counts, ttl_cache_replay, replay_combined, replay_combined_default, cache_upsert, cache_lookup, annotation_lookup, annotation_labels, overview_prompt, annotation_prompt, url_parse, html_preview, json_extract, typed_annotations, chunk_assembly, sse_roundtrip, completed_annotations, ui_columns, project_rank_cap_default, overview_key_default, project_meta_default, overview_prompt_default, html_preview_default, cache_lookup_default, overview_flow, cached_replay, annotate_flow, sse_stream_decode, tree_project, uri_coding, project_store, project_uploads)}

_client = rf"""CASE WHEN strlen(content) > {v.MAX_FILE_SIZE} THEN 'too_large' WHEN starts_with({_name('path')}, '.') THEN 'dot_file' WHEN contains(content, chr(0)) THEN 'binary' END"""
_notes = f"""n AS (SELECT ord AS doc_id, unnest(range(1, len({_lines('content')}) + 1)) AS line FROM u),
a AS (SELECT doc_id, CAST(line AS INT) AS line_start, CAST(line + doc_id % 3 AS INT) AS line_end, 'note ' || line AS annotation FROM n WHERE line % 2 = 1)"""
_quote = lambda s: "'" + s.replace("'", "''") + "'"
_ann = lambda most: f"""replace({_quote(prompts.ANNOTATE_HEAD)}, '{{language}}', language) || CASE WHEN len({_lines('content')}) > {most} THEN array_to_string(list_slice({_lines('content')}, 1, {most}), chr(10)) ELSE content END || chr(10) || '```' || CASE WHEN len({_lines('content')}) > {most} THEN chr(10) || chr(10) || '(The file has ' || len({_lines('content')}) || ' lines; the first {most} are shown.)' ELSE '' END || {_quote(prompts.ANNOTATE_TAIL)}"""
_log = "l AS (SELECT event_id, ts, user_id AS client, event_type, props FROM events)"
_quota = lambda free, limit: f"""WITH {_log}, b AS (SELECT event_id, {free} AS free, sum(CASE WHEN {free} THEN 0 ELSE 1 END) OVER (PARTITION BY client, CAST(ts AS DATE) ORDER BY ts, event_id) - CASE WHEN {free} THEN 0 ELSE 1 END AS before FROM l)
SELECT event_id, free OR before < {limit} AS allowed, CAST(greatest(0, {limit} - before) AS BIGINT) AS remaining FROM b"""  # noqa: E731

SQL: dict[str, str] = {
    "file_scan": f"WITH {_scanned} SELECT project, ord, path, size, language, preview FROM s",
    "project_rank_cap": f"WITH {_ranked} SELECT project, ord, path, rank FROM k",
    "content_key": f"WITH {_uploads} SELECT ord, {_hash('content')} AS content_hash, 'annotate:' || {_hash('content')} AS cache_key, substr(md5(path), 1, 12) AS path_hash FROM u",
    "overview_key": f"WITH {_ranked} SELECT project, 'overview:' || {_hash("string_agg(path || ':' || size, '|' ORDER BY rank)")} AS cache_key FROM k GROUP BY project",
    "project_meta": f"WITH {_ranked} SELECT project, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_size, string_agg(path || ':' || language || ':', '|' ORDER BY rank) AS files FROM k GROUP BY project",
    "reject_audit": f"""WITH {_uploads} SELECT ord, {_reason} AS upload_reason,
  CASE WHEN len(list_filter(list_slice(string_split(path, '/'), 1, -2), lambda d: d IN ({_list(v.SKIP_DIRS)}) OR d LIKE '%.egg-info')) > 0 THEN 'directory' WHEN {_ext('path')} IN ({_list(v.SKIP_EXTENSIONS)}) THEN 'extension'
       WHEN strlen(content) > {v.MAX_FILE_SIZE} THEN 'too_large' WHEN content = '' THEN 'empty' WHEN contains(left(content, {v.SNIFFED_BYTES}), chr(0)) THEN 'binary' END AS tree_reason, {_client} AS client_reason FROM u""",
    "file_content_lookup": f"""WITH {_scanned}, w AS (SELECT DISTINCT project, path FROM u),
st AS (SELECT project, path, arg_max(content, ord) AS content FROM u GROUP BY ALL), lg AS (SELECT project, path, arg_min(language, ord) AS language FROM s GROUP BY ALL),
j AS (SELECT w.project, w.path, language, content FROM w LEFT JOIN st USING (project, path) LEFT JOIN lg USING (project, path))
SELECT project, path, coalesce(language, 'unknown') AS language, coalesce(language, 'python') AS annotation_language, {_hash('content')} AS content_hash FROM j""",
    "language_histogram": f"WITH {_scanned} SELECT language, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_size FROM s GROUP BY language",
    "quota_daily": _quota("(event_type = 'signup')", QUOTA),
    "quota_daily_default": _quota("false", v.DAILY_QUOTA),
    "quota_counts": f"WITH {_log} SELECT client, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS requests FROM l GROUP BY ALL",
    "ttl_cache_replay": f"""WITH RECURSIVE {_log}, m(props, ts, event_id) AS (
  SELECT * FROM (SELECT props, ts, event_id FROM l QUALIFY row_number() OVER (PARTITION BY props ORDER BY ts, event_id) = 1)
  UNION ALL
  SELECT * FROM (SELECT l.props, l.ts, l.event_id FROM l JOIN m ON l.props = m.props AND l.ts > m.ts + to_seconds({v.CACHE_TTL_SECONDS}) QUALIFY row_number() OVER (PARTITION BY l.props ORDER BY l.ts, l.event_id) = 1))
SELECT event_id, event_id NOT IN (SELECT event_id FROM m) AS hit FROM l""",
    "cache_upsert": f"WITH {_log} SELECT client AS key, event_type || '-' || event_id AS value, epoch_us(ts) AS created_at FROM l QUALIFY row_number() OVER (PARTITION BY client ORDER BY ts DESC, event_id DESC) = 1",
    "cache_lookup": f"""WITH {_log}, c AS (SELECT client, CASE WHEN event_id % 3 = 0 THEN '{{}}' ELSE props END AS value, ts FROM l WHERE event_id % 10 < 3 QUALIFY row_number() OVER (PARTITION BY client ORDER BY ts DESC, event_id DESC) = 1),
j AS (SELECT event_id, c.value, coalesce(l.ts - c.ts <= to_seconds({v.CACHE_TTL_SECONDS}) AND c.value NOT IN ('{{}}', '[]'), false) AS hit FROM l LEFT JOIN c USING (client) WHERE event_id % 10 >= 3)
SELECT event_id, hit, CASE WHEN hit THEN value END AS value FROM j""",
    "annotation_lookup": f"WITH {_uploads}, {_notes} SELECT n.doc_id, CAST(n.line AS INT) AS line, arg_min(annotation, line_start) AS annotation FROM n LEFT JOIN a ON a.doc_id = n.doc_id AND n.line BETWEEN line_start AND line_end GROUP BY ALL",
    "annotation_labels": f"WITH {_uploads}, {_notes} SELECT doc_id, line_start, 'L' || line_start || CASE WHEN line_end <> line_start THEN '-' || line_end ELSE '' END AS label FROM a",
    "overview_prompt": f"""WITH {_ranked}, p AS (SELECT *, {_strip('preview')} AS x FROM k),
q AS (SELECT project, rank, '### ' || path || ' (' || language || ', ' || size || ' bytes)' || chr(10) || CASE WHEN x = '' THEN '(empty)' ELSE '```' || chr(10) || CASE WHEN length(x) > {v.PROMPT_PREVIEW_CHARS} THEN substr(x, 1, {v.PROMPT_PREVIEW_CHARS}) || {_quote(prompts.CUT)} ELSE x END || chr(10) || '```' END AS part FROM p)
SELECT project, {_quote(prompts.OVERVIEW_HEAD)} || string_agg(part, chr(10) || chr(10) ORDER BY rank) || {_quote(prompts.OVERVIEW_TAIL)} AS prompt FROM q GROUP BY project""",
    "annotation_prompt": f"WITH {_scanned} SELECT ord, {_ann(v.ANNOTATED_LINES)} AS prompt, md5({_ann(PAIR_LINES)}) AS short_prompt_md5 FROM s",
    "url_parse": r"""WITH l AS (SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN 'http://' ELSE 'https://' END || CASE WHEN page_id % 7 = 0 THEN 'example.org/' ELSE 'github.com/' END || 'o' || page_id % 11 || '/r' || page_id || ['', '.git', '.git/', '/tree/main', '.github.io', '//'][page_id % 6 + 1] AS link FROM pages),
p AS (SELECT *, string_split(regexp_replace(regexp_replace(link, '/+$', ''), '\.git$', ''), '/') AS parts FROM l),
i AS (SELECT *, coalesce(list_position(parts, 'github.com'), 0) AS n FROM p),
o AS (SELECT *, CASE WHEN n > 0 AND len(parts) >= n + 2 THEN parts[n + 1] END AS owner, CASE WHEN n > 0 AND len(parts) >= n + 2 THEN parts[n + 2] END AS repo FROM i)
SELECT page_id, regexp_matches(link, '^https?://github\.com/.+/.+') AS is_repo, owner, repo, 'https://github.com/' || owner || '/' || repo || '.git' AS clone_url, concat_ws('_', owner, repo, substr(md5(link), 1, 12)) AS folder,
       replace(string_split(regexp_replace(link, '/+$', ''), '/')[-1], '.git', '') AS name, replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '.git', '') AS page_name FROM o""",
    "html_preview": f"WITH h AS (SELECT page_id, coalesce(html, '') AS html FROM pages) SELECT page_id, array_to_string(list_slice({_lines('html')}, 1, {PAIR_LINES}), chr(10)) AS preview, CAST(len({_lines('html')}) AS INT) AS lines, {_strip('html')} AS stripped FROM h",
    "json_extract": """SELECT event_id, ['object', 'object', 'object', 'array', 'none', 'array'][event_id % 6 + 1] AS kind,
  [props, props, props, '[1]', NULL, '[' || props || ', ' || props || ']'][event_id % 6 + 1] AS value, event_id % 6 < 3 AS overview, event_id % 6 IN (3, 5) AS annotations FROM events""",
    "chunk_assembly": "SELECT conv_id AS request_id, string_agg(text, '' ORDER BY turn) AS response FROM conversations GROUP BY conv_id",
    "sse_roundtrip": "SELECT conv_id AS request_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, 'chunk' AS kind, text AS payload FROM conversations",
    "completed_annotations": f"WITH {_scanned} SELECT ord, 'array' AS kind, length(content) || ' characters' AS annotation, CAST(NULL AS VARCHAR) AS error FROM s",
    "ui_columns": f"""WITH {_uploads}, pn AS (SELECT project, coalesce(arg_max(string_split(path, '/')[1], ord) FILTER (ord % 4 < 2), 'untitled') AS project_name FROM u GROUP BY project)
SELECT ord, CASE WHEN ord % 4 < 2 THEN path ELSE {_name('path')} END AS client_path, CASE WHEN ord % 3 = 0 THEN '10.0.0.' || ord % 250 WHEN ord % 2 = 0 THEN '192.168.0.1' ELSE 'unknown' END AS client_ip,
  ['high', 'medium', 'other', 'other'][ord % 4 + 1] AS icon, CASE WHEN {_language('path')} IN ({_list(v.HIGHLIGHTED)}) THEN {_language('path')} ELSE 'text' END AS highlight, {_client} AS client_reason, project_name FROM u JOIN pn USING (project)""",
}
#: The same queries with the full number of files to a project.
SQL |= {f"{name}_default": SQL[name].replace(_ranked, _ranked_default) for name in ("project_rank_cap", "overview_key", "project_meta", "overview_prompt")}
SQL["html_preview_default"] = SQL["html_preview"].replace(f"1, {PAIR_LINES})", f"1, {v.PREVIEW_LINES})")

_flow = lambda source: f"""{source},
h AS (SELECT *, missing OR hit OR own_key AS free FROM m),
b AS (SELECT *, sum(CASE WHEN free THEN 0 ELSE 1 END) OVER (PARTITION BY client, CAST(ts AS DATE) ORDER BY ts, request_id) - CASE WHEN free THEN 0 ELSE 1 END AS before FROM h),
a AS (SELECT *, CASE WHEN missing THEN 404 WHEN free OR before < {QUOTA} THEN 200 ELSE 429 END AS status FROM b)"""  # noqa: E731
_live = f"(epoch_us(ts) - epoch_us(TIMESTAMP '{KEPT_AT}') <= {v.CACHE_TTL_SECONDS * 1_000_000})"
_asked = "SELECT event_id AS request_id, ts, user_id AS client, event_type = 'signup' AS own_key"
_prompts = SQL["overview_prompt_default"].replace("SELECT project, " + _quote(prompts.OVERVIEW_HEAD), "op AS (SELECT project, " + _quote(prompts.OVERVIEW_HEAD)) + ")"
_projects = _flow(f"""{_prompts.replace("FROM p)" + chr(10) + "op AS", "FROM p)," + chr(10) + "op AS")},
e AS ({_asked}, 'src' || event_id % 23 AS project, event_id % 23 AS number FROM events),
m AS (SELECT e.*, op.prompt, op.prompt IS NULL AS missing, op.prompt IS NOT NULL AND number % 4 = 0 AND {_live} AS hit FROM e LEFT JOIN op USING (project))""")
_step = lambda where, i, kind, payload: f"SELECT request_id, CAST(status AS INT) AS status, CAST({i} AS BIGINT) AS i, '{kind}' AS kind, {payload} AS payload FROM a WHERE {where}"
_told, _raw, _hit = "status = 200 AND NOT hit AND contains(prompt, 'README')", "status = 200 AND NOT hit AND NOT contains(prompt, 'README')", "status = 200 AND hit"
_none = "CAST(NULL AS VARCHAR)"
SQL["overview_flow"] = _projects + chr(10) + " UNION ALL ".join([
    _step(_hit, 0, "result", _quote(KEPT_OVERVIEW)), _step(_hit, 1, "done", _none),
    _step(_told, 0, "chunk", _quote('{"summary": "')), _step(_told, 1, "chunk", "length(prompt) || ' characters'"), _step(_told, 2, "chunk", _quote('"}')),
    _step(_told, 3, "result", _quote('{"summary": "') + " || length(prompt) || " + _quote(' characters"}')), _step(_told, 4, "done", _none),
    _step(_raw, 0, "chunk", "'no '"), _step(_raw, 1, "chunk", "'JSON'"), _step(_raw, 2, "raw", "'no JSON'"), _step(_raw, 3, "done", _none),
    _step("status <> 200", 0, "status", "CAST(status AS VARCHAR)"),
])
SQL["cached_replay"] = f"""{_projects}
SELECT request_id, CAST(0 AS BIGINT) AS i, 'data: {{"result":' || {_quote(KEPT_OVERVIEW)} || '}}' || chr(10) || chr(10) AS event FROM a WHERE hit
UNION ALL SELECT request_id, CAST(1 AS BIGINT) AS i, 'data: [DONE]' || chr(10) || chr(10) AS event FROM a WHERE hit"""
SQL["annotate_flow"] = _flow(f"""WITH {_scanned},
st AS (SELECT project, path, arg_max(content, ord) AS content FROM u GROUP BY ALL), lg AS (SELECT project, path, arg_min(language, ord) AS language FROM s GROUP BY ALL),
e AS ({_asked}, event_id % (SELECT count(*) FROM documents) AS ord FROM events),
q AS (SELECT request_id, ts, client, own_key, coalesce(u.project, 'none') AS project, coalesce(u.path, 'none') AS path FROM e LEFT JOIN u USING (ord)),
w AS (SELECT DISTINCT project, path FROM q),
f AS (SELECT w.project, w.path, st.content, coalesce(lg.language, 'python') AS language FROM w JOIN st USING (project, path) LEFT JOIN lg USING (project, path)),
k AS (SELECT content, arg_min(language, project || chr(1) || path) AS language FROM f GROUP BY content),
pr AS (SELECT content, length({_ann(v.ANNOTATED_LINES)}) AS n FROM k),
ca AS (SELECT content, max(CASE WHEN ord % 10 = 0 THEN {_quote(KEPT_NOTES)} ELSE '[]' END) AS kept FROM u WHERE ord % 5 = 0 GROUP BY content),
m AS (SELECT q.*, f.language, pr.n, f.content IS NULL AS missing, coalesce(ca.kept <> '[]' AND {_live}, false) AS hit
      FROM q LEFT JOIN f USING (project, path) LEFT JOIN pr ON pr.content = f.content LEFT JOIN ca ON ca.content = f.content)""") + f"""
SELECT request_id, CAST(status AS INT) AS status, CASE WHEN status = 200 THEN language END AS language,
  CASE WHEN status <> 200 THEN NULL WHEN hit THEN {_quote(KEPT_NOTES)} ELSE {_quote('[{"line_start": 1, "line_end": 1, "annotation": "')} || n || {_quote(' characters"}]')} END AS annotations,
  CASE WHEN status = 200 THEN CAST(1 AS BIGINT) END AS n_annotations FROM a"""
SQL["sse_stream_decode"] = SQL["sse_roundtrip"]
SQL["tree_project"] = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source || '/' || replace([{_list(TREE_NAMES)}][doc_id % {len(TREE_NAMES)} + 1], '{{}}', CAST(doc_id AS VARCHAR)) AS path FROM documents),
c AS (SELECT path, CASE WHEN doc_id % 11 <> 0 AND doc_id % 17 = 0 THEN chr(65533) || text ELSE text END AS content, CAST(strlen(text) + CASE WHEN doc_id % 11 <> 0 AND doc_id % 17 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size
      FROM d WHERE doc_id % 13 <> 0 AND doc_id % 11 <> 0),
s AS (SELECT path, size, {_language('path')} AS language, md5(CASE WHEN {_config('path')} THEN content ELSE array_to_string(list_slice({_lines('content')}, 1, {v.PREVIEW_LINES}), chr(10)) END) AS preview_md5
      FROM c WHERE size BETWEEN 1 AND {v.MAX_FILE_SIZE} AND {_ext('path')} NOT IN ({_list(v.SKIP_EXTENSIONS)}) AND NOT contains(path, '/node_modules/') AND NOT contains(path, '.egg-info/')),
p AS (SELECT path FROM (SELECT path, row_number() OVER (ORDER BY list_slice(string_split(path, '/'), 1, -2), string_split(path, '/')[-1]) AS place FROM s) WHERE place <= {TREE_FILES}),
k AS (SELECT path, row_number() OVER (ORDER BY CASE WHEN {_config('path')} THEN 0 ELSE 1 END, path) AS rank FROM p)
SELECT path, size, language, preview_md5, rank FROM s LEFT JOIN k USING (path)"""
SQL["uri_coding"] = """WITH o AS (SELECT page_id, url || ' é''(x)*~!+%20 語' AS x FROM pages)
SELECT page_id, replace(replace(replace(replace(replace(url_encode(x), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*') AS encoded, x AS decoded FROM o"""
SQL["project_store"] = f"""WITH {_scanned}, st AS (SELECT project, path, arg_max(content, ord) AS content FROM u GROUP BY ALL),
w AS (SELECT project AS id, max(path) AS path, CAST(substr(project, 4) AS INT) AS number FROM u GROUP BY project),
n AS (SELECT project AS id, least(count(*), {v.MAX_FILES}) AS total_files FROM s GROUP BY project),
j AS (SELECT w.id, n.total_files, st.content, n.total_files IS NOT NULL AND (number % 2 = 0 OR number % 10 >= 4) AS found FROM w LEFT JOIN n USING (id) LEFT JOIN st ON st.project = w.id AND st.path = w.path)
SELECT id, found, CASE WHEN found THEN total_files END AS total_files, CASE WHEN found THEN {_hash('content')} END AS content_hash FROM j"""
SQL["cache_lookup_default"] = f"""WITH {_log}, c AS (SELECT client, CASE WHEN event_id % 3 = 0 THEN '{{}}' ELSE props END AS value, ts FROM l QUALIFY row_number() OVER (PARTITION BY client ORDER BY ts DESC, event_id DESC) = 1),
j AS (SELECT event_id, c.value, coalesce(epoch_us(l.ts) + (event_id % 15) * 86400000000 - epoch_us(c.ts) <= {v.CACHE_TTL_SECONDS * 1_000_000} AND c.value NOT IN ('{{}}', '[]'), false) AS hit FROM l LEFT JOIN c USING (client))
SELECT event_id, hit, CASE WHEN hit THEN value END AS value FROM j"""
_replay = lambda limit, ttl: f"""WITH RECURSIVE l AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ts, event_id) AS i, event_id, props AS k, user_id AS client, CAST(ts AS DATE) AS day, epoch_us(ts) AS us, event_type = 'signup' AS free, event_id % 7 <> 0 AS accepted FROM events),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, false AS hit, true AS allowed, CAST(0 AS BIGINT) AS remaining, CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)) AS entries, CAST(MAP {{}} AS MAP(BIGINT, BIGINT)) AS counts, CAST(NULL AS DATE) AS day
  UNION ALL
  SELECT i, event_id, hit, free OR hit OR n < {limit}, greatest(0, {limit} - n), CASE WHEN NOT hit AND accepted AND (free OR n < {limit}) THEN map_concat(entries, map([k], [us])) ELSE entries END,
    CASE WHEN NOT hit AND NOT free AND n < {limit} THEN map_concat(counts, map([client], [n + 1])) ELSE counts END, day
  FROM (SELECT l.*, entries, coalesce(l.us - entries[l.k] <= {ttl * 1_000_000}, false) AS hit, CASE WHEN r.day = l.day THEN r.counts ELSE CAST(MAP {{}} AS MAP(BIGINT, BIGINT)) END AS counts,
               coalesce(CASE WHEN r.day = l.day THEN r.counts[l.client] END, 0) AS n FROM r JOIN l ON l.i = r.i + 1))
SELECT event_id, hit, allowed, remaining FROM r WHERE i > 0"""  # noqa: E731
SQL |= {"replay_combined": _replay(REPLAY_QUOTA, REPLAY_TTL), "replay_combined_default": _replay(v.DAILY_QUOTA, v.CACHE_TTL_SECONDS)}
SQL["project_uploads"] = f"""WITH {_scanned}, st AS (SELECT project, path, arg_max(content, ord) AS content FROM u GROUP BY ALL),
n AS (SELECT project, least(count(*), {v.MAX_FILES}) AS total_files FROM s GROUP BY project), nm AS (SELECT project, coalesce(arg_max(string_split(path, '/')[1], ord), 'untitled') AS name FROM u GROUP BY project)
SELECT name, path, total_files, true AS has_id, {_hash('content')} AS content_hash FROM st JOIN n USING (project) JOIN nm USING (project)"""
SQL["typed_annotations"] = """SELECT event_id, CAST(0 AS INT) AS idx, CAST(CASE WHEN event_id % 5 IN (2, 4) THEN event_id END AS INT) AS line_start, CAST([7, NULL, NULL, event_id, event_id + 4][event_id % 5 + 1] AS INT) AS line_end, event_type AS annotation,
  ['3', event_id::VARCHAR, event_id::VARCHAR, '2.5', event_id::VARCHAR][event_id % 5 + 1] AS raw_start FROM events
UNION ALL SELECT event_id, CAST(i AS INT), NULL, NULL, NULL, NULL FROM events, (VALUES (1), (2)) AS t(i)"""

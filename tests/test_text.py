"""Column functions against Python's own, on random and chosen strings."""

import os
import random
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from tessella.functions import text as t

PIECES = ["a", "b.py", "..", ".", "", "..x", "/", "x.tar.gz", ".env", "a.", "é", "README.md"]
CHARS = ["a", "b", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " ", "\t", " ", "\xa0", "　", "​", "é"]


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string").select("i", expression.alias("y")).collect()
    return [r.y for r in sorted(rows)]


def texts(n=600):
    rng = random.Random(7)
    return ["", *["".join(rng.choice(CHARS) for _ in range(rng.randint(0, 9))) for _ in range(n)]]


def paths(n=600):
    rng = random.Random(8)
    return ["/".join(rng.choice(PIECES) for _ in range(rng.randint(1, 6))) for _ in range(n)]


def test_splitlines_and_strip(spark):
    xs = texts()
    assert column(spark, xs, t.splitlines("x")) == [x.splitlines() for x in xs]
    assert column(spark, xs, t.strip("x")) == [x.strip() for x in xs]


def test_safe_path(spark):
    xs = paths()
    assert column(spark, xs, t.is_safe_path("x")) == [not (os.path.normpath(x).startswith("..") or os.path.isabs(x)) for x in xs]


def test_suffix(spark):
    xs = paths()
    assert column(spark, xs, t.suffix("x")) == [PurePosixPath(x).suffix for x in xs]


def test_language_and_extension(spark):
    xs = ["a.PY", "x.R", ".env", "prod.env", "Makefile", "yarn.lock", "package-lock.json", "A.PNG"]
    assert column(spark, xs, t.language("x")) == ["python", "r", "unknown", "text", "unknown", "unknown", "json", "unknown"]
    assert column(spark, xs, t.is_skipped_extension("x")) == [False, False, False, False, False, True, False, True]


def test_skipped_dirs(spark):
    xs = ["node_modules/x.js", "a/node_modules", "a/b.egg-info/c", "venv/x", "src/venv.py", "a/build/b"]
    assert column(spark, xs, t.in_skipped_dir("x")) == [True, False, True, True, False, True]


def test_urls(spark):
    xs = ["https://github.com/o/r.git/", "https://github.com/o/x.github.io", "https://github.com/o/r/tree/main", "https://example.org/o/r", "https://github.com/o"]
    assert [tuple(x) for x in column(spark, xs, t.repo_parts("x"))] == [("o", "r"), ("o", "x.github.io"), ("o", "r"), (None, None), (None, None)]
    assert column(spark, xs[:3], t.repo_name("x")) == ["r", "xhub.io", "main"]
    assert column(spark, xs, t.is_repo_url("x")) == [True, True, True, False, False]


def test_client_ip_label_and_preview(spark):
    assert column(spark, [" 1.2.3.4 , 5.6.7.8", "", None], t.client_ip("x", F.lit("h"))) == ["1.2.3.4", "h", "h"]
    one = spark.sql("SELECT 4 AS s, 4 AS e UNION ALL SELECT 4, 6").select(t.range_label("s", "e").alias("l")).collect()
    assert sorted(r.l for r in one) == ["L4", "L4-6"]
    long = "\n".join(str(i) for i in range(81))
    assert column(spark, [long], t.preview(F.lit("a.py"), F.col("x")))[0].count("\n") == 79
    assert column(spark, [long], t.preview(F.lit("config.py"), F.col("x"))) == [long]


def test_decode_and_sniff(spark):
    raw = [b"ok", b"\xff\xfea", b"a\xc3", b"\xe2\x82", b"\0x", b"a" * 1023 + b"\0", b"a" * 1024 + b"\0"]
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raw)], "i int, x binary").select("i", t.decode_utf8("x").alias("d"), t.is_binary("x").alias("b")).collect()
    assert [r.d for r in sorted(rows)] == [x.decode("utf-8", "replace") for x in raw]
    assert [r.b for r in sorted(rows)] == [False, False, False, False, True, True, False]

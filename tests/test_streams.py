"""The stream queries against the SQL of their batch forms; scratch tables."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from tessella.plans import streams

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(streams.QUERIES))
def test_stream_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in ("documents", "events", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = streams.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(streams.SQL[name])
    assert sorted(want.columns) == cols
    norm = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert norm(tuple(r[c] for c in cols) for r in got.collect()) == norm(want.select(*[f'"{c}"' for c in cols]).fetchall())


RUN = """
import sys
from pyspark.sql import SparkSession
from tessella import scratch
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
table = scratch.written(spark.range(5), "numbers")
other = scratch.written(spark.range(6), "numbers")
assert table.count() == 5 and other.count() == 6
import os
own = lambda: [os.path.join(sys.argv[1], n) for n in os.listdir(sys.argv[1]) if n.startswith("tessella-")]
assert len(own()) == 1
scratch.discard(other)
folder = own()[0]
assert len(os.listdir(folder)) == 1
if sys.argv[2] == "clear":
    scratch.clear()
    assert own() == []
"""


@pytest.mark.parametrize("how", ["clear", "exit"])
def test_scratch_tables_go_at_the_end(tmp_path, how):
    root = str(Path(__file__).resolve().parents[1])
    run = subprocess.run([sys.executable, "-c", RUN, str(tmp_path), how], capture_output=True, text=True, cwd=root, timeout=120, env=os.environ | {"PYTHONPATH": root})
    assert run.returncode == 0, run.stderr[-1500:]
    assert not [n for n in os.listdir(tmp_path) if n.startswith("tessella-")]


def test_pieces_in_order():
    """Of several batches, out of order, with nulls and with pieces of one seq."""
    import pandas as pd

    from tessella.streaming import sse

    batch = lambda *rows: pd.DataFrame({"seq": [s for s, _ in rows], "data": [d for _, d in rows]})
    assert sse._in_order(iter([batch((0, b"a"), (1, b"b")), batch((2, b"c"))])) == [b"a", b"b", b"c"]
    assert sse._in_order(iter([batch((5, b"f"), (1, None)), batch((3, b"d"), (4, b""))])) == [b"d", b"", b"f"]
    assert sse._in_order(iter([batch((2, b"z"), (1, b"b"), (2, b"a"))])) == [b"b", b"a", b"z"]
    assert sse._in_order(iter([])) == [] == sse._in_order(iter([batch((1, None))]))

"""The tree source's conditions, early ends and unreadable folders; projects as rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessella.operators import scan, store
from tessella.sources import tree
from tessella.sources.tree import read_tree


def make(root, files):
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)


def opened(reader):
    """How many files a reader opens, and what it gives."""
    count, rows, own = 0, [], open

    def counting(*a, **k):
        nonlocal count
        count += 1
        return own(*a, **k)

    tree.open = counting
    try:
        for part in reader.partitions():
            rows += [(path, size) for path, _, size in reader.read(part)]
    finally:
        del tree.open
    return count, rows


def test_a_walk_ends_at_the_cap(tmp_path):
    make(tmp_path, {f"d{i % 40:02}/e{i % 7}/{i:05}.py": b"x" for i in range(5000)} | {"z.py": b"last?", "b.png": b"p"})
    count, rows = opened(tree._Reader({"path": str(tmp_path), "maxFiles": "500"}))
    assert count == 500 and len(rows) == 500
    everything = opened(tree._Reader({"path": str(tmp_path)}))
    assert everything[0] == 5001
    place = lambda p: (p.split("/")[:-1], p.split("/")[-1])
    assert [p for p, _ in rows] == sorted((p for p, _ in everything[1]), key=place)[:500]


def test_conditions(spark, tmp_path):
    make(tmp_path, {f"{d}/{i}.py": b"x" * (i + 1) for d in ("a", "a/b", "c") for i in range(30)})
    read = lambda *where, **options: sorted(r.path for r in read_tree(spark, str(tmp_path), where, **options).select("path").collect())
    some = [("size", ">", 25), ("path", "startswith", "a/b/")]
    assert read(*some) == sorted(f"a/b/{i}.py" for i in range(25, 30))
    assert read(("path", "in", ["c/1.py", "a/2.py", "none"])) == ["a/2.py", "c/1.py"]
    assert read(("path", "=", "a/b/3.py"), ("size", "<=", 3)) == [] and read(("path", "endswith", "/7.py"), ("path", "contains", "b")) == ["a/b/7.py"]
    assert read(("size", "<", 3), maxFiles="3") == ["a/0.py", "a/1.py", "a/b/0.py"]
    assert len(read(("size", "<", 3), maxFileSize="1")) == 3
    reader = tree._Reader({"path": str(tmp_path), "where": json.dumps(some)})
    count, rows = opened(reader)
    assert count == 5 and len(rows) == 5
    listed = []
    reader._listed = lambda folder, own=reader._listed: listed.append(os.path.basename(folder)) or own(folder)
    reader.partitions()
    assert "c" not in listed
    with pytest.raises(ValueError, match="conditions"):
        tree._Reader({"path": str(tmp_path), "where": '[["mode", "=", 1]]'})


def test_unreadable_folders_and_missing_roots(spark, tmp_path, monkeypatch):
    make(tmp_path, {"a.py": b"x", "locked/b.py": b"y", "open/c.py": b"z", "open/locked/d.py": b"w"})
    real = os.scandir

    def scandir(path):
        if os.path.basename(path) == "locked":
            raise PermissionError(path)
        return real(path)

    monkeypatch.setattr(os, "scandir", scandir)
    for parts in (1, 256):
        monkeypatch.setattr(tree, "PARTS", parts)
        assert sorted(p for p, _ in opened(tree._Reader({"path": str(tmp_path)}))[1]) == ["a.py", "open/c.py"]
    monkeypatch.undo()
    assert read_tree(spark, str(tmp_path / "nothing")).count() == 0
    with pytest.raises(ValueError, match="no readable"):
        scan.scan_project(spark, str(tmp_path / "nothing"))


def test_read_back(spark, tmp_path):
    make(tmp_path, {"a.py": b"x\r\ny\rz\n\xff"})
    assert [r.content for r in scan.tree_contents(spark, str(tmp_path)).collect()] == ["x\ny\nz\n�"]


def test_uploads_become_projects(spark):
    schema = "upload string, ord long, path string, content string, relative string"
    rows = [("u", 1, "a.py", "one", "top/a.py"), ("u", 2, "a.py", "two", ""), ("u", 3, "p.png", "png", ""), ("v", 1, "README.md", "r", ""), ("w", 1, "x.png", "only", "")]
    saved = store.save_uploads(spark.createDataFrame(rows, schema), F.lit("2024-01-01").cast("timestamp"))
    names = {r.name: (r.id, r.total) for r in saved.projects.select("id", F.get_json_object("data", "$.name").alias("name"), F.get_json_object("data", "$.total_files").alias("total")).collect()}
    assert set(names) == {"top", "untitled"} and names["top"][1] == "2" and all(len(i) == 12 for i, _ in names.values())
    files = sorted((r.id == names["top"][0], r.path, r.content) for r in saved.files.collect())
    assert files == [(False, "README.md", "r"), (True, "a.py", "two"), (True, "p.png", "png")]
    with pytest.raises(ValueError, match="uploaded"):
        store.save_uploads(spark.createDataFrame([], schema), F.current_timestamp())


def test_what_is_read_through_stays_in_memory(spark):
    stored = spark.sql("SELECT id, data, CAST(at AS TIMESTAMP) AS created_at FROM VALUES ('a', 'A', '2024-01-01'), ('b', 'B', '2024-01-09'), ('c', 'C', '2024-01-01') AS t(id, data, at)")
    memory = stored.filter("id = 'a'").select("id", "data")
    wanted = spark.sql("SELECT id FROM VALUES ('a'), ('b'), ('b'), ('c'), ('d') AS t(id)")
    found, later = store.read_through(wanted, memory, stored, F.lit("2024-01-12").cast("timestamp"))
    assert sorted((r.id, r.data) for r in found.collect()) == [("a", "A"), ("b", "B"), ("b", "B"), ("c", None), ("d", None)]
    assert sorted(map(tuple, later.collect())) == [("a", "A"), ("b", "B")]
    again, _ = store.read_through(wanted, later, stored, F.lit("2025-01-01").cast("timestamp"))
    assert {(r.id, r.data) for r in again.collect()} == {("a", "A"), ("b", "B"), ("c", None), ("d", None)}
    files = spark.sql("SELECT id, id AS path, data AS content FROM VALUES ('a', 'A'), ('c', 'C') AS t(id, data)")
    got = store.files_of(found.distinct().withColumn("path", F.col("id")), files)
    assert sorted((r.id, r.content) for r in got.collect()) == [("a", "A"), ("b", None), ("c", None), ("d", None)]
    live, of = store.purge_projects(stored, files, F.lit("2024-01-12").cast("timestamp"))
    assert [r.id for r in live.collect()] == ["b"] and of.count() == 0


def test_many_folders_are_few_partitions(tmp_path, monkeypatch):
    make(tmp_path, {f"s{i % 3}/{i}/README.md": b"x" for i in range(400)} | {f"s{i % 3}/{i}.py": b"y" for i in range(20)})
    monkeypatch.setattr(tree, "PARTS", 8)
    reader = tree._Reader({"path": str(tmp_path)})
    assert len(reader.partitions()) <= 8 + 3
    assert len({path for path, _ in opened(reader)[1]}) == 420
    monkeypatch.setattr(tree, "NAMES", 20)
    assert max(len(p.folders) for p in reader.partitions()) <= 20 and len(opened(reader)[1]) == 420

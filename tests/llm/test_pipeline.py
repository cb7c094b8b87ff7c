"""The pipeline on a small folder of documents, stage by stage against brute force."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_documents import oracle
from test_dedup import brute_components, corpus
from test_tokens import assert_gapless, own

import corpus_pipeline
from tessella.llm import jaccard, mixing, quality
from tessella.llm._shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = corpus(n=140, seed=21)
    rows = [(i, " ".join(f"p{i % 90}x{k}" for k in range(60)) + " " + x, "en", ["s1", "s2", "é", None][i % 4 if i % 3 else 0], len(x)) for i, x in base]
    rows += [(1000, None, None, "s1", None), (1001, "", "en", "s2", 0), (1002, "short text", "en", "s1", 10), (1003, rows[5][1] + " \n", "en", "s2", 9), (1004, rows[7][1], "en", "s9", 9), (None, rows[9][1], "en", "s1", 1)]
    path = str(tmp_path_factory.mktemp("sf"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_stages_are_as_asked():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mix sources", "best-fit packing"]


def test_pipeline_against_brute_force(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = {name: f for name, f in corpus_pipeline.STAGES}
    table = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))

    again = lambda df: written(df, "stage")
    good = again(stages["quality rules"](spark, docs, path))
    verdict = {r[0]: r[-1] for r in oracle(quality.QUALITY_SQL, documents=("doc_id BIGINT, text VARCHAR", [(k, r[1]) for k, r in enumerate(rows)])).fetchall()}
    kept = [r for k, r in enumerate(rows) if verdict[k]]
    assert good.columns == COLUMNS and table(good) == sorted(kept, key=lambda r: tuple((x is None, str(x)) for x in r)) and 0 < len(kept) < len(rows)

    single = again(stages["exact dedup"](spark, good, path))
    best = {}
    for r in sorted(kept, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1]), r)
    kept = list(best.values())
    assert single.columns == COLUMNS and Counter(map(str, single.collect())) == Counter(str(x) for x in spark.createDataFrame(kept, docs.schema).collect())

    near = again(stages["near dedup"](spark, single, path))
    groups = brute_components([(r[0] if r[0] is not None else 1 << 62, r[1]) for r in kept], jaccard.Rule(5, 80, 100))
    stay = {i for i, _, c in groups if i == c}
    kept = [r for r in kept if (r[0] if r[0] is not None else 1 << 62) in stay]
    assert near.columns == COLUMNS and sorted((r.doc_id for r in near.collect()), key=str) == sorted((r[0] for r in kept), key=str) and len(kept) < len(groups)

    mixed = again(stages["mix sources"](spark, near, path))
    taken = oracle(mixing.MIX_SQL, documents=("doc_id BIGINT, text VARCHAR, source VARCHAR", [(r[0], r[1], r[3]) for r in kept])).fetchall()
    copies = Counter({r[0]: r[4] // r[1] for r in taken if r[4]})
    assert mixed.columns == COLUMNS and Counter(r.doc_id for r in mixed.collect()) == copies

    packed = [r.asDict() for r in corpus_pipeline.run(spark, path).collect()]
    texts = {r[0]: r[1] for r in kept}
    length = {i: len(ids) + 1 for i, ids in zip(texts, own(list(texts.values())))}
    assert Counter({i: sum(r["length"] for r in packed if r["doc_id"] == i) for i in texts}) == Counter({i: length[i] * copies[i] for i in texts})
    total = sum(length[i] * copies[i] for i in texts)
    assert -(-total // 1024) <= assert_gapless(packed, 1024) <= 1.1 * total / 1024 + 2


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    path, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_leave_other_columns_alone(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(60)
    odd = ["_id", "_hash", "norm", "copies", "n", "Hash", "place", "keep_text", "rate", "kept", "size"]
    docs = docs.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in odd])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, path), "stage")
        assert docs.columns == [*COLUMNS, *odd], name
        assert all(r[c] == f"{c}{'-' if r.doc_id is None else r.doc_id}" for r in docs.collect() for c in odd)
    assert docs.count() > 0

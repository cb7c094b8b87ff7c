"""Tokens, token files and packing against the library itself."""

import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import _shared, packing, tokenbin
from tessella.llm._shared import scratch_dir, text_buffers
from tessella.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b", "", "a   b c", "x \n y", "\n\n a b ", " a", "  ", "don't 's x", "a\xa0 \xa0 b", "tab\t b", None, "é b  c\n\n d", "a.\nB c, d.\n", "x..\ny' z, É.", ".", "a.b. c!", "　 x \x85 y", "<|endoftext|> a", "hello <|endoftext|> world. <|endoftext|>", "a.<|endoftext|>  b", "x  <|endoftext|>\n y <|endof text|>", "<|endoftext|><|endoftext|>", "a\x1cb c", "﻿a b", "‘a’ “b”. c…"]


def own(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_blocks_equal_the_library():
    rng = random.Random(1)
    bits = [*"ab.,'s \n\t é!1 Q", "\xa0", "\u3000", "\x1c", "<|endoftext|>", "<|endof"]
    for window in (64, 100, 1 << 19):  # short windows: pieces and marks over their ends
        enc = Encoder(PATH, slots=1 << 10, window=window)
        for trial in range(60):
            texts = ODD if trial < 2 else ["".join(rng.choice(bits) for _ in range(rng.randint(0, 80))) for _ in range(20)]
            ids, at = enc.block(*text_buffers(pa.array(texts, pa.string())))
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == own(texts)


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 23, x) for i, x in enumerate(ODD)] + [(100, "word " * 3000), (5, "b"), (5, "b"), (None, "null id")]
    return rows, spark.createDataFrame([(i, x, "s", 1) for i, x in rows], "doc_id long, text string, tokens string, part int")


def test_token_files(spark, docs):
    rows, df = docs
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenbin.token_ids(df, PATH).collect())
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    at, want = 0, []
    for (i, _), ids in zip(rows, own([x for _, x in rows])):
        ids = [*ids, 2]
        want.append((at, i, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    assert tokenbin.token_ids(df.limit(0), PATH).count() == 0


def test_equal_ids_spread_over_files(spark, monkeypatch):
    monkeypatch.setattr(tokenbin, "SAME_IDS", 100)
    rows = [(None if i % 2 else 5, f"text {i}") for i in range(600)] + [(4, "before"), (6, "after")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = scratch_dir(spark, "equal-ids")
    tokenbin.write_token_ids(df, path, PATH, partitions=8)
    back = spark.read.parquet(path)
    assert back.count() == 602
    parts = {r.part: r.n for r in back.filter("doc_id = 5").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert len(parts) > 2 and max(parts.values()) < 250
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokenbin.read_token_digest(spark, path).collect())
    assert [s for s, _, _ in got] == np.cumsum([0, *(n for _, _, n in got)])[:-1].tolist()
    assert [i for _, i, _ in got] == [None] * 300 + [4] + [5] * 300 + [6]


def test_selective_reads(spark):
    import pyarrow.parquet as pq

    text = lambda i: " ".join(str((i * 7919 + k * 104_729) % 99_991) for k in range(200))
    df = spark.createDataFrame([(i, text(i)) for i in range(400)], "doc_id long, text string")
    path = scratch_dir(spark, "selective")
    layout = tokenbin.LAYOUT | {"parquet.block.size": "65536", "parquet.page.size": "4096", "parquet.page.row.count.limit": "20"}
    tokenbin.write_token_ids(df, path, PATH, partitions=1, layout=layout)
    got = {r.doc_id: r.tokens for r in tokenbin.read_tokens(spark, path, [7, 250]).collect()}
    assert got == {i: [*own([text(i)])[0], 2] for i in (7, 250)}
    file = next(p for p in Path(path.removeprefix("file://")).glob("*.parquet") if pq.ParquetFile(p).metadata.num_rows == 400)
    meta = pq.ParquetFile(file).metadata
    assert meta.num_row_groups > 1
    for g in range(meta.num_row_groups):
        columns = {meta.row_group(g).column(k).path_in_schema.split(".")[0]: meta.row_group(g).column(k) for k in range(meta.num_columns)}
        assert all(c.has_offset_index for c in columns.values()) and columns["doc_id"].has_column_index
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and any("DICTIONARY" in e for e in columns["tokens"].encodings)


def test_null_and_repeated_ids_are_dealt_evenly(spark):
    from pyspark.sql import functions as F

    rows = _shared.written(spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), (F.col("id") % 2).cast("int").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(600).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32")), "null-ids")
    packed = packing.pack(rows, 1024, group=2000, rounds=1)
    assert packed.count() == 20_000 and packed.select("sequence_id").distinct().count() == 20_000
    groups = packed.groupBy(F.shiftright("sequence_id", 24).alias("g")).count().collect()
    assert len(groups) == 10 and max(r["count"] for r in groups) < 2400


def test_pieces_and_packing(spark, docs):
    rows, df = docs
    got = [r.asDict() for r in packing.pack_documents(df, PATH, capacity=64, group=30).collect()]
    want = []
    for (i, _), ids in zip(rows, own([x for _, x in rows])):
        ids = [*ids, 2]
        n = -(-len(ids) // 64)
        head = len(ids) - (n - 1) * 64
        cuts = [0, *range(head, len(ids) + 1, 64)]
        want += [(i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    assert_gapless(got, 64)
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def assert_gapless(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_exchange_closes_gaps(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(200, 700, 4000)
    df = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECE)
    packed = packing.pack(df, 1024, group=150)
    rows = [r.asDict() for r in packed.collect()]
    used = assert_gapless(rows, 1024)
    alone = packing.best_fit(lengths.astype(np.int64), 1024)[2]
    assert len(rows) == 4000 and packing.certificate(packed) == (used, packing.lower_bound(lengths, 1024)) and used <= 1.03 * len(alone)


def test_bounds_never_exceed_an_exact_packing():
    rng = random.Random(5)
    for _ in range(300):
        lengths = np.array([rng.randint(1, 12) for _ in range(rng.randint(0, 7))], np.int64)
        assert packing.lower_bound(lengths, 12) <= exact_bins(sorted(lengths.tolist(), reverse=True), 12) <= len(packing.best_fit(lengths, 12)[2])


def exact_bins(lengths, capacity):
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i]:
                go(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best[0]

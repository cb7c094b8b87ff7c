"""Speculated ids against the library, and against merging alone."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import bpe
from tessella.llm._shared import text_buffers

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", "a  b", "a   b c", " \n x", "\n\n a b ", "  ", "don't 's 'll  're x'", "'S 'tis ''s", "\xa0 's \xa0's\n's", "é b  c\n\n d", "　 x \x85 y", "<|endoftext|> a", "a'<|endoftext|>'s  <|endoftext|>", "<|endoftext|><|endoftext|>", "a\x1cb c", "aaaaaaa aaa", "hahahaha", "1'd 2'd!", "\0\0 a\0", "'", "x'", "日本語のテキスト中文 한국어", "🎉👍🏽", "͸՘Ᲊ"]


@pytest.fixture(scope="module")
def own():
    return bpe.Speculator(PATH, slots=1 << 10, window=300)


def ids(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts(own):
    assert [x.tolist() for x in own._many(ODD)] == ids(ODD)
    got, at = own.block(*text_buffers(pa.array([*ODD, None], pa.string())))
    assert [got[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == ids([*ODD, ""])


@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aehinrst '.\n0")), max_size=40), min_size=1, max_size=20))
@settings(max_examples=150, deadline=None)
def test_any_texts(own, texts):
    assert [x.tolist() for x in own._many(texts)] == ids(texts)


def test_every_character(own):
    texts = [f" a{chr(c)}1{chr(c)}! {chr(c)}'s" for c in [*range(0xD800), *range(0xE000, 0x33500), *range(0xE0000, 0xE0200)]]
    assert [x.tolist() for x in own._many(texts)] == ids(texts)


def test_proposals_pairs_and_merging(own):
    v, rng = own.vocabulary, random.Random(2)
    words = ["".join(rng.choice("aehinorst") for _ in range(rng.randint(1, 90))).encode() for _ in range(3000)]
    text, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    got, counts, merged = v.words(text, size)
    assert 0 < merged < len(words)
    parts = np.split(got, np.cumsum(counts)[:-1])
    for word, part in zip(words, parts):
        assert part.tolist() == v._merge(word)
    greedy = v.propose(text, np.cumsum(size), window=50)
    assert v.text(greedy) == b"".join(words)
    # two tokens are compatible exactly if merging their bytes gives them
    a, b = (np.array([rng.randrange(50000) for _ in range(4000)]) for _ in range(2))
    b[:1000] = a[:1000]
    want = [v._merge(v.text(np.array([x, y]))) != [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert v.clashes(a, b).tolist() == want


def test_long_words(own):
    rng = random.Random(3)
    texts = ["a" * 20_000, "ab" * 9000, "ha" * 9000 + "x", "=" * 9999, "0" * 12_345, " " * 10_000 + "x", "".join(rng.choice("abcdefghij") for _ in range(60_000)), "".join(rng.choice("的一是不了人我在有他") for _ in range(9000))]
    assert [x.tolist() for x in own._many(texts)] == ids(texts)


def test_round_trip(spark):
    rows = [(i, x) for i, x in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "null id"), (50, None), (51, "w " * 20_000 + "z" * 5000)]
    docs = spark.createDataFrame([(i, x, [1], "s") for i, x in rows], "doc_id long, text string, ids array<int>, n_tokens string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for (i, x), k in zip(rows, ids([x or "" for _, x in rows])):
        want.append((i, len(k), sha(",".join(map(str, k))), sha(LIBRARY.decode(k, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.round_trip(docs, PATH).collect()), key=str) == sorted(want, key=str)
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_decoding_any_ids(spark):
    cases = [[15496, 995], [50256, 50256], [222, 255, 128], [], [50300, 15496, -1], [447], [447, 247, 447]]
    df = spark.createDataFrame([(i, c, "old") for i, c in enumerate(cases)] + [(99, None, "old"), (98, [15496, None], "old")], "k int, ids array<int>, TEXT string")
    got = {r.k: r.text for r in bpe.decode(df, PATH).collect()}
    assert got == {i: LIBRARY.decode([x for x in c if 0 <= x < 50257], skip_special_tokens=False) for i, c in enumerate(cases)} | {99: "", 98: "Hello"}


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))

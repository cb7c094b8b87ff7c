"""Exact, near and substring dedup against brute force, with hot groups and small limits."""

import hashlib
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from tessella.llm import exact, jaccard, substring

ROWS = [(3, "a b c d e f"), (1, "abcdef"), (2, "A b c d e f"), (7, None), (8, ""), (9, " \n"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "one two"), (6, "One TWO"), (10, "three"), (11, "É a b c d"), (12, "é a b c d")]


def corpus(n=240, seed=11):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "a"] * 20
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 9, 12, 14, 20, 40, 120, 300]))] for _ in range(40)]
    shared = [rng.choice(vocabulary) for _ in range(70)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            at = rng.randrange(len(words) + 1)
            words[at:at] = shared
        if rng.random() < 0.1:
            words *= 2
        out.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "k", "s", 0, "c") for i, x in rows], "doc_id long, text string, key string, hash string, n int, component string")


def test_exact_groups(spark):
    for rows in (ROWS, corpus(), [(i, "same text") for i in range(900)] + [(1000 + i, f"same {i % 3} text") for i in range(60)] + [(999, "same  text "), (998, " sametext ")]):
        groups = defaultdict(list)
        for i, x in rows:
            groups[re.sub(r"[\x20\x09-\x0D]", "", x or "")].append((-len(x or ""), i))
        want = []
        for norm, members in groups.items():
            members.sort()
            sha = hashlib.sha256(norm.encode()).hexdigest()
            want += [(i, members[0][1], len(members), k == 0, sha) for k, (_, i) in enumerate(members)]
        got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(frame(spark, rows)).collect()]
        assert sorted(got) == sorted(want)
    assert exact.exact_groups(frame(spark, ROWS).limit(0)).count() == 0


def test_drop_copies_keeps_columns(spark):
    df = frame(spark, ROWS)
    kept = exact.drop_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 9, 10, 11, 12]
    assert exact.exact_groups(frame(spark, [(None, "x"), (2, "x")])).filter("kept").first().doc_id == 2


def shingles(text, k):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = raw.split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, rule):
    sets = {i: shingles(x, rule.words) for i, x in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and rule.den * both >= rule.num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


@pytest.mark.parametrize("rule", [jaccard.Rule(4, 85, 100), jaccard.Rule(5, 80, 100), jaccard.Rule(2, 60, 100)])
def test_components(spark, rule):
    for rows in (corpus(seed=rule.words), list(dict(ROWS).items())):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(frame(spark, rows), rule, block=16).collect())
        assert got == brute_components(rows, rule)
    assert jaccard.near_groups(frame(spark, ROWS).limit(0), rule).count() == 0


def test_families_of_near_copies(spark):
    """Two unlinked families with chains in them, in one task: dense lists, chunks of lists, and components across them."""
    rng = random.Random(8)
    shared, rows = [f"c{k}" for k in range(60)], []
    for half in range(2):
        base = [f"h{half}w{k}" for k in range(40)] + shared
        for i in range(350):
            if i % 50 == 0:  # the chain goes on from the last copy
                words = list(base if i == 0 else words)
            else:
                words = list(base) if i % 3 else list(words)
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(100)] = f"x{rng.randrange(3000)}"
            rows.append((half * 1000 + i, " ".join(words)))
    for rule in (jaccard.Rule(5, 80, 100), jaccard.Rule(4, 85, 100)):
        for parts in (1, 3):
            got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(frame(spark, rows).coalesce(parts), rule, block=64).collect())
            assert got == brute_components(rows, rule)


def test_all_links(spark):
    rule = jaccard.Rule(3, 70, 100)
    rows = corpus(n=120, seed=5)
    links, members = jaccard.similar_pairs(frame(spark, rows).coalesce(1), rule, block=16)
    node = {r.doc_id: r.node for r in members.collect()}
    sets = {node[i]: shingles(x, 3) for i, x in rows}
    assert len(set(node.values())) == len(set(sets.values())) == len(sets)
    ids = sorted(sets)
    want = {(a, b) for n, b in enumerate(ids) for a in ids[:n] if 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in links.collect()} == want and len(want) > 50


def test_keep_one_leaves_columns_alone(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", 7, 8, 9, "x"), (2, "a b c d e f g", 1, 2, 3, "y"), (3, "other", 4, 5, 6, "z")], "doc_id long, text string, _id int, _hash int, ID int, hash string")
    df = df.withColumnRenamed("ID", "component")
    assert sorted(map(tuple, jaccard.keep_one(df).collect())) == [(1, "a b c d e f g", 7, 8, 9, "x"), (3, "other", 4, 5, 6, "z")]
    odd = df.toDF("doc_id", "text", "n", "norm", "prefix", "place")
    assert sorted(map(tuple, exact.drop_copies(odd).collect())) == [(1, "a b c d e f g", 7, 8, 9, "x"), (3, "other", 4, 5, 6, "z")]


def test_drop_copies_of_hot_texts(spark):
    rows = [(i if i % 7 else None, "same  text" if i % 5 else "same text", i) for i in range(1200)] + [(5000 + i, f"text {i}", i) for i in range(30)]
    kept = exact.drop_copies(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(6)).collect()
    assert len(kept) == 31 and sorted(r.doc_id for r in kept)[0] == 1 and {r.text for r in kept if r.doc_id == 1} == {"same  text"}


def test_runs_over_windows():
    import numpy as np
    import pyarrow as pa

    from tessella.llm import _shared

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é\n語C") for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(60)]
    offsets, raw = _shared.text_buffers(pa.array(texts))
    whole = _shared.runs(offsets, raw, _shared._IS_SPACE, chars=True)
    for window in (1, 2, 7, 64):
        for a, b in zip(whole, _shared.runs(offsets, raw, _shared._IS_SPACE, chars=True, window=window)):
            assert np.array_equal(a, b)
    words = [w for t in texts for w in t.encode().split()]
    assert [bytes(raw[a:b]) for a, b in zip(whole[0], whole[1])] == words and whole[3].tolist() == [len(w.decode()) for w in words]
    assert len(set(whole[2].tolist())) == len(set(words))


def test_near_edge_rows(spark):
    rows = [(None, "x y z u v w"), (2, "x y z u v w"), (2, "x y z u v w"), (5, None), (6, "")]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, 2, 2), (2, 2, 2), (2, 2, 2), (5, 0, 5), (6, 0, 6)], key=str)
    df = frame(spark, rows)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 2, 5, 6]


def test_every_link_meets_in_a_signature():
    import numpy as np

    rng = np.random.default_rng(2)
    rule = jaccard.Rule(4, 85, 100)
    for boundary in (4, 13):
        classes = rule.classes(boundary, 500)
        for size in (2, 5, 8, 12, 13, 14, 15, 18, 27, 60, 200, 400):
            for _ in range(15):
                a = rng.integers(0, 1 << 62, size).astype(np.uint64)
                b = a.copy()
                while True:  # as different as a link allows
                    c = b[1:] if rng.random() < 0.4 else np.append(b[1:] if rng.random() < 0.6 else b, rng.integers(0, 1 << 62, 1).astype(np.uint64))
                    both = len(np.intersect1d(a, c))
                    if rule.den * both < rule.num * (len(a) + len(c) - both):
                        break
                    b = c
                h = np.concatenate([np.sort(a), np.sort(b)])
                d = np.repeat([0, 1], [len(a), len(b)])
                doc, key = jaccard.signatures(rule, boundary, classes, d, h, np.array([len(a), len(b)]))
                assert np.intersect1d(key[doc == 0], key[doc == 1]).size


def brute_repeats(rows, window):
    words = [(i, (x or "").encode().split()) for i, x in rows]
    first = {}
    for i, w in sorted(words, key=lambda r: r[0]):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("group_words", [50_000, 300])
def test_substring_dedup(spark, group_words):
    rows = [*corpus(), (500, None), (501, ""), (502, "x " * 200), (503, "x " * 60)]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(frame(spark, rows), group_words=group_words).collect())
    assert got == brute_repeats(rows, 50)


def test_substring_edge_rows(spark):
    long = " ".join(f"v{i}" for i in range(60))
    rows = [(2, long), (2, long), (None, long), (1, long[:-4])]
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(2, 60, 59), (2, 60, 59), (None, 60, 60), (1, 59, 0)], key=str)
    assert substring.remove_repeats(frame(spark, rows).limit(0)).count() == 0
    # rows of one id: the same words with other white space lose the same, other words lose what they repeat of smaller ids
    w = " ".join(f"w{i}" for i in range(60))
    rows = [(1, w + " y"), (5, "x " + w), (5, "x  " + w), (5, w + " z z"), (None, "x\t" + w), (None, "q " + w)]
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, 61, 0), (5, 61, 60), (5, 61, 60), (5, 62, 60), (None, 61, 61), (None, 61, 60)], key=str)


def test_repeats_of_one_word(spark):
    rows = [(i, "w " * (45 + i % 30)) for i in range(1500)] + [(9000, "w " * 40_000), (9001, "v " * 3000), (9002, "u " + "v " * 2000)]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(frame(spark, rows)).collect())
    assert got == sorted(brute_repeats(rows, 50))


def test_a_pair_of_many_lists_is_named_once():
    """Each list in a task of its own: what one task remembers is of no use to another."""
    rng = random.Random(4)
    nodes = [(k + 1, 1000 + k, 40, bytes(rng.randrange(2) for _ in range(64))) for k in range(12)]
    lists = [5, -3, 9, 70, 12]

    def named(earlier, nearest=None):
        out = []
        for x in lists:
            rows = [(x, 0, 0, 0, node, part, n, cells, sorted(y for y in earlier if y < x)) for node, part, n, cells in nodes]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list("abcdefghi"))
            for b in jaccard._across(jaccard.Rule(4, 30, 100), nearest)(iter([batch])):
                out += zip(b.column(0).to_pylist(), b.column(1).to_pylist())
        return out

    every = named(lists)
    assert len(every) == len(set(every)) > 20
    assert set(named([])) == set(every) == set(named([9, 12]))  # with a part of the earlier lists no pair is lost
    assert len(named(lists, 1)) == len(set(named([], 1)))

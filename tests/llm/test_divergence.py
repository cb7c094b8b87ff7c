"""The divergence audit against its SQL and against sums over all terms."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa

from tessella.llm import divergence as d
from tessella.llm._shared import text_buffers

COLUMNS = "doc_id long, text string, lang string, source string, term string, count int"


def brute(rows, least=10, top=10):
    docs, counts, found = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        lang, source = lang or "", source or ""
        found.add((lang, source))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {x for x, _ in found}:
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        groups = sorted((s for x, s in found if x == lang), key=str.encode)
        total = Counter()
        for s in groups:
            total.update(counts[lang, s])

        def p(c):
            n = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // n for t in kept}

        f = lambda x, y: (x - y) ** 2 // (x + y)
        shares, q = {s: p(counts[lang, s]) for s in groups}, p(total)
        for s in groups:
            pairs = sorted(((-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode(), o) for o in groups if o != s))
            terms = sorted(((-f(shares[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and shares[s][t] > q[t]))[:top]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(ranked, 1)]
    return sorted(out)


def table():
    rng = random.Random(7)
    words = ["Alpha", "beta", "ÉTÉ", "naïve", "日本", "x", "y'z", "Zed9zed", "gamma", "delta", "ΑΒΓ", "a_b"]
    rows = [(" ".join(rng.choices(words, range(1, 13), k=rng.randint(0, 12))), rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "ß", None])) for _ in range(260)]
    return rows + [(None, "en", "empty"), ("", "en", "empty"), ("one two", "xx", "a"), (None, "xx", "b"), ("alone " * 50, "yy", "only")] + [("same text here", "en", "s2")] * 12


def test_audit(spark):
    rows = table()
    docs = spark.createDataFrame([(i % 50, *r, "x", 1) for i, r in enumerate(rows)], COLUMNS).repartition(5)
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in d.audit(docs).collect())
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    assert sorted(con.sql(d.AUDIT_SQL).select("lang, source, part, item, value, rank").fetchall()) == got
    assert d.audit(docs.limit(0)).count() == 0
    few = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in d.audit(docs, least=1, top=3).collect())
    assert few == brute(rows, 1, 3)


def test_shares_of_large_counts(spark):
    cases = [(0, 0, 1), (5, 7, 3), (4 * 10**15, 9 * 10**15, 10**6), (10**15 - 1, 3 * 10**15 + 1, 7)]
    df = spark.createDataFrame(cases, "count long, total long, terms long").select("count", "total", "terms", d.share("count", "total", "terms").alias("p"))
    assert {(r["count"], r.p) for r in df.collect()} == {(c, 1 + 10**9 * (c + 2) // (n + 2 * v)) for c, n, v in cases}


def test_blocks_of_terms():
    texts = pa.array(["ab AB c", "", None, "éa-b", "b", "x" * 100_000], pa.string())
    g, term, count, docs = d.block_terms(*text_buffers(texts), np.array([0, 0, 0, 1, 1, 0]))
    assert sorted(zip(g.tolist(), term.to_pylist(), count.tolist(), docs.tolist())) == [(0, "ab", 2, 1), (0, "c", 1, 1), (0, "x" * 100_000, 1, 1), (1, "b", 2, 2), (1, "éa", 1, 1)]

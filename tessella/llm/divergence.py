"""Source divergence audit by inclusion-exclusion over supports.

Every (lang, source) group gives each kept term of its language a smoothed share in billionths. The
divergence of two groups is a sum over all kept terms, most of which occur in neither or in one of them:

    sum f(p, q)  =  sum over the support of a of f(p, zb)  +  the same with a and b exchanged
                 +  (V - |a| - |b|) * f(za, zb)
                 +  sum over terms in both of  f(p, q) - f(p, zb) - f(za, q) + f(za, zb)

where za and zb are the shares of a term that doesn't occur. The first two sums depend on a group's counts
only, so a histogram of its counts prices them; the third is a constant for a pair; the last is a join of
postings on (lang, term). So no term is looked at for groups that don't have it.

Terms are counted in blocks by Arrow and numpy, and added up by Spark before anything is shuffled. All
arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._shared import byte_slices, lean, text_buffers, written

#: Documents of a language that a kept term is in at least, and terms of a group that are reported.
LEAST_DOCS, TOP = 10, 10
#: Bytes of text whose terms are counted at a time.
BLOCK_BYTES = 4 << 20
_TERM = np.zeros(256, bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def block_terms(offsets: np.ndarray, text: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """group, term, count and documents of the terms of a block of texts (see text_buffers); group has a number for each text."""
    inside = _TERM[text]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    begins = begins[begins > 0] - 1
    last[begins] = inside[begins]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, start, "right") - 1
    at = np.concatenate([[0], np.cumsum(end - start)])
    terms = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(_LOWER[text[inside]]))
    coded = terms.dictionary_encode()
    code, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    cell, count = np.unique(doc * size + code, return_counts=True)  # terms of a document
    cell, of = np.unique(group[cell // size] * size + cell % size, return_inverse=True)  # terms of a group
    counts, docs = np.zeros(len(cell), np.int64), np.bincount(of, minlength=len(cell))
    np.add.at(counts, of, count)
    return cell // size, coded.dictionary.take(pa.array(cell % size)), counts, docs


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs of every term of documents (text, lang, source); nulls count as ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            for a, b in byte_slices(text, BLOCK_BYTES):
                part = batch.slice(a, b - a)
                lang, source = (part.column(i).dictionary_encode() for i in (0, 1))
                many = max(1, len(source.dictionary))
                group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * many + source.indices.to_numpy(zero_copy_only=False)
                g, term, count, docs = block_terms(*text_buffers(part.column(2)), group)
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(g // many)), source.dictionary.take(pa.array(g % many)), term.cast(pa.string()), pa.array(count), pa.array(docs)], names=["lang", "source", "term", "count", "docs"])

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(lean(run), "lang string, source string, term string, count long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: str | Column, total: str | Column, terms: str | Column) -> Column:
    """1 + floor(10**9 * (count + 2) / (total + 2 * terms)), three digits at a time, so that whole numbers serve up to totals of 9 * 10**15; null where there are no terms."""
    count, total, terms = (F.col(x) if isinstance(x, str) else x for x in (count, total, terms))
    below, rest, out = F.nullif(total + 2 * terms, F.lit(0)), count + 2, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + _div(rest * 1000, below)
        rest = rest * 1000 % below
    return out + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)) of two shares."""
    return _div((p - q) * (p - q), p + q)


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, count, lang_count, first of terms in at least `least` documents of their language; first marks one row of each."""
    term = Window.partitionBy("lang", "term")
    seen = term_counts(docs).withColumns({"lang_count": F.sum("count").over(term), "_docs": F.sum("docs").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    return seen.filter(F.col("_docs") >= least).select("lang", "source", "term", "count", "lang_count", "first")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n (terms), total (their counts), terms and lang_total (of the language) of every group that occurs, and zero, the share of a term that doesn't occur in it."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    sums = kept.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("count").alias("total"), F.count_if("first").alias("_first"))
    every = docs.select(empty("lang"), empty("source")).distinct().join(sums, ["lang", "source"], "left").na.fill(0)
    lang = Window.partitionBy("lang")
    every = every.withColumns({"terms": F.sum("_first").over(lang), "lang_total": F.sum("total").over(lang)}).drop("_first")
    return every.withColumn("zero", share(F.lit(0).cast("long"), "total", "terms"))


def _pair(first: str, second: str, value: Column) -> list[Column]:
    a, b = F.col(first), F.col(second)
    return [F.col("lang"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), value.alias("value")]


def pair_divergences(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value of every two groups of a language (a < b): the sum of distances over all kept terms, 0 if there are none."""
    other = groups.select("lang", F.col("source").alias("other"), F.col("n").alias("other_n"), F.col("zero").alias("other_zero"))
    pairs = groups.join(other, "lang").filter(F.col("source") < F.col("other"))
    neither = (F.col("terms") - F.col("n") - F.col("other_n")) * distance(F.col("zero"), F.col("other_zero"))
    constants = pairs.select(_pair("source", "other", F.coalesce(neither, F.lit(0).cast("long"))))

    counts = kept.groupBy("lang", "source", "count").agg(F.count("*").alias("times"))
    priced = counts.join(groups.select("lang", "source", "total", "terms"), ["lang", "source"]).select("lang", "source", "times", share("count", "total", "terms").alias("p"))
    single = priced.join(other, "lang").filter(F.col("source") != F.col("other"))
    single = single.select(_pair("source", "other", F.col("times") * distance(F.col("p"), F.col("other_zero"))))

    posting = kept.join(groups.select("lang", "source", "total", "terms", "zero"), ["lang", "source"]).select("lang", "term", "source", share("count", "total", "terms").alias("p"), F.col("zero").alias("z"))
    again = posting.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("z").alias("y"))
    both = posting.join(again, ["lang", "term"]).filter(F.col("source") < F.col("other"))
    p, q, z, y = (F.col(c) for c in "pqzy")
    shared = both.select(_pair("source", "other", distance(p, q) - distance(p, y) - distance(z, q) + distance(z, y)))

    parts = [x.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for x in (constants, single, shared)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far a language's sources lie apart, and by which terms.

    Part `pair` has each other source of the language, the farthest first; part `term` the `top` kept terms
    that a source has more of than its language. Null text, lang and source count as ''. A row is a document,
    so rows that repeat count each. A group without terms has its pairs, a language without kept terms pairs
    with value 0, and a table without rows no result. Other columns are not read.

    A term has at most one row for each source of its language, so keys of terms are no hot keys; rows of a
    group meet only in its counts, which are combined before the shuffle, and in its ranks, of which each
    task hands on `top`. The table of groups is joined by broadcast if Spark finds its files small.
    """
    kept = written(kept_terms(docs, least), "kept-terms")
    groups = written(group_totals(docs, kept), "groups")
    pairs = written(pair_divergences(kept, groups), "divergences")
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    far = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pairs.select("lang", ends.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value").withColumn("rank", F.row_number().over(far))

    own = kept.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), share("count", "total", "terms").alias("p"), share("lang_count", "lang_total", "terms").alias("q"))
    own = own.filter("p > q").select("lang", "source", "part", "item", distance(F.col("p"), F.col("q")).alias("value"))
    term = own.withColumn("rank", F.row_number().over(far)).filter(F.col("rank") <= top)
    return pair.unionByName(term)


_shared = lambda n, total: f"1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * terms)"
AUDIT_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM c SEMI JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, lang_n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT f.lang, f.source, term, n, {_shared('n', 'coalesce(total, 0)')} AS p, {_shared('lang_n', 'lang_total')} AS q FROM f JOIN l USING (lang) LEFT JOIN s ON s.lang = f.lang AND s.source = f.source),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= {TOP}"""

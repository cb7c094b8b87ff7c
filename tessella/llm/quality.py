"""Quality rules: how much of a text lies in repeated n-grams and lines, by rolling hashes in numpy.

Words are hashed once; a hash of any run of words follows from prefix sums. A later copy of a run
within its document marks the characters of its words. Longer runs are only looked at where the
three-word runs in them repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import WINDOW_BYTES, Words, byte_slices, lean, mix64, runs, text_buffers

#: N-gram lengths, and the percentage of word characters in later copies that a text may have.
GRAMS = {5: 30, 7: 25, 10: 20}
#: The same for repeated lines.
LINES = 30
#: The symbols that n_symbols counts.
SYMBOLS = b"#*$%&|<>"
#: The base rule: at least so many words, at most so many percent of them in repeated three-word runs.
LEAST_WORDS, MOST_REPEATED = 50, 50

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in GRAMS)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_FEED = np.zeros(256, bool)
_FEED[10] = True


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def _later(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries given in text order: those equal to an earlier one of their document, and those with any equal."""
    key = key ^ mix64(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    later, every = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    every[order[1:]] = same
    every[order[:-1]] |= same
    return later, every


def _covered(at: np.ndarray, n: int, words: int) -> np.ndarray:
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + n, words), -1)
    return np.cumsum(edge[:-1]) > 0


def measure(offsets: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """The figures of COLUMNS for each text of a block (see text_buffers)."""
    w = Words(offsets, text, chars=True)
    n_words, docs, word_chars = w.count, w.n_docs, w.chars
    per_doc = lambda x: np.bincount(w.doc, x, minlength=docs).astype(np.int64)
    symbols = np.concatenate([np.zeros(0, np.int64), *(np.flatnonzero(_SYMBOL[text[a : a + WINDOW_BYTES]]) + a for a in range(0, len(text), WINDOW_BYTES))])
    n_symbols = np.diff(np.searchsorted(symbols, offsets))
    # Lines end at a line feed or with the document; those without a word don't count.
    line_start, line_end, line_hash, _ = runs(offsets, text, _FEED)
    words_to = np.searchsorted(w.start, np.stack([line_start, line_end]))
    worded = words_to[1] > words_to[0]
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    line_later, _ = _later(line_doc[worded], line_hash[worded])
    of = _sums(word_chars)
    line_chars = (of[words_to[1]] - of[words_to[0]])[worded] * line_later
    lines_of = lambda x: np.bincount(line_doc[worded], x, minlength=docs).astype(np.int64)
    h3, at3 = w.gram_hash(3)
    _, every3 = _later(w.doc[at3], h3)
    out = [n_words, per_doc(word_chars), n_symbols, lines_of(line_later), per_doc(_covered(at3[every3], 3, len(w.doc))), lines_of(line_chars)]
    repeated = np.zeros(len(w.doc) + 1, bool)
    repeated[at3[every3]] = True
    for n in GRAMS:
        h, at = w.gram_hash(n)
        may = repeated[at] & repeated[at + n - 3]
        h, at = h[may], at[may]
        later, _ = _later(w.doc[at], h)
        out.append(per_doc(word_chars * _covered(at[later], n, len(w.doc))))
    return [x.astype(np.int64) for x in out]


def verdict(figures: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept, from measure()."""
    n_words, word_chars, _, _, n_repeat_words, dup_line_chars, *dup_chars = figures
    failed = (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)
    bad = 100 * dup_line_chars > LINES * word_chars
    for most, chars in zip(GRAMS.values(), dup_chars):
        bad |= 100 * chars > most * word_chars
    return failed, ~failed & ~bad


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures and verdict for each document: doc_id, COLUMNS, base_failed, kept.

    A null, empty or blank text has no words and fails the base rule. Rows that repeat are judged
    each for itself. An empty table gives no rows. Other columns are not read, so their names don't
    matter. A long text is worked on in windows: a task needs about 15 bytes for each of its bytes.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = [x.split()[0] for x in COLUMNS.split(", ")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                figures = measure(*text_buffers(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, figures), *map(pa.array, verdict(figures))], names=["doc_id", *names, "base_failed", "kept"])

    return rows.mapInArrow(lean(judge), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {COLUMNS}, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their columns, whatever these are named. Null texts go."""
    at = docs.columns.index(text_col)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(at)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(verdict(measure(*text_buffers(part.column(at))))[1]))

    return docs.mapInArrow(lean(good), docs.schema)


def _sql() -> str:
    """The same rules in SQL."""
    grams = sorted({3, *GRAMS})
    leads = ", ".join(f"CASE WHEN i + {n} - 1 <= total THEN list_slice(ws, CAST(i AS BIGINT), CAST(i + {n} - 1 AS BIGINT)) END AS g{n}" for n in grams)
    ranks = ", ".join(f"CASE WHEN g{n} IS NOT NULL THEN row_number() OVER (PARTITION BY doc_id, g{n} ORDER BY i) END AS r{n}, CASE WHEN g{n} IS NOT NULL THEN count(*) OVER (PARTITION BY doc_id, g{n}) END AS c{n}" for n in grams)
    covers = "max(CASE WHEN c3 > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rep, " + ", ".join(f"max(CASE WHEN r{n} > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS d{n}" for n in GRAMS)
    word = r"[^\x20\x09-\x0D]+"
    verdict = " OR ".join([f"100 * dup_line_chars > {LINES} * word_chars", *[f"100 * dup_chars_{n} > {most} * word_chars" for n, most in GRAMS.items()]])
    columns = ", ".join(x.split()[0] for x in COLUMNS.split(", "))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
u AS (SELECT doc_id, ws, len(ws) AS total, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT doc_id, word, i, {leads} FROM u),
r AS (SELECT doc_id, word, i, {ranks} FROM g),
v AS (SELECT doc_id, word, {covers} FROM r),
f AS (SELECT doc_id, sum(length(word)) AS word_chars, sum(rep) AS n_repeat_words, {", ".join(f"sum(CASE WHEN d{n} = 1 THEN length(word) ELSE 0 END) AS dup_chars_{n}" for n in GRAMS)} FROM v GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
k AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS place FROM l WHERE regexp_matches(line, '{word}')),
m AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS dup_line_chars FROM k WHERE place > 1 GROUP BY doc_id),
a AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars,
             {", ".join(f"CAST(coalesce(dup_chars_{n}, 0) AS BIGINT) AS dup_chars_{n}" for n in GRAMS)}
      FROM d LEFT JOIN f USING (doc_id) LEFT JOIN m USING (doc_id)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM a)
SELECT doc_id, {columns}, base_failed, NOT base_failed AND NOT ({verdict}) AS kept FROM b
"""


QUALITY_SQL = _sql()

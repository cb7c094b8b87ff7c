"""Whitening against an eigendecomposition of the covariance."""

import math

import numpy as np
import pytest

from tessella.llm import whitening as w


def brute(rows, most=4):
    """Per kept row: deviation, whitened coordinates; n and the explained shares; from numpy's eigh over whole numbers."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), object)
    n, sums = len(fit), fit.sum(0)
    off = (fit * n - sums).astype(float) / n
    e, v = np.linalg.eigh(off.T @ off / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(most, int((e > e[0] * 1e-12).sum()))
    rows = [(i, sum(int(d) ** 2 for d in np.array(x, object) * n - sums), (np.array(x, object) * n - sums).astype(float) / n @ v[:, :k] / np.sqrt(e[:k])) for i, x in kept]
    return n, rows, e[:k] / e.sum()


def check(spark, rows, most=4):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, component int").repartition(20)
    got = w.whiten(df, most=most).collect()
    n, want, explained = brute([(i, v if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows], most)
    assert len(got) == len(want) * len(explained) and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    for c in range(1, len(explained) + 1):
        own = sorted((str(r.vec_id), r.deviation, r.whitened) for r in got if r.component == c)
        all_ = sorted((str(i), d, float(y[c - 1])) for i, d, y in want)
        assert [(i, d) for i, d, _ in own] == [(i, d) for i, d, _ in all_]
        a, b = (np.array(sorted(x[2] for x in side)) for side in (own, all_))
        assert min(np.abs(a - b).max(), np.abs(np.sort(-a) - b).max()) < 1e-6
        assert all(abs(r.explained - explained[c - 1]) < 1e-9 for r in got if r.component == c)


def test_against_eigh(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 7)) * np.array([3, 2, 1, 0.5, 0.2, 0.1, 0.05])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base @ rng.normal(size=(7, 7)))]
    rows += [(1000 + i, rows[5][1]) for i in range(150)] + [(None, rows[6][1]), (7, rows[8][1])]
    rows += [(2000, None), (2001, [1.0, None, *[0.0] * 5]), (2002, [float("nan")] * 7), (2003, [float("inf"), *[0.0] * 6])]
    check(spark, rows)


def test_few_dimensions_ranks_and_rows(spark):
    check(spark, [(1, [1.0, 2.0]), (2, [3.0, 5.0]), (3, [3.0, 5.0]), (4, [-1.0, 0.25])])
    check(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)])  # one direction only
    columns = "vec_id long, embedding array<float>"
    assert w.whiten(spark.createDataFrame([], columns)).count() == 0
    assert w.whiten(spark.createDataFrame([(1, []), (2, None)], columns)).count() == 0
    assert w.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], columns)).count() == 0
    got = w.whiten(spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [2.0, 1.0]), (4, [])], columns)).collect()
    assert sorted(r.vec_id for r in got) == [1, 2]


def test_large_entries_stay_exact(spark):
    rows = [(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [5e14, 2.5])]
    got = {(r.vec_id, r.component): r for r in w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 6 and all(r.deviation is None for r in got.values())  # beyond 64 bits
    x = np.array([[int(256 * c) for c in v] for _, v in rows], object)
    assert (w.offsets_from_mean(x.astype(np.int64), 3, x.sum(0)) == x * 3 - x.sum(0)).all()


@pytest.mark.parametrize("d", [1, 2, 5, 16, 33])
def test_jacobi(d):
    rng = np.random.default_rng(d)
    for scale in (np.ones(d), 10.0 ** -np.arange(d)):
        a = np.triu(rng.normal(size=(d, d))) * scale
        sigma, v = w.jacobi(a)
        assert np.allclose(v.T @ v, np.eye(d), atol=1e-13) and (np.diff(sigma) <= 0).all()
        assert np.allclose((a @ v).T @ (a @ v), np.diag(sigma**2), atol=1e-12 * sigma[0] ** 2)
        assert np.allclose(sigma, np.linalg.svd(a)[1], rtol=1e-10, atol=1e-15 * sigma[0])
    assert w.jacobi(np.zeros((d, d)))[0].tolist() == [0.0] * d


def test_factors_of_many_parts(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (500, 6))
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(40)
    sums = w._sums(fit, 6)
    assert sums.tolist() == x.sum(0).tolist()
    r = w.factor(fit, 500, sums)
    c = x - x.sum(0) / 500
    assert r.shape == (6, 6) and np.allclose(r.T @ r, c.T @ c, rtol=1e-12, atol=1e-8)

"""Embedding whitening: a one-sided Jacobi SVD of the R factor of a blockwise TSQR.

Entries become whole numbers, so that the fit list (each distinct vector once), its size and its sums are
exact. Each task centres its rows and reduces them, block by block, to a triangular factor with as many rows
as there are dimensions; factors are stacked and reduced again, FAN at a time, until one is left, which holds
R'R = n V for the covariance V. Plane rotations then make R's columns orthogonal: their lengths are the
standard deviations times sqrt(n), accurate relative to each of them, as V is never formed, and the
accumulated rotations are the components.

What meets in one place has d * d numbers for d dimensions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import discard, lean, written

#: Whole numbers to a unit, components that are returned, and factors that are reduced in one task.
SCALE, COMPONENTS, FAN = 256, 4, 16
#: Numbers of a block of rows that a task works on at a time.
BLOCK = 1 << 20
#: Rotations stop when all columns are orthogonal to this cosine, or after so many turns through all pairs.
ORTHOGONAL, TURNS = 1e-15, 60
_SUMS = "dim int, total decimal(38,0)"


class Whitening(NamedTuple):
    """n, sums: of the fit list; components: a column each; deviations: their standard deviations; trace: of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    trace: float


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right singular vectors, as columns, of a matrix with as many columns as it has dimensions.

    A turn goes through all pairs of columns in rounds of disjoint pairs, each of which is rotated until it is orthogonal.
    """
    d = r.shape[1]
    u, v = r.astype(np.float64, copy=True), np.eye(d)
    if d > 1:
        seats = np.arange(d + d % 2)
        for _ in range(TURNS):
            worst = 0.0
            order = np.argsort(-np.einsum("ij,ij->j", u, u), kind="stable")
            u, v = u[:, order], v[:, order]
            for _ in range(len(seats) - 1):
                half = len(seats) // 2
                p, q = np.minimum(seats[:half], seats[: half - 1 : -1]), np.maximum(seats[:half], seats[: half - 1 : -1])
                p, q = p[q < d], q[q < d]
                a, b = u[:, p], u[:, q]
                aa, bb, ab = np.einsum("ij,ij->j", a, a), np.einsum("ij,ij->j", b, b), np.einsum("ij,ij->j", a, b)
                size = np.sqrt(aa) * np.sqrt(bb)
                turn = (np.abs(ab) > ORTHOGONAL * size) & (size > 0)
                if turn.any():
                    p, q, a, b, aa, bb, ab = p[turn], q[turn], a[:, turn], b[:, turn], aa[turn], bb[turn], ab[turn]
                    worst = max(worst, float((np.abs(ab) / size[turn]).max()))
                    zeta = (bb - aa) / (2 * ab)
                    t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                    c = 1 / np.hypot(1.0, t)
                    s = c * t
                    u[:, p], u[:, q] = c * a - s * b, s * a + c * b
                    a, b = v[:, p], v[:, q]
                    v[:, p], v[:, q] = c * a - s * b, s * a + c * b
                seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            if worst <= 8 * ORTHOGONAL:
                break
    sigma = np.sqrt(np.einsum("ij,ij->j", u, u))
    order = np.argsort(-sigma, kind="stable")
    v = v[:, order]
    sign = np.sign(v[np.abs(v).argmax(0), np.arange(d)])
    return sigma[order], v * np.where(sign == 0, 1.0, sign)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x: vectors without null or non-finite entries, in whole numbers."""
    v = F.col(vector_col)
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE))
    kept = vectors.filter(v.isNotNull() & F.forall(v, finite))
    return kept.select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(batches: Iterator[pa.RecordBatch], name: str, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(1, BLOCK // d)
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part, _matrix(part.column(name), d)


def _sums(fit: DataFrame, d: int) -> np.ndarray:
    """Exact sums for each dimension, as Python's whole numbers; in halves, so that no task's sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for _, x in _blocks(batches, "x", d):
            total += (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(t) for t in total]).cast(pa.decimal128(38, 0))], names=["dim", "total"])

    rows = fit.mapInArrow(lean(run), _SUMS).groupBy("dim").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(d, object)
    for r in rows:
        out[r["dim"]] = int(r["total"])
    return out


def offsets_from_mean(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: 64-bit numbers where they suffice, else Python's."""
    most = int(np.abs(x).max(initial=0)) if x.size and x.min() > np.iinfo(np.int64).min else 1 << 63
    if n * most + max(map(abs, sums.tolist()), default=0) < 1 << 62:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return offsets_from_mean(x, n, sums).astype(np.float64) / n


def _deviation(off: np.ndarray) -> list[int | None]:
    """Sums of squares of rows of whole numbers, exact; null if they don't fit 64 bits."""
    most = max(abs(int(off.max(initial=0))), abs(int(off.min(initial=0)))) if off.size else 0
    if off.dtype != object and most * most * max(1, off.shape[1]) < 1 << 63:
        return (off * off).sum(1).tolist()
    return [int(s) if s < 1 << 63 else None for s in (off.astype(object) ** 2).sum(1)]


def _reduce(rows: np.ndarray, d: int) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) > d else rows


def factor(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """A matrix R of at most d rows with R'R = sum of (x - mean)(x - mean)' over the fit list, by a tree of QR steps."""
    d = len(sums)
    part = "part int, r array<double>"

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, d))
        for _, x in _blocks(batches, "x", d):
            r = _reduce(np.vstack([r, _centred(x, n, sums)]), d)
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"part": np.full(len(r), TaskContext.get().partitionId(), np.int32), "r": list(r)}), schema=pa.schema([("part", pa.int32()), ("r", pa.list_(pa.float64()))]))

    def stack(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, d))
        for i in range(0, len(pdf), max(d, BLOCK // d)):
            r = _reduce(np.vstack([r, *pdf["r"].iloc[i : i + max(d, BLOCK // d)]]), d)
        return pd.DataFrame({"part": np.full(len(r), pdf["part"].iloc[0], np.int32), "r": list(r)})

    level = written(fit.mapInArrow(lean(leaf), part), "factors")
    while (level.agg(F.max("part")).first()[0] or 0) > 0:
        below, level = level, written(level.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part").applyInPandas(stack, part), "factors")
        discard(below)
    rows = [r["r"] for r in level.select("r").collect()]  # at most d of them
    discard(level)
    return np.array(rows, np.float64).reshape(-1, d)


def fit_whitening(fit: DataFrame, d: int) -> Whitening:
    """The whitening of distinct vectors of whole numbers (column x, all of d entries)."""
    n = fit.count()
    sums = _sums(fit, d)
    r = factor(fit, n, sums) if n else np.zeros((0, d))
    sigma, v = jacobi(np.vstack([r, np.zeros((max(0, d - len(r)), d))]))
    real = sigma > (sigma.max(initial=0) * np.finfo(float).eps * d)
    return Whitening(n, sums, v[:, real], sigma[real] / np.sqrt(max(n, 1)), float((sigma**2).sum() / max(n, 1)))


def project(x: np.ndarray, w: Whitening, most: int) -> np.ndarray:
    """Whitened coordinates of rows of whole numbers on the first `most` components."""
    return _centred(x, w.n, w.sums) @ w.components[:, :most] / w.deviations[:most]


def identity_error(fit: DataFrame, w: Whitening, most: int) -> float:
    """The largest entry of the covariance of the whitened fit list, less the identity: means and centred products of blocks, put together."""
    k, d = min(most, len(w.deviations)), len(w.sums)
    if not k:
        return 0.0
    numbers = [*(f"m{i}" for i in range(k)), *(f"p{i}_{j}" for i in range(k) for j in range(i, k))]
    schema = "rows long, " + ", ".join(f"{c} double" for c in numbers)
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
        for _, x in _blocks(batches, "x", d):
            y = project(x, w, k)
            own = y.mean(0)
            y = y - own
            far, both = own - mean, n + len(y)
            m2 += y.T @ y + np.outer(far, far) * n * len(y) / both
            mean, n = mean + far * len(y) / both, both
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip([n, *mean, *m2[upper]], [pa.int64(), *[pa.float64()] * len(numbers)])], names=["rows", *numbers])

    parts = written(fit.mapInArrow(lean(run), schema), "moments")
    mean = parts.agg(*[(F.sum(F.col("rows") * F.col(f"m{i}")) / F.sum("rows")).alias(f"m{i}") for i in range(k)]).first()
    off = [F.col(f"m{i}") - F.lit(mean[f"m{i}"]) for i in range(k)]
    products = parts.agg(*[(F.sum(F.col(f"p{i}_{j}") + F.col("rows") * off[i] * off[j]) / F.sum("rows")).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    discard(parts)
    return max(abs(products[f"p{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector and its first components.

    Rows whose vector is null or has null or non-finite entries have no result, nor have empty vectors. Vectors
    have the length that most rows have (of lengths that tie the largest); others are of another space and have
    no result either. Rows that repeat, and equal vectors, have a result each, but count once in the fit.
    Components without variance can't be whitened and are left out, as are those beyond the dimensions: a table
    of equal vectors, or an empty one, has no rows. deviation is null where it doesn't fit 64 bits. Other columns
    are not read. Equal vectors are put together before the shuffle.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector_col)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.filter(F.size("x") > 0).groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths["d"]
    rows = rows.filter(F.size("x") == d)
    fit = written(rows.select("x").distinct(), "vectors")
    w = fit_whitening(fit, d)
    k = min(most, len(w.deviations))
    error = identity_error(fit, w, k)
    discard(fit)
    explained = w.deviations[:k] ** 2 / w.trace if k else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, "x", d):
            m = len(x) * k
            own = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(own), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, w.n)), pa.array(_deviation(offsets_from_mean(x, w.n, w.sums)), pa.int64()).take(own), pa.array(project(x, w, k).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(m, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(lean(run), schema)

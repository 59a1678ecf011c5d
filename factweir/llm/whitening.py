"""Whitening of embeddings by principal components from a randomised range finder.

Vectors become integers, and each distinct one counts once in the fit. A few random directions, more than are
asked for, are multiplied by the covariance in passes over all centred rows; Rayleigh-Ritz within their span
gives components with the residual that each still has. While residuals are too large the span passes over the
rows again, and after some passes it is widened to all dimensions, where the result is exact. The covariance is
never formed before that, and only matrices of dimensions by directions reach the driver.

Defined results: vectors that are null or hold null or non-finite entries give no rows; rows without an id and
repeated rows are rows of their own; vectors of each dimension are fitted among themselves; components whose
eigenvalue is zero are left out, so single or equal vectors and empty tables give no components; integers and
deviations beyond 64 bits become the nearest of those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweir.llm.common import pick, prepare, work_dir, written

#: Directions beyond those asked for, and passes over the rows before all dimensions are taken.
OVERSAMPLE, PASSES = 16, 4
#: Residuals of a component relative to the largest eigenvalue, and to the gap between neighbouring ones.
RESIDUAL, GAP_RESIDUAL = 1e-13, 1e-9
#: Eigenvalues up to this share of the largest are zero.
ZERO = 1e-12
_INT = np.iinfo(np.int64)


@dataclass(frozen=True)
class Whitening:
    """The fit of one dimension: n distinct vectors with sums, components as columns, their eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    passes: int


def coded(vectors: DataFrame, id_column: str, vector_column: str, scale: int, shift: int) -> DataFrame:
    """id, x: floor(scale * entry) + shift as long, of the vectors that take part."""
    base = pick(vectors, id_column, vector_column).toDF("id", "x").withColumn("x", F.transform("x", lambda c: c.cast("double"))).where("x IS NOT NULL")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    shifted = lambda x: F.when(x > _INT.max - shift, F.lit(_INT.max)).otherwise(x + F.lit(shift).cast("long"))
    return base.where(~bad).select("id", F.transform(F.transform("x", lambda c: F.floor(c * scale)), shifted).alias("x"))


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, in 64 bits where they hold it and else in Python's integers."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * most + max(map(abs, sums), default=0) < 2**62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _offsets(x, n, sums).astype(np.float64) / n


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of each entry: a row from each task for each entry, then Spark's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=object)
        for b in batches:
            x = _matrix(b.column(0), d)
            n += len(x)
            safe = len(x) * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) < 2**62
            total = total + (x.sum(axis=0).astype(object) if safe else x.astype(object).sum(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] * d, pa.int64()), pa.array(range(d), pa.int32()), pa.array([str(int(t)) for t in total], pa.string())], names=["n", "j", "total"])

    parts = fit.select("x").mapInArrow(run, "n long, j int, total string")
    rows = parts.groupBy("j").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("j").collect()  # d rows
    return int(rows[0]["n"]), [int(r["total"]) for r in rows]


def covariance_times(fit: DataFrame, n: int, sums: list[int], directions: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance of the centred rows times these directions, in one pass, and the covariance's trace.

    Each task adds up its rows' share, Spark adds up the tasks' by place in the matrix.
    """
    d, width = directions.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, squares, seen = np.zeros((d, width)), 0.0, False
        for b in batches:
            x = _centred(_matrix(b.column(0), d), n, sums)
            product += x.T @ (x @ directions)
            squares += float((x * x).sum())
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d * width), pa.int64()), pa.array(np.concatenate(([squares], product.ravel())))], names=["at", "v"])

    parts = fit.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")  # d * width + 1 rows
    v = parts["v"].to_numpy() / n
    return v[1:].reshape(d, width), float(v[0])


def ritz(directions: np.ndarray, product: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The k best eigenvalues and vectors within the span of orthonormal directions; whether residuals pass."""
    small = directions.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = directions @ turn
    residual = np.linalg.norm(product @ turn - vectors * values, axis=0)[:k]
    gaps = np.abs(np.diff(values))
    around = np.minimum(np.concatenate(([np.inf], gaps))[:k], np.concatenate((gaps, [np.inf]))[:k])
    top = max(values[0], 0.0) if len(values) else 0.0
    real = values[:k] > ZERO * top
    good = bool(np.all(((residual <= RESIDUAL * top) & (residual <= GAP_RESIDUAL * around))[real]))
    return values[:k], vectors[:, :k], good


def fit_whitening(fit: DataFrame, d: int, k: int = 16, seed: int = 17) -> Whitening:
    """Whitening by the k leading components of the distinct vectors `fit`(x), all of dimension d."""
    n, sums = _sums(fit, d)
    span = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, k + OVERSAMPLE))))[0]
    passes = 0
    while True:
        product, trace = covariance_times(fit, n, sums, span)
        passes += 1
        values, vectors, good = ritz(span, product, k)
        if good or span.shape[1] == d:
            break
        span = np.eye(d) if passes >= PASSES else np.linalg.qr(product)[0]
    kept = values > ZERO * max(values[0], 0.0)
    values, vectors = values[kept], vectors[:, kept]
    error = 0.0
    if len(values):
        scaled = vectors / np.sqrt(values)
        error = float(np.abs(scaled.T @ covariance_times(fit, n, sums, scaled)[0] - np.eye(len(values))).max())
    return Whitening(n, sums, vectors, values, trace, error, passes)


def _deviations(offsets: np.ndarray) -> np.ndarray:
    most = max(abs(int(offsets.max(initial=0))), abs(int(offsets.min(initial=0))))
    if most**2 * offsets.shape[1] < 2**62:
        return (offsets.astype(np.int64) ** 2).sum(axis=1)
    return np.array([min(int(t), _INT.max) for t in (offsets.astype(object) ** 2).sum(axis=1)], dtype=np.int64)


def whiten(vectors: DataFrame, k: int = 16, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """id, n, deviation, whitened and explained (arrays, one entry for each component) and identity_error.

    deviation: sum over entries of (n * x - sum)^2; explained: share of each component in the trace.
    """
    spark = vectors.sparkSession
    prepare(spark, 4000)
    rows = coded(vectors, id_column, vector_column, scale, shift)
    fit = written(rows.where(F.size("x") > 0).select("x").distinct().withColumn("d", F.size("x")), f"{work_dir(spark, 'whitening')}/fit")
    dims = sorted(r["d"] for r in fit.select("d").distinct().collect())  # the vectors' dimensions: few
    fits = {d: fit_whitening(fit.where(F.col("d") == d), d, k) for d in dims}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(b.column(1).offsets.to_numpy())
            for d in np.unique(sizes):
                w = fits[int(d)]
                part = b.take(pa.array(np.flatnonzero(sizes == d)))
                offsets = _offsets(_matrix(part.column(1), int(d)), w.n, w.sums)
                m, c = len(offsets), len(w.eigenvalues)
                white = offsets.astype(np.float64) / w.n @ (w.components / np.sqrt(w.eigenvalues))
                ends = pa.array(np.arange(0, m * c + 1, c) if c else np.zeros(m + 1), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.float64())) for x in (white.ravel(), np.tile(w.eigenvalues / w.trace if c else [], m))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([w.n] * m, pa.int64()), pa.array(_deviations(offsets), pa.int64()), *lists, pa.array([w.identity_error] * m, pa.float64())],
                    names=[id_column, "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.where(F.size("x") > 0).mapInArrow(run, f"`{id_column}` {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")

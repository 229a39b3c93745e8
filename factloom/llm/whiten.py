"""Whitening of embeddings along their principal components.

The fit list holds every distinct vector once. A randomised range finder draws ``components +
OVERSAMPLING`` random directions and multiplies them again and again with the covariance of the
fit list; every power pass reads all centred rows and adds up a small matrix in each task. Rayleigh-
Ritz on the last basis gives components and variances. A component is taken only if its residual
is small against the gap to the next variance; if any fails after ``PASSES`` passes the basis is
expanded to the full dimension, where Rayleigh-Ritz is exact.

What reaches the driver are matrices of dimension times basis, never rows. Vectors are whole
numbers, so sums and squared deviations are exact, and rows are centred before they are multiplied.

Defined cases: rows whose vector is null or holds null or non-finite entries take no part; neither
do vectors of another length than most rows have (of equally frequent lengths the longest is
taken); repeated rows keep their own results and count once in the fit; a component without
variance has null ``whitened``, ``explained`` 0 and no part in the identity error; there are as
many components as dimensions if those are fewer than asked for; a deviation beyond 64 bits is
null; an empty table gives an empty result; a null ``vec_id`` stays; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

SCALE = 256
OVERSAMPLING, PASSES = 8, 6
#: Residual of a component against the gap to the next variance that counts as converged.
EXACT = 1e-10
#: Variance below this part of the largest is none.
NONE = 1e-13


def quantized(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and the whole-number vector ``x`` of the rows that take part."""
    c = F.col("embedding")
    usable = c.isNotNull() & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(usable).select("vec_id", F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("x"))
    return rows


def _matrix(x: pa.Array, d: int) -> np.ndarray:
    """Vectors of a batch, one a row."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _added(rows: DataFrame, d: int, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """Sum over all ``rows`` of what ``part`` makes of a batch of vectors: a matrix of ``shape``.

    Tasks add up their own batches first and give one row for each row of the matrix.
    """
    dtype = np.float64 if kind == "double" else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch["x"], d))
        yield pa.record_batch({"i": pa.array(np.arange(shape[0]), pa.int32()), "v": pa.array(list(total), pa.list_(pa.from_numpy_dtype(dtype)))})

    sums = [F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(shape[1])]
    out = np.zeros(shape, dtype)
    for r in rows.select("x").mapInArrow(run, f"i int, v array<{kind}>").groupBy("i").agg(*sums).collect():  # rows of one small matrix
        out[r["i"]] = r[1:]
    return out


def _settled(values: np.ndarray, vectors: np.ndarray, image: np.ndarray, wanted: int) -> bool:
    """Whether the first ``wanted`` components are exact; ``image`` is the covariance times them."""
    residual = np.linalg.norm(image - vectors * values, axis=0)
    gap = values[:-1] - values[1:]
    near = np.minimum(gap, np.append(np.inf, gap[:-1]))[:wanted]
    return bool((residual[:wanted] <= EXACT * np.maximum(near, 0.0)).all())


def principal(fit: DataFrame, d: int, mean: np.ndarray, n: int, components: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray, dict]:
    """Unit eigenvectors (columns) and eigenvalues of the covariance of ``fit``, by falling value."""

    def times(basis: np.ndarray) -> np.ndarray:
        return _added(fit, d, (d, basis.shape[1]), lambda x: (x - mean).T @ ((x - mean) @ basis)) / n

    def ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, ::-1]
        return values[::-1], basis @ turn, image @ turn

    wide = min(d, components + OVERSAMPLING)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, wide)))[0]
    passes = 0
    while wide < d and passes < PASSES:
        image = times(basis)
        passes += 1
        values, vectors, moved = ritz(basis, image)
        if _settled(values, vectors, moved, components):
            return vectors[:, :components], values[:components], {"passes": passes, "full": False}
        basis = np.linalg.qr(image)[0]
    # the whole space: what was found, and directions at right angles to it
    more = np.random.default_rng(seed + 1).normal(size=(d, d - wide))
    basis = np.linalg.qr(np.concatenate([basis, more], 1))[0]
    values, vectors, _ = ritz(basis, times(basis))
    return vectors[:, :components], np.maximum(values[:components], 0.0), {"passes": passes + 1, "full": True}


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every row and component."""
    spark = vectors.sparkSession
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = saved(quantized(vectors))
    lengths = rows.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths["d"]
    rows = rows.where(F.size("x") == d)
    fit = saved(rows.select("x").distinct())
    n = fit.count()
    sums = _added(fit, d, (d, 1), lambda x: x.sum(0)[:, None], "long")[:, 0]
    mean = sums / n
    spread = _added(fit, d, (1, 1), lambda x: np.square(x - mean).sum().reshape(1, 1))[0, 0] / n
    k = min(components, d)
    axes, values, _ = principal(fit, d, mean, n, k)
    real = values > NONE * max(spread, 1e-300)
    scaled = np.where(real, axes / np.sqrt(np.where(real, values, 1.0)), 0.0)
    # covariance of the whitened fit list, about its own mean
    seen = _added(fit, d, (k + 1, k), lambda x: (lambda z: np.concatenate([z.T @ z, z.sum(0)[None]]))((x - mean) @ scaled)) / n
    off = (seen[:k] - np.outer(seen[k], seen[k]) - np.eye(k))[np.ix_(real, real)]
    error = float(np.abs(off).max(initial=0.0))
    explained = np.where(real, values / (spread or 1.0), 0.0)
    exact = [int(s) for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch["x"], d)
            reach = max(abs(int(x.min())), abs(int(x.max()))) * n + max(map(abs, exact))
            if reach * reach * d < 1 << 63:
                deviation = pa.array(np.square(n * x - np.array(exact)).sum(1), pa.int64())
            else:  # beyond 64 bits: Python's whole numbers
                far = [sum((n * v - s) ** 2 for v, s in zip(row, exact)) for row in x.tolist()]
                deviation = pa.array([v if v < 1 << 63 else None for v in far], pa.int64())
            z = (x - mean) @ scaled
            again = pa.array(np.repeat(np.arange(m), k))
            whitened = pa.array(z.ravel(), mask=~np.tile(real, m))
            same = lambda v, kind: pa.array(np.full(m * k, v), kind)
            yield pa.record_batch([batch["vec_id"].take(again), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), same(n, pa.int64()), deviation.take(again), whitened, pa.array(np.tile(explained, m)), same(error, pa.float64())], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)

"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X are never multiplied out. Each step is one pass over them: a task forms its part of the left vector u = Xw and of
Xᵀu at once. Left vectors are as long as the table, so each is held by its weights a with u = Xa, and by Xᵀu; products of
left vectors are then sums of as many numbers as there are dimensions, and both sides are orthogonalised in full, twice. The singular values of the small bidiagonal
matrix give the deviations, its right vectors the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from devicehealth.session import cut_lineage

#: Entries become whole numbers by this factor and shift.
SCALE, SHIFT = 64, 1_000_000
#: Components, and the share of the largest singular value below which one counts as zero.
COMPONENTS, ZERO = 16, 1e-8
#: Size of a new vector, against what it was made from, that is taken for rounding.
NOISE = 2e-13
#: Values of a block of rows that is worked on at once, and rows of the fit for each task of a pass.
BLOCK, TASK_ROWS = 1 << 18, 16_384


def whole_numbers(vector: Column) -> Column:
    """The vector's entries as whole numbers."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long") + SHIFT)


def _usable(vector: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: finite(c.cast("double")))


def _blocks(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[int, int, pa.RecordBatch, np.ndarray]]:
    """Rows of the batches with their vectors as a matrix of whole numbers."""
    for batch in batches:
        flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        for a in range(0, len(batch), max(1, BLOCK // width)):
            b = min(len(batch), a + max(1, BLOCK // width))
            yield a, b, batch, flat[a:b]


def _sum(fit: DataFrame, width: int, of, size: int) -> np.ndarray:
    """The sum over all rows of what ``of`` makes of a block, ``size`` numbers; a task sends one row, and rows are added up before they reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, _, _, x in _blocks(batches, 0, width):
            total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["i", "v"])

    out = np.zeros(size)
    for r in fit.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    return v


def bidiagonal(product, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``(singular values, right vectors)`` of X, falling, from ``product(w)``, which gives ``(|Xw|², XᵀXw)``.

    Runs until the right vectors span all dimensions, so that equal singular values are all found; a vector that X or the rest of the space ends with is
    followed by a new one at right angles to all before it.
    """
    rng = np.random.default_rng([seed, width])
    right, weights, products, alphas, betas = [], [], [], [], []
    v, beta, largest = None, 0.0, 0.0
    while len(right) < width:
        if v is None:
            v = _orthogonal(rng.normal(size=width), right)
            v /= np.linalg.norm(v)
            beta = 0.0
        w = v - beta * weights[-1] if right and beta else v.copy()
        square, z = product(w)
        # Against the left vectors before it, twice; where much of the product goes with them, what is left is measured again.
        for again in range(2):
            if weights:
                along = np.array([a @ z for a in weights])
                w, z, part = w - along @ np.array(weights), z - along @ np.array(products), float(along @ along)
                if part > 1e-6 * square and not again:
                    square, z = product(w)
                else:
                    square -= part
        alpha, reach = np.sqrt(max(square, 0.0)), float(np.linalg.norm(w))
        largest = max(largest, beta, alpha / reach) if reach else largest
        right.append(v)
        betas.append(beta)
        # What is left of Xw after so much cancelling may be nothing but rounding.
        alphas.append(alpha if alpha > NOISE * reach * largest else 0.0)
        weights.append(w / alpha if alphas[-1] else np.zeros(width))
        products.append(z / alpha if alphas[-1] else np.zeros(width))
        v = products[-1] - alphas[-1] * v
        v = _orthogonal(v, right)
        beta = float(np.linalg.norm(v))
        if not alphas[-1] or beta <= NOISE * largest:
            v = None
        else:
            v /= beta
    # X V = U B with B upper bidiagonal: alphas on the diagonal, betas above it.
    b = np.diag(alphas) + np.diag(betas[1:], 1)
    _, values, mixed = np.linalg.svd(b)
    return values, mixed @ np.array(right)


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)``: a row for each usable vector and component, numbered from 1.

    A usable vector has no null or non-finite entry. Its entries become whole numbers x; the fit takes each distinct x once, n of them with sums S. ``deviation`` is the exact sum over
    dimensions of (n x - S)², null where it leaves the range of a long; ``whitened`` is x - S / n along the component over the root of its variance e (divisor n), ``explained`` e over the
    sum of all variances, ``identity_error`` the largest entry of the covariance of ``whitened`` over the fit minus the identity.

    Null, empty and unusable vectors have no rows. Vectors must have one length: where there are several, the most frequent counts (of ties the largest) and the others have no rows.
    Repeated rows and ids have rows each and count once in the fit. Components of no variance (fewer distinct vectors than dimensions, constant entries) are left out; one distinct
    vector or none: no rows. Other columns are not read.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(_usable(F.col("v"))).select("id", whole_numbers(F.col("v")).alias("x"))
    schema = T.StructType([rows.schema["id"].__class__(key, rows.schema["id"].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                           *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    session = vectors.sparkSession
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return session.createDataFrame([], schema)
    width = lengths.d
    rows = rows.where(F.size("x") == width)
    fit = cut_lineage(rows.select("x").distinct())
    n, *sums = fit.agg(F.count(F.lit(1)), *(F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(width))).first()
    sums = [int(s) for s in sums]
    # Every pass is a short job, so a fit of few rows in many partitions is drawn together.
    fit = fit.coalesce(n // TASK_ROWS + 1)
    # Centres are taken from the shift on, so that no digits are lost to it.
    centre = np.array([float(Decimal(s - n * SHIFT) / n) for s in sums])

    def product(w: np.ndarray) -> tuple[float, np.ndarray]:
        def of(x: np.ndarray) -> np.ndarray:
            c = (x - SHIFT) - centre
            u = c @ w
            return np.append(u @ c, u @ u)

        total = _sum(fit, width, of, width + 1)
        return total[-1], total[:-1]

    values, axes = bidiagonal(product, width)
    used = int(np.sum(values[:components] > ZERO * max(values[0], 1e-300))) if values[0] > 0 else 0
    if not used:
        return session.createDataFrame([], schema)
    variance = values ** 2 / n
    turn = (axes[:used] / np.sqrt(variance[:used])[:, None]).T
    both = _sum(fit, width, lambda x: (lambda w: np.append((w.T @ w).reshape(-1), w.sum(axis=0)))((x - SHIFT - centre) @ turn), used * used + used) / n
    mean = both[used * used:]
    error = float(np.abs(both[:used * used].reshape(used, used) - np.outer(mean, mean) - np.eye(used)).max())
    explained = variance[:used] / variance.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, batch, x in _blocks(batches, 1, width):
            out = (x - SHIFT - centre) @ turn
            far = np.abs(x.astype(np.float64) * n - np.array(sums, np.float64)).max(axis=1) if len(x) else np.zeros(0)
            # In whole numbers of 64 bits where the sum surely fits, else in Python's.
            if len(x) and float(far.max()) < np.sqrt(2.0 ** 62 / width) and n * float(np.abs(x).max()) < 2.0 ** 62:
                deviation = ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [d if d < 1 << 63 else None for d in (sum((n * e - s) ** 2 for e, s in zip(row, sums)) for row in x.tolist())]
            ids = pc.take(batch.column(0).slice(a, b - a), pa.array(np.repeat(np.arange(b - a), used)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, used + 1), b - a), pa.int32()), pa.array(np.full((b - a) * used, n), pa.int64()),
                 pa.array([d for d in deviation for _ in range(used)], pa.int64()), pa.array(out.reshape(-1)), pa.array(np.tile(explained, b - a)), pa.array(np.full((b - a) * used, error))],
                names=schema.names)

    return rows.mapInArrow(run, schema)

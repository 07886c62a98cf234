"""The leading eigenpairs of the covariance or correlation of wide vectors, without that matrix.

A block Krylov space is built by passes over the rows: a task multiplies its rows with a block of a few directions and
sends one thin matrix, which Spark adds up in two levels. The driver holds the basis, some hundred vectors of the width,
and never a square of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.factors import signed

SLICE = 256  # rows of a thin matrix that move together
FAN = 32  # sums of the first level


def _rows(rows: DataFrame, vec: str, dim: int) -> DataFrame:
    kept = rows.where(F.col(vec).isNotNull() & (F.size(vec) == dim)).select(F.col(vec).cast("array<double>").alias("x"))
    kept = kept.where(F.forall("x", lambda v: ~F.isnan(v)))
    return kept.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _added(rows: DataFrame, dim: int, width: int, of) -> np.ndarray:
    """The sum over all rows of the thin matrices [dim, width] that ``of`` makes of some rows [n, dim]."""
    cuts = list(range(0, dim, SLICE))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((dim, width))
        for batch in batches:
            column = batch.column("x")
            total += of(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim))
        own = TaskContext.get().partitionId() % FAN
        yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.int32()), pa.array([own] * len(cuts), pa.int32()), pa.array([total[k : k + SLICE].ravel().tolist() for k in cuts], pa.list_(pa.float64()))], names=["k", "fan", "m"])

    def add(table: pa.Table) -> pa.Table:
        size = len(table["m"][0])
        total = table["m"].combine_chunks().flatten().to_numpy().reshape(-1, size).sum(0)
        return pa.table({"k": table["k"].slice(0, 1), "fan": table["fan"].slice(0, 1), "m": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(each, "k int, fan int, m array<double>").groupBy("k", "fan").applyInArrow(add, "k int, fan int, m array<double>").groupBy("k").applyInArrow(add, "k int, fan int, m array<double>")
    out = np.zeros((dim, width))
    for r in parts.collect():  # one thin matrix in slices
        out[r.k : r.k + SLICE] = np.array(r.m).reshape(-1, width)
    return out


def top_eigenpairs(rows: DataFrame, vec: str, dim: int, m: int, correlation: bool = False, tolerance: float = 1e-10, seed: int = 1, most_passes: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The ``m`` largest eigenvalues, largest first, and their eigenvectors [dim, m], of the covariance (of a sample) of a column of vectors, or of their correlation.

    Null vectors, those of another length and those with a NaN are left out; a component that does not vary has
    correlations of zero. Passes go on until every wanted pair is within ``tolerance`` of the largest eigenvalue, and end
    with an error where ``most_passes`` are not enough. The largest entry of a vector is positive.
    """
    kept = _rows(rows, vec, dim)
    moments = _added(kept, dim, 3, lambda x: np.stack([x.sum(0), (x * x).sum(0), np.full(dim, float(len(x)))], axis=1))
    n = moments[0, 2]
    if n < 2:
        raise ValueError("fewer than two vectors")
    mean = moments[:, 0] / n
    spread = np.sqrt(np.maximum(_added(kept, dim, 1, lambda x: ((x - mean) ** 2).sum(0)[:, None])[:, 0] / (n - 1), 0))
    scale = np.divide(1.0, spread, out=np.zeros(dim), where=spread > 0) if correlation else np.ones(dim)

    def product(v: np.ndarray) -> np.ndarray:
        w = scale[:, None] * v
        shift = mean @ w
        return scale[:, None] * _added(kept, dim, v.shape[1], lambda x: (x - mean).T @ (x @ w - shift)) / (n - 1)

    m = min(m, dim)
    width = min(dim, m + 6)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, width)))[0]
    basis, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    for _ in range(most_passes):
        basis, image = np.hstack([basis, block]), np.hstack([image, product(block)])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:m], turn[:, ::-1][:, :m]
        found, moved = basis @ turn, image @ turn
        apart = np.sqrt(((moved - found * values) ** 2).sum(0))
        if basis.shape[1] >= dim or apart.max() <= tolerance * max(values[0], 1e-300):
            return np.maximum(values, 0.0), signed(found)
        if basis.shape[1] + width > 20 * width:  # go on from the best of what there is
            keep = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1][:, : 2 * width]
            basis, image = basis @ keep, image @ keep
        following = image[:, -width:]
        for _ in range(2):
            following = following - basis @ (basis.T @ following)
        block = np.linalg.qr(following)[0][:, : dim - basis.shape[1]]
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
    raise RuntimeError(f"{most_passes} passes are not enough for {m} eigenpairs")

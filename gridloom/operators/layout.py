"""Which variables are neighbours, and places for them in a plane where neighbours stay together."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbours(edges: DataFrame, k: int) -> DataFrame:
    """(a, b, rank, r): of each variable its ``k`` neighbours of the largest correlation, of either sign, in an edge list (a, b, r) that has a pair once or both ways; ties by name."""
    both = edges.where("a <> b and r is not null").select("a", "b", "r").unionByName(edges.where("a <> b and r is not null").select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).dropDuplicates(["a", "b"])
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.abs("r").desc(), "b"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("a", "b", "rank", "r")


def _weights(away: np.ndarray, perplexity: float) -> np.ndarray:
    """Chances that a variable takes another for its neighbour, so spread that each has about ``perplexity`` of them."""
    n = len(away)
    out = np.zeros((n, n))
    for i in range(n):
        low, high, d = 0.0, np.inf, np.delete(away[i], i) ** 2
        beta = 1.0
        for _ in range(60):
            p = np.exp(-(d - d.min()) * beta)
            p /= p.sum()
            spread = -(p * np.log(np.maximum(p, 1e-300))).sum()
            if abs(spread - np.log(perplexity)) < 1e-6:
                break
            low, high = (beta, high) if spread > np.log(perplexity) else (low, beta)
            beta = 2 * beta if np.isinf(high) else (low + high) / 2
        out[i, np.arange(n) != i] = p
    return np.maximum((out + out.T) / (2 * n), 1e-12)


def plane(names: list[str], matrix: np.ndarray, seed: int = 1, perplexity: float = 10.0, steps: int = 600) -> dict[str, tuple[float, float]]:
    """A place for each variable of a correlation matrix, some hundred of them, by t-SNE over the distance 1 - |r|.

    Starting places follow from the seed and the names, so the order of the variables does not matter.
    """
    order = np.argsort(names)
    away = 1 - np.abs(matrix[np.ix_(order, order)])
    n = len(names)
    if n < 3:
        return {names[k]: (float(i), 0.0) for i, k in enumerate(order)}
    p = _weights(away, min(perplexity, (n - 1) / 3))
    draws = [np.frombuffer(hashlib.sha256(f"{seed}:{names[k]}".encode()).digest()[:16], np.uint64) for k in order]
    y = (np.array(draws, float) / 2.0**64 - 0.5) * 1e-2
    speed, gain = np.zeros_like(y), np.ones_like(y)
    for step in range(steps):
        gap = y[:, None] - y[None]
        near = 1 / (1 + (gap**2).sum(2))
        np.fill_diagonal(near, 0)
        pull = (p * (8 if step < 150 else 1) - near / near.sum()) * near
        slope = 4 * (pull[..., None] * gap).sum(1)
        gain = np.maximum(np.where(np.sign(slope) == np.sign(speed), gain * 0.8, gain + 0.2), 0.01)
        speed = (0.5 if step < 150 else 0.8) * speed - max(n / 8, 5.0) * gain * slope
        y = y + speed
        y = y - y.mean(0)
    return {names[k]: (float(a), float(b)) for k, (a, b) in zip(order, y, strict=True)}

"""Event segmentation by greedy state-boundary search: boundaries between stretches of like activity.

Boundaries are put in one at a time where they raise the fit of the stretch means most; the number of states is the one
with the largest t-distance, the difference of correlations within states and across the next boundary.

A row's correlation with the mean of its stretch is a product of two centred rows, so the fit of a stretch follows from
sums over it, and sums over any stretch from running sums: all places for a cut in a stretch are weighed at once, and only
the two stretches that a cut makes are weighed again. Sums of correlations, and of their squares, over pairs of rows
follow from a stretch's sum of directions and its sum of their outer products; no row meets another.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class _Rows:
    """Rows of features: centred, their directions, and running sums of both."""

    def __init__(self, x: np.ndarray) -> None:
        centred = x - x.mean(1, keepdims=True)
        size = np.sqrt((centred**2).sum(1))
        self.unit = centred / np.where(size > 1e-12, size, np.inf)[:, None]
        none = np.zeros((1, x.shape[1]))
        self.sums, self.units = (np.concatenate([none, np.cumsum(v, 0)]) for v in (centred, self.unit))

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The sum of the correlations of rows a to b - 1 with their mean."""
        mean, unit = self.sums[b] - self.sums[a], self.units[b] - self.units[a]
        size = np.sqrt((mean**2).sum(-1))
        return (mean * unit).sum(-1) / np.where(size > 1e-12, size, np.inf)

    def best_cut(self, a: int, b: int) -> tuple[float, int]:
        """The largest gain of a cut between rows a and b, and the first place that has it."""
        places = np.arange(a + 1, b)
        if not len(places):
            return -np.inf, b
        gain = self.fit(np.full(len(places), a), places) + self.fit(places, np.full(len(places), b)) - self.fit(np.array([a]), np.array([b]))
        first = int(np.argmax(gain))
        return float(gain[first]), int(places[first])

    def moments(self, a: int, b: int) -> tuple[int, np.ndarray, np.ndarray, float]:
        """Number of rows, sum of directions, sum of their outer products, sum of their squared lengths."""
        u = self.unit[a:b]
        return b - a, u.sum(0), u.T @ u, float((u**2).sum())


def _t_distance(states: list[tuple[int, np.ndarray, np.ndarray, float]]) -> float:
    within, across = np.zeros(3), np.zeros(3)  # pairs, sum of correlations, sum of their squares
    for n, s, g, own in states:
        lengths = float(round(own))  # a direction's length is 1 or 0, and so is its power
        within += [n * (n - 1) / 2, (s @ s - own) / 2, ((g**2).sum() - lengths) / 2]
    for (n, s, g, _), (m, t, h, _) in itertools.pairwise(states):
        across += [n * m, s @ t, (g * h).sum()]
    if within[0] < 2 or across[0] < 2:
        return -np.inf
    means = [v[1] / v[0] for v in (within, across)]
    spread = np.sqrt(sum(max(v[2] - v[1] ** 2 / v[0], 0.0) / (v[0] - 1) / v[0] for v in (within, across)))
    return float((means[0] - means[1]) / spread) if spread > 1e-12 else -np.inf


def state_ids(x: np.ndarray) -> np.ndarray | None:
    """States, from 0, of rows in time; None where there are too few rows or features that vary."""
    x = x[:, x.std(0) >= 1e-9]
    if x.shape[1] < 2 or len(x) < 6:
        return None
    rows = _Rows((x - x.mean(0)) / x.std(0))
    stretches = {(0, len(x)): (*rows.best_cut(0, len(x)), rows.moments(0, len(x)))}
    best = (-np.inf, [])
    for _ in range(min(max(len(x) // 3, 2), 25) - 1):
        (a, b), (gain, cut, _) = max(stretches.items(), key=lambda s: (s[1][0], -s[1][1]))
        if gain == -np.inf:
            break
        del stretches[a, b]
        for part in ((a, cut), (cut, b)):
            stretches[part] = (*rows.best_cut(*part), rows.moments(*part))
        order = sorted(stretches)
        best = max(best, (_t_distance([stretches[k][2] for k in order]), [k[0] for k in order[1:]]), key=lambda v: v[0])
    out = np.zeros(len(x), int)
    for c in best[1]:
        out[c:] += 1
    return out


def event_segments(rows: DataFrame, features: list[str]) -> DataFrame:
    """(stim_id, bin, event_id, boundary) of rows (stim_id, bin, features): nulls count as the mean; too short a stimulus has null ids and no boundary."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        x = pdf[features].astype(float)
        ids = state_ids(x.fillna(x.mean()).fillna(0.0).to_numpy())
        out = pdf[["stim_id", "bin"]].copy()
        out["event_id"] = pd.array(ids if ids is not None else [None] * len(out), dtype="Int64")
        out["boundary"] = np.append(0, np.diff(ids)).astype("int64") if ids is not None else 0
        return out

    kind = rows.schema["stim_id"].dataType.simpleString()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much to compute: not to be put together by size
    return rows.select("stim_id", "bin", *features).repartition(tasks, "stim_id").groupBy("stim_id").applyInPandas(solve, f"stim_id {kind}, bin {rows.schema['bin'].dataType.simpleString()}, event_id long, boundary long")

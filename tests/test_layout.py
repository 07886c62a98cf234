"""Neighbours of variables and their places."""

import random

import numpy as np
import pytest

from gridloom.operators import layout


def groups(seed=0, per=8, k=4):
    rng = np.random.default_rng(seed)
    common = rng.normal(size=(500, k))
    x = np.concatenate([common[:, [g]] * rng.choice([-1, 1], per) + 0.4 * rng.normal(size=(500, per)) for g in range(k)], 1)
    return [f"v{g}_{i}" for g in range(k) for i in range(per)], np.corrcoef(x.T)


def test_neighbours_stay_together():
    names, r = groups()
    places = layout.plane(names, r)
    for name, at in places.items():
        near = sorted((np.hypot(at[0] - b[0], at[1] - b[1]), other) for other, b in places.items() if other != name)[:5]
        assert sum(other[:2] == name[:2] for _, other in near) >= 4


def test_seeded_and_of_no_order():
    names, r = groups(1, 5, 3)
    places, order = layout.plane(names, r, 3), list(range(len(names)))
    random.Random(2).shuffle(order)
    again = layout.plane([names[i] for i in order], r[np.ix_(order, order)], 3)
    assert all(again[n] == pytest.approx(places[n]) for n in names) and layout.plane(names, r, 4) != places
    assert layout.plane(["a"], np.eye(1)) == {"a": (0.0, 0.0)} and len(layout.plane(["b", "a"], np.eye(2))) == 2


def test_neighbours_of_an_edge_list(spark):
    rows = [("a", "b", 0.5), ("a", "c", -0.9), ("b", "a", 0.5), ("c", "c", 1.0), ("b", "c", None), ("a", "d", 0.5)]
    got = sorted((r.a, r["rank"], r.b) for r in layout.neighbours(spark.createDataFrame(rows, "a string, b string, r double"), 2).collect())
    assert got == [("a", 1, "c"), ("a", 2, "b"), ("b", 1, "a"), ("c", 1, "a"), ("d", 1, "a")]

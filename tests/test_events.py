"""Event segmentation by running sums against the definition: every cut tried, every pair of rows correlated."""

import time

import numpy as np
import pytest

from gridloom.operators import events


def fit(x, cuts):
    edges = [0, *sorted(cuts), len(x)]
    total = 0.0
    for a, b in zip(edges, edges[1:], strict=False):
        mean = x[a:b].mean(0)
        total += sum(np.corrcoef(row, mean)[0, 1] for row in x[a:b])
    return total / len(x)


def t_distance(x, cuts):
    r, state = np.corrcoef(x), np.zeros(len(x), int)
    for c in cuts:
        state[c:] += 1
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x))]
    within, across = (np.array([r[i, j] for i, j in pairs if state[j] - state[i] == d]) for d in (0, 1))
    if len(within) < 2 or len(across) < 2:
        return -np.inf
    return (within.mean() - across.mean()) / np.sqrt(within.var(ddof=1) / len(within) + across.var(ddof=1) / len(across))


def plain(x):
    x = (x - x.mean(0)) / x.std(0)
    cuts, best = [], (-np.inf, [])
    for _ in range(min(max(len(x) // 3, 2), 25) - 1):
        free = [p for p in range(1, len(x)) if p not in cuts]
        if not free:
            break
        cuts = [*cuts, max(free, key=lambda p: (round(fit(x, [*cuts, p]), 10), -p))]
        best = max(best, (t_distance(x, cuts), sorted(cuts)), key=lambda v: v[0])
    out = np.zeros(len(x), int)
    for c in best[1]:
        out[c:] += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_states_are_those_of_the_definition(seed):
    rng = np.random.default_rng(seed)
    levels = rng.normal(size=(5, 6))
    x = np.repeat(levels, rng.integers(3, 9, 5), 0)
    x = x + (0.2 + 0.2 * seed) * rng.normal(size=x.shape)
    assert events.state_ids(x).tolist() == plain(x).tolist()


def test_planted_states_and_odd_inputs():
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(4, 8)), 10, 0) + 0.05 * rng.normal(size=(40, 8))
    assert events.state_ids(x).tolist() == np.repeat(np.arange(4), 10).tolist()
    assert events.state_ids(x[:5]) is None and events.state_ids(np.ones((20, 4))) is None
    assert events.state_ids(np.repeat(x[:1], 20, 0) + np.eye(20, 8)) is not None


def test_long_stimuli_take_time_in_proportion():
    rng = np.random.default_rng(8)
    began = time.time()
    events.state_ids(rng.normal(size=(20_000, 12)))
    assert time.time() - began < 20

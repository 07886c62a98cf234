"""Components, factors and designs of the queries against plain computations on the same rows."""

import numpy as np
import pandas as pd
import pytest

from gridloom.operators import design, factors
from gridloom.plans import on_corpus
from gridloom.plans.all import QUERIES


@pytest.fixture(scope="module")
def items(spark, sf):
    return on_corpus.items(spark, sf).toPandas().sort_values(["stim_id", "bin"])


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()], float)


def z_scores(items):
    x = items[on_corpus.ITEMS]
    return (x - x.mean()) / x.std()


def whole_segments(items):
    z = z_scores(items).assign(stim_id=items.stim_id, seg=items.bin // 10)
    return {k: g[on_corpus.ITEMS].to_numpy() for k, g in z.groupby(["stim_id", "seg"]) if len(g) == 10}


def objective(rows):
    return np.linalg.slogdet(np.cov(rows, rowvar=False) + 1e-3 * np.eye(rows.shape[1]))[1]


def test_greedy_design(spark, sf, items):
    segments, chosen, want = whole_segments(items), [], []
    for _ in range(20):
        value = {k: objective(np.concatenate([*(segments[c] for c in chosen), x])) for k, x in segments.items() if k not in chosen}
        best = max(value, key=lambda k: (round(value[k], 9), tuple(-v for v in k)))
        chosen.append(best)
        want.append((*best, value[best]))
    got = QUERIES["d_optimal"](spark, sf).orderBy("step").collect()
    assert [(r.stim_id, r.seg) for r in got] == [w[:2] for w in want]
    assert [r.objective for r in got] == pytest.approx([w[2] for w in want])


def test_random_designs(spark, sf, items):
    """The mean of twenty draws lies where plain random draws lie, and below the greedy choice."""
    segments = whole_segments(items)
    rng, names = np.random.default_rng(0), list(segments)
    plain = np.array([[objective(np.concatenate([segments[names[i]] for i in draw[:k]])) for k in (5, 20)] for draw in (rng.choice(len(names), 20, replace=False) for _ in range(200))])
    got = {r.step: r.objective for r in QUERIES["random_trace"](spark, sf).collect()}
    assert len(got) == 20
    for at, step in enumerate((5, 20)):
        assert abs(got[step] - plain[:, at].mean()) < 5 * plain[:, at].std() / np.sqrt(20)
    stats = design.sufficient_stats(design.design_segments(on_corpus.standardized(spark, sf), 10), on_corpus.ITEMS)
    one = design.random_trace(stats, 4, 6, 1, seed=3)
    from pyspark.sql import functions as F

    drawn = [(r.stim_id, r.seg) for r in stats.orderBy(F.xxhash64(F.lit(3), F.lit(0), "stim_id", "seg"), "stim_id", "seg").limit(6).collect()]
    assert [v for _, v in one] == pytest.approx([objective(np.concatenate([segments[k] for k in drawn[: i + 1]])) for i in range(6)])


def test_explained_variance(spark, sf, vectors):
    values = np.sort(np.linalg.eigvalsh(np.cov(vectors, rowvar=False)))[::-1]
    got = QUERIES["pca_explained"](spark, sf).orderBy("k").collect()
    assert [r.percent for r in got] == pytest.approx((100 * values / values.sum()).tolist(), abs=1e-5)
    assert [r.cumulative for r in got] == pytest.approx((100 * values.cumsum() / values.sum()).tolist(), abs=1e-5)


def likelihood(r, loadings):
    model = loadings @ loadings.T
    np.fill_diagonal(model, 1.0)
    return -np.linalg.slogdet(model)[1] - np.trace(np.linalg.solve(model, r))


def test_loadings_are_the_most_likely(spark, sf, items):
    """No small step of any loading makes the correlations likelier."""
    r = np.corrcoef(items[on_corpus.ITEMS].to_numpy(), rowvar=False)
    got = QUERIES["factor_loadings"](spark, sf).toPandas()
    load = got.set_index("variable").loading[on_corpus.ITEMS].to_numpy()[:, None]
    best = likelihood(r, load)
    steps = [likelihood(r, load + s * np.eye(4)[:, [k]]) for k in range(4) for s in (-0.02, 0.02) if abs(load[k, 0] + s) < 0.997]
    assert max(steps) <= best + 1e-4
    rng = np.random.default_rng(4)
    true = np.concatenate([rng.uniform(0.5, 0.9, (8, 1)) * m for m in ([[1, 0]], [[0, 1]])])
    known = true @ true.T
    np.fill_diagonal(known, 1.0)
    found = factors.factor_analysis(known, 2)
    turned = found if np.abs(found[:8, 0]).sum() > np.abs(found[8:, 0]).sum() else found[:, ::-1]
    assert np.abs(np.abs(turned) - np.abs(true)).max() < 0.02


def test_scores_are_weights_times_rows(spark, sf, items):
    """Regression scores: the loadings through the inverse of the correlations, times the rows' z-scores."""
    load = QUERIES["factor_loadings"](spark, sf).toPandas().set_index("variable").loading[on_corpus.ITEMS].to_numpy()
    z = z_scores(items).to_numpy()
    want = z @ np.linalg.solve(np.corrcoef(items[on_corpus.ITEMS].to_numpy(), rowvar=False), load)
    got = QUERIES["factor_scores"](spark, sf).toPandas().merge(items.assign(want=want)[["stim_id", "bin", "want"]], on=["stim_id", "bin"])
    assert len(got) == len(items) and np.abs(got.f1 - got.want).max() < 2e-5


def test_blocks(spark, sf, items, vectors):
    got = QUERIES["category_factors"](spark, sf).toPandas().set_index("category")
    r = np.corrcoef(items[on_corpus.ITEMS].to_numpy(), rowvar=False)
    pair = [on_corpus.ITEMS.index(c) for c, k in on_corpus.ITEM_CLASS.items() if k == "visual"]
    assert got.percent["visual"] == pytest.approx(100 * np.linalg.eigvalsh(r[np.ix_(pair, pair)])[-1] / 2, abs=1e-5)
    assert (got.method["visual"], got.m["visual"], got.percent["audio"]) == ("components", 1, 100)
    assert got.method["embedding"] == got.method["embedding, 24 of it"] == "factors"
    part = np.corrcoef(vectors[:, :24], rowvar=False)
    bound = 100 * np.sort(np.linalg.eigvalsh(part))[::-1][:10].sum() / 24
    assert got.percent["embedding, 24 of it"] <= bound + 1e-6
    assert got.percent["embedding, 24 of it"] == pytest.approx(100 * (factors.factor_analysis(part, 10) ** 2).sum() / 24, abs=1e-3)


def test_states_of_the_query(spark, sf):
    from gridloom.operators import events

    rows = on_corpus.gaps(spark, sf).toPandas()
    got = QUERIES["event_segments"](spark, sf).toPandas()
    for stim, own in list(rows.groupby("stim_id"))[:25]:
        x = own.sort_values("bin")[on_corpus.KINDS].astype(float)
        ids = events.state_ids(x.fillna(x.mean()).fillna(0.0).to_numpy())
        found = got[got.stim_id == stim].sort_values("bin").event_id
        assert found.isna().all() if ids is None else found.tolist() == ids.tolist()
    assert isinstance(got, pd.DataFrame)


def test_sums_of_segments_in_one_pass(spark):
    """Those of the whole segments, without a join; and of many pairs of columns in passes that Spark compiles."""
    from gridloom.operators import corpus

    rows = spark.createDataFrame([(s, k, float((7 * k + s) % 5), None if k % 3 == s else float(k % 4)) for s in range(3) for k in range(25 + s)], "stim_id long, bin int, a double, b double")
    one = design.segment_stats(rows, 10, ["a", "b"])
    two = design.sufficient_stats(design.design_segments(rows, 10), ["a", "b"])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
    wide = rows.selectExpr("a", "b", *(f"a * {k} + coalesce(b, {k}) AS c{k}" for k in range(6)), "1.0D AS flat")
    names = wide.columns
    found = corpus.moments(wide, names)
    data = wide.toPandas().astype(float)
    r = data.corr(min_periods=2)
    for e in found.collect():
        want = 1.0 if e.a == e.b else np.nan_to_num(r.loc[e.a, e.b])
        assert e.r == pytest.approx(want, abs=1e-9) and e.n == (data[e.a].notna() & data[e.b].notna()).sum()
    assert found.count() == len(names) ** 2
    for passed in found._jdf.queryExecution().optimizedPlan().toString().split("Union")[1:]:
        assert max((line.count("covar_pop") for line in passed.split("\n") if "Aggregate" in line), default=0) <= corpus.PAIRS


def test_a_choice_without_rest_takes_no_segment_twice(spark):
    """Two segments, one of which is never positive definite: each is taken once, and then none."""
    stats = spark.createDataFrame([(1, 0, 10, [0.0], [-100.0]), (2, 0, 10, [1.0], [5.0])], "stim_id long, seg int, n long, s array<double>, ss array<double>")
    assert [c[1:3] for c in design.greedy(stats, 1, 4)] == [(2, 0), (1, 0)]

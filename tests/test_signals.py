"""Hand-computed cases of sequences, vectors, search and design."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import design, factors, search, shape
from gridloom.operators import events as segmentation
from gridloom.operators import signals as S
from gridloom.sources import stimuli as sources


def test_cut_refractory(spark):
    rows = spark.createDataFrame([("s", t, d) for t, d in [(0.25, 0.7), (0.5, 0.8), (0.75, 0.1), (1.0, 0.9)]], "stim_id string, t double, distance double")
    assert sorted(r.t for r in S.detect_cuts(rows, 0.6, 0.5).collect()) == [0.25, 1.0]


def test_shot_index(spark):
    cuts = spark.createDataFrame([("s", 1.0), ("s", 2.5)], "stim_id string, t double")
    grid = spark.createDataFrame([("s", b, float(b)) for b in range(5)], "stim_id string, bin int, time_sec double")
    assert [r.shot for r in S.shot_index(cuts, grid).orderBy("bin").collect()] == [0, 1, 1, 2, 2]


def test_vector_series(spark):
    rows = spark.createDataFrame([("s", 0, [1.0, 0.0]), ("s", 1, [0.0, 1.0]), ("s", 2, [1.0, 0.0])], "stim_id string, i int, vec array<double>")
    got = lambda df, c: [r[c] for r in df.orderBy("i").collect()]
    assert got(S.coherence(rows), "coherence") == [None, 0, 0]
    assert got(S.novelty(rows), "novelty") == [None, 1, 0]
    assert got(S.drift(rows), "drift") == [None, 1e-9, pytest.approx(0.7071067821865474, abs=1e-15)]


@pytest.mark.parametrize(("n", "want"), [(5, [0, 2, 4]), (4, [0, 1, 3]), (2, [0, 1]), (1, [0])])
def test_even_pick(spark, n, want):
    rows = spark.createDataFrame([("s", i) for i in range(n)], "k string, i int")
    assert sorted(r.place for r in S.evenly_spaced(rows, ["k"], ["i"], 3).collect()) == want


def test_tails_of_segments(spark):
    values = spark.createDataFrame([("s", b, "p", 1.0) for b in range(7)], "stim_id string, bin int, path string, num double")
    assert sorted(r.seg for r in search.segment_means(values, 3).collect()) == [0, 1, 2]
    kept = design.design_segments(values, 3)
    assert sorted({r.seg for r in kept.collect()}) == [0, 1]


def test_search_score(spark):
    stats = spark.createDataFrame([("a", 1.0, 2.0), ("b", 0.0, 1.0)], "path string, mean double, std double")
    segments = spark.createDataFrame([("x", 0, "a", 3.0), ("x", 0, "b", None), ("y", 0, "a", 1.0), ("y", 0, "b", -2.0)], "stim_id string, seg int, path string, v double")
    got = {r.stim_id: (r.score, r.k) for r in search.search(segments, stats, {"a": 1, "b": -1}).collect()}
    assert got == {"x": (1.0, 1), "y": (1.0, 2)}


def test_design(spark):
    assert design.log_det(2, np.array([2.0]), np.array([[2.0]])) == pytest.approx(math.log(0.001))
    rows = spark.createDataFrame([("a", 0, 2, [2.0], [2.0]), ("b", 0, 2, [2.0], [10.0])], "stim_id string, seg int, n long, s array<double>, ss array<double>")
    chosen = design.greedy(rows, 1, 2)
    assert [(c[1], pytest.approx(c[3], abs=1e-6)) for c in chosen] == [("b", 2.079567), ("a", 0.981204)]


def test_histogram_edge(spark):
    assert spark.range(1).select(scalars.histogram_bin(F.lit(1.0), 16)).first()[0] == 15


def test_argmax_takes_the_first(spark):
    rows = spark.createDataFrame([([0.1, 0.5, 0.5],), (None,)], "v array<double>")
    assert [r[0] for r in rows.select(scalars.argmax(F.col("v"))).collect()] == [1, -1]


def test_softmax(spark):
    got = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>").select(scalars.softmax(F.col("v"))).first()[0]
    want = np.exp([1.0, 2.0, 3.0]) / np.exp([1.0, 2.0, 3.0]).sum()
    assert got == pytest.approx(want.tolist())


def test_timeline_of_a_story(spark):
    text = " ".join(f"w{i}" + ("." if i in (10, 26) else "") for i in range(93))
    words = sources.text_timeline(spark.createDataFrame([("s", text)], "stim_id string, text string")).collect()
    bins = [round(w.start) for w in words]  # halves do not occur at three words a second
    counts = [bins.count(b) for b in range(31)]
    assert counts == [2] + [3] * 30
    assert max(w.seg_idx for w in words) == 2


def test_skeletons_are_never_data(spark):
    template = sources.template(spark)
    one = spark.createDataFrame([("s", 2.0)], "stim_id string, duration_sec double")
    grid = spark.createDataFrame([("s", 0), ("s", 1)], "stim_id string, bin int")
    filled = shape.skeleton_fill(one, template, spark.createDataFrame([("s", "audio/low_level/rms")], "stim_id string, path string"), grid)
    assert filled.count() == 102 * 2
    num, code, label = shape.encoded(F.col("dtype"), F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit(None).cast("string"))
    stored = filled.select("dtype", num.alias("num"), code.alias("code"), label.alias("label"))
    assert stored.where("dtype = 'event' and num <> 0").count() == 0
    assert stored.select(shape.renull(F.col("num"), F.lit(False)).alias("x")).where("x is not null").count() == 0


def test_template_counts(spark):
    template = sources.template(spark)
    assert {r.dtype: r["count"] for r in template.groupBy("dtype").count().collect()} == {"scalar": 71, "bool": 3, "event": 2, "vector": 15, "categorical": 6, "label": 6}
    assert shape.feature_info(template).where("numeric").count() == 7899


def test_duplicates_are_fatal(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    with pytest.raises(ValueError, match="a"):
        sources.require_unique(rows)


def test_factor_rules():
    assert [factors.most_factors(d) for d in (2, 3, 5, 10)] == [0, 1, 2, 6]
    assert factors.block_size(4096) == 10 and factors.block_size(1) == 1
    matrix = np.array([[1.0, 0.9999, 0.1], [0.9999, 1.0, 0.1], [0.1, 0.1, 1.0]])
    assert factors.kept_columns(matrix, ["a", "b", "c"]) == ["a", "c"]
    fixed = factors.nearest_positive(np.array([[1.0, 1.2], [1.2, 1.0]]))
    assert np.linalg.eigvalsh(fixed).min() > 0 and np.allclose(np.diag(fixed), 1)


def test_factor_analysis_finds_one_factor():
    load = np.array([0.9, 0.8, 0.7, 0.6])
    matrix = np.outer(load, load)
    np.fill_diagonal(matrix, 1)
    assert np.allclose(factors.factor_analysis(matrix, 1)[:, 0], load, atol=0.02)


def test_states_of_a_step():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (12, 4)) + [1, 0, 0, 2], rng.normal(0, 0.1, (12, 4)) + [0, 1, 2, 0]])
    assert segmentation.state_ids(x).tolist() == [0] * 12 + [1] * 12
    assert segmentation.state_ids(x[:5]) is None


def test_a_sentence_keeps_the_digits_that_are_its_number(spark):
    """Sentence 1 begins with a 1 and sentence 2 ends with a 2: neither is trimmed off; spaces are."""
    docs = spark.createDataFrame([("s", "  One. 1 and 10.2.1 fits.  22 of 2  ")], "stim_id string, text string")
    assert [(r.seg_idx, r.text) for r in sorted(sources.text_timeline(docs).collect(), key=lambda r: r.i)] == [(0, "One."), (1, "1"), (1, "and"), (1, "10.2.1"), (1, "fits."), (2, "22"), (2, "of"), (2, "2")]


def test_interpolation_of_many_samples_takes_time_in_proportion(spark):
    """Two hundred thousand samples of one stimulus, some far from all points; looked through once, not once for each sample."""
    import time

    rng = np.random.default_rng(3)
    t = np.concatenate([rng.uniform(0, 100, 200_000), [5000.0, -5000.0]])
    v = np.round(np.sin(t), 6)
    samples = spark.createDataFrame(pd.DataFrame({"stim_id": "s", "t": t, "v": v})).union(spark.createDataFrame([("one", 3.0, 7.0), ("nan", float("nan"), 1.0), ("nan", 2.0, 4.0)], "stim_id string, t double, v double"))
    at = np.concatenate([rng.uniform(-6000, 6000, 50), rng.uniform(0, 100, 50), t[:5]])
    points = spark.createDataFrame([*(("s", float(x)) for x in at), ("one", 1.0), ("one", 3.0), ("one", 9.0), ("nan", 1.0), ("none", 1.0)], "stim_id string, at double")
    began = time.time()
    got = S.interpolate(samples, points).collect()
    took = time.time() - began
    order = np.argsort(t)
    want = np.interp(at, t[order], v[order])
    found = dict(((r.stim_id, r.at), r.v) for r in got)
    assert len(got) == len(at) + 5 and np.allclose([found["s", x] for x in at], want)
    assert [found["one", x] for x in (1.0, 3.0, 9.0)] == [7.0] * 3 and found["nan", 1.0] == 4.0 and found["none", 1.0] is None
    assert took < 60


def test_bins_of_texts_in_one_file_are_dealt_out(spark, tmp_path):
    spark.range(64, numPartitions=1).select(F.col("id").alias("stim_id"), F.lit("a b c d e f g").alias("text")).write.parquet(f"{tmp_path}/texts")
    rates = sources.text_rates(spark.read.parquet(f"{tmp_path}/texts"))
    assert rates.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert rates.groupBy().agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()[:] == (64 * 5, 64 * 2)  # bins 0 and 1: words 0 and 1, then 2 to 4

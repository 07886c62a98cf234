"""Hand-computed cases of the grid and of spans."""

import math

import pytest

from gridloom.operators import grid as G
from gridloom.operators import spans

T = [0.0, 0.4, 0.5, 1.5, 2.5, 4.49, 4.5, 4.51]


def samples(spark, values=None):
    values = values or [float(i + 1) for i in range(len(T))]
    return spark.createDataFrame([("s", t, v) for t, v in zip(T, values, strict=True)], "stim_id string, t double, v double")


def grid(spark, duration=5.0):
    return G.time_grid(spark.createDataFrame([("s", duration)], "stim_id string, duration_sec double"))


def column(df, name):
    return [r[name] for r in df.orderBy("bin").collect()]


def test_bin_index_rounds_half_to_even(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(float(t),) for t in [*T, -0.5, -0.51]], "t double")
    assert [r[0] for r in rows.select(G.bin_index(F.col("t"))).collect()] == [0, 0, 0, 2, 2, 4, 4, 5, 0, -1]


@pytest.mark.parametrize(("op", "want"), [("mean", [2, None, 4.5, None, 6.5]), ("max", [3, None, 5, None, 7]), ("sum", [6, None, 9, None, 13])])
def test_reducers(spark, op, want):
    assert column(G.reduce_scalar(samples(spark), grid(spark), op), "v") == want


def test_nearest(spark):
    got = column(G.reduce_scalar(samples(spark), grid(spark), "nearest"), "v")
    assert (got[0], got[4]) == (1, 6)
    assert got[2] == 4  # of two as near, the earlier


def test_bin_of_missing_values_sums_to_zero(spark):
    rows = spark.createDataFrame([("s", 0.0, math.nan), ("s", 2.0, None)], "stim_id string, t double, v double")
    assert column(G.reduce_scalar(rows, grid(spark), "sum"), "v") == [0, None, 0, None, None]
    assert column(G.reduce_scalar(rows, grid(spark), "mean"), "v") == [None] * 5


def test_unknown_reducer(spark):
    with pytest.raises(ValueError, match="median"):
        G.reduce_scalar(samples(spark), grid(spark), "median")


def test_event_count(spark):
    assert column(G.event_count(samples(spark), grid(spark)), "n") == [3, 0, 2, 0, 2]


def test_order_of_rows_does_not_matter(spark):
    rows = samples(spark)
    for op in G.REDUCERS:
        assert column(G.reduce_scalar(rows, grid(spark), op), "v") == column(G.reduce_scalar(rows.orderBy("v", ascending=False), grid(spark), op), "v")


def test_short_stimulus_has_no_grid(spark):
    assert grid(spark, 0.5).count() == 0


def test_span_flag_and_mean(spark):
    one = spark.createDataFrame([("s", 5.0)], "stim_id string, duration_sec double")
    words = spark.createDataFrame([("s", 0.2, 0.7, 1.0), ("s", 2.5, 3.4, 1.0)], "stim_id string, start double, end double, v double")
    assert column(spans.any_overlap(words, one, grid(spark)), "flag") == [1, 1, 1, 1, 0]
    ab = spark.createDataFrame([("s", 0.0, 2.0, 1.0), ("s", 1.6, 3.0, 3.0)], "stim_id string, start double, end double, v double")
    assert column(spans.span_mean(ab, one, grid(spark)), "v") == [1, 1, 2, 3, None]
    edge = spark.createDataFrame([("s", -1.0, 0.4, 1.0), ("s", 6.0, 8.0, 2.0)], "stim_id string, start double, end double, v double")
    assert column(spans.span_mean(edge, one, grid(spark)), "v") == [1, None, None, None, None]


def test_last_window_wins(spark):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([("s", 4.0)], "stim_id string, duration_sec double")
    windows = spark.createDataFrame([("s", 0.0, 2.0, "a", 0), ("s", 2.0, 4.0, "b", 1)], "stim_id string, start double, end double, label string, k int")
    assert column(spans.last_wins(windows, one, grid(spark, 4.0), F.col("label"), F.col("k")), "value") == ["a", "a", "b", "b"]

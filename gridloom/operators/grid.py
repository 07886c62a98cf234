"""Irregular samples onto a common time grid.

A grid has n = floor(duration x rate) bins whose centres are at bin / rate. A sample belongs to the bin nearest to it,
halves to the even one; samples outside the grid are dropped. A bin without samples is null, except where a count says 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import clean_nan

REDUCERS = ("mean", "max", "sum", "nearest")


def time_grid(stimuli: DataFrame, rate: float = 1.0, start: float = 0.0) -> DataFrame:
    """(stim_id, bin, time_sec) of stimuli (stim_id, duration_sec); a duration under one bin gives no row."""
    n = F.floor(F.col("duration_sec") * rate + 1e-9).cast("int")
    bins = stimuli.where(n >= 1).select("stim_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("bin"))
    return bins.withColumn("time_sec", F.lit(start) + F.col("bin") / F.lit(float(rate)))


def bin_index(t: Column, rate: float = 1.0, start: float = 0.0) -> Column:
    return F.rint((t - F.lit(start)) * F.lit(float(rate))).cast("int")


def _binned(samples: DataFrame, rate: float) -> DataFrame:
    return samples.where("t is not null and not isnan(t)").withColumn("bin", bin_index(F.col("t"), rate))


def reduce_scalar(samples: DataFrame, grid: DataFrame, op: str = "mean", rate: float = 1.0) -> DataFrame:
    """(stim_id, bin, v) for every bin of the grid, of samples (stim_id, t, v).

    A bin with samples that are all missing sums to 0; one without samples is null. ``nearest`` takes the sample nearest
    to the bin's centre, and of equals the earliest.
    """
    if op not in REDUCERS:
        raise ValueError(f"no reducer {op}")
    v = clean_nan(F.col("v"))
    rows = _binned(samples, rate)
    if op == "nearest":
        away = F.abs(F.col("t") * rate - F.col("bin"))
        found = rows.groupBy("stim_id", "bin").agg(F.min_by(v, F.struct(away, "t")).alias("v"))
    else:
        found = rows.groupBy("stim_id", "bin").agg({"mean": F.avg(v), "max": F.max(v), "sum": F.coalesce(F.sum(v), F.lit(0.0))}[op].alias("v"))
    return grid.join(found, ["stim_id", "bin"], "left").select("stim_id", "bin", "v")


def event_count(onsets: DataFrame, grid: DataFrame, rate: float = 1.0) -> DataFrame:
    """(stim_id, bin, n): onsets (stim_id, t) in each bin, 0 where there is none."""
    found = _binned(onsets, rate).groupBy("stim_id", "bin").agg(F.count("*").alias("n"))
    return grid.join(found, ["stim_id", "bin"], "left").select("stim_id", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def mode_label(samples: DataFrame, grid: DataFrame, rate: float = 1.0) -> DataFrame:
    """(stim_id, bin, label): the most frequent label of samples (stim_id, t, label), of equals the first by name."""
    counted = _binned(samples.where("label is not null"), rate).groupBy("stim_id", "bin", "label").count()
    best = counted.groupBy("stim_id", "bin").agg(F.min_by("label", F.struct(-F.col("count"), F.col("label"))).alias("label"))
    return grid.join(best, ["stim_id", "bin"], "left").select("stim_id", "bin", "label")


def reduce_vector(samples: DataFrame, grid: DataFrame, rate: float = 1.0) -> DataFrame:
    """(stim_id, bin, vec): means, component by component, of samples (stim_id, t, vec)."""
    parts = _binned(samples, rate).select("stim_id", "bin", F.posexplode("vec").alias("k", "x"))
    means = parts.groupBy("stim_id", "bin", "k").agg(F.avg(clean_nan(F.col("x"))).alias("x"))
    whole = means.groupBy("stim_id", "bin").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v"))
    return grid.join(whole, ["stim_id", "bin"], "left").select("stim_id", "bin", F.transform("v", lambda e: e["x"]).alias("vec"))


def broadcast_constant(constants: DataFrame, grid: DataFrame) -> DataFrame:
    """(stim_id, bin, v): one value (stim_id, v) in every bin of its stimulus."""
    return grid.join(constants, "stim_id", "left").select("stim_id", "bin", "v")


def presence(count: Column) -> Column:
    """1 where something was counted, 0 where nothing was, null where nobody looked."""
    return F.when(count.isNotNull(), (count > 0).cast("int"))


def min_max(v: Column, least: Column, most: Column, floor: float = 1e-6) -> Column:
    return (v - least) / (most - least + F.lit(floor))

"""Spans of time onto bins. A span covers the bins from its start's to its end's, both included, within the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.grid import bin_index


def span_bins(spans: DataFrame, stimuli: DataFrame, rate: float = 1.0) -> DataFrame:
    """One row for each bin that a span covers: the columns of spans (stim_id, start, end) and bin.

    Rows are made by counting from bin to bin, so there is no range join; spans outside the grid give none. Of the two
    sides only the stimuli, a row each, may be sent to all.
    """
    last = stimuli.select("stim_id", (F.floor(F.col("duration_sec") * rate + 1e-9).cast("int") - 1).alias("last_bin"))
    low = F.greatest(bin_index(F.col("start"), rate), F.lit(0))
    high = F.least(bin_index(F.col("end"), rate), F.coalesce("last_bin", F.lit(-1)))
    return spans.join(last, "stim_id", "left").where(low <= high).withColumn("bin", F.explode(F.sequence(low, high))).drop("last_bin")


def span_mean(spans: DataFrame, stimuli: DataFrame, grid: DataFrame, rate: float = 1.0) -> DataFrame:
    """(stim_id, bin, v): the mean of the values v of the spans over a bin, null where there is none."""
    found = span_bins(spans, stimuli, rate).groupBy("stim_id", "bin").agg(F.avg("v").alias("v"))
    return grid.join(found, ["stim_id", "bin"], "left").select("stim_id", "bin", "v")


def any_overlap(spans: DataFrame, stimuli: DataFrame, grid: DataFrame, rate: float = 1.0) -> DataFrame:
    """(stim_id, bin, flag): 1 where a span covers the bin, else 0."""
    found = span_bins(spans, stimuli, rate).select("stim_id", "bin").distinct().withColumn("flag", F.lit(1))
    return grid.join(found, ["stim_id", "bin"], "left").select("stim_id", "bin", F.coalesce("flag", F.lit(0)).alias("flag"))


def last_wins(spans: DataFrame, stimuli: DataFrame, grid: DataFrame, value: Column, order: Column, rate: float = 1.0) -> DataFrame:
    """(stim_id, bin, value): of the spans over a bin, the value of the last by ``order``."""
    found = span_bins(spans, stimuli, rate).groupBy("stim_id", "bin").agg(F.max_by(value, order).alias("value"))
    return grid.join(found, ["stim_id", "bin"], "left").select("stim_id", "bin", "value")

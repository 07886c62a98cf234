"""Segments of a fixed number of bins, their channel means, and ranked search among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom import schemas


def segment_means(values: DataFrame, length: int, rate: float = 1.0) -> DataFrame:
    """(stim_id, seg, path, t0, t1, v): means of values (stim_id, bin, path, num) over ``length`` bins, to four places; the last segment may be shorter. Index channels are left out."""
    rows = values.where(~F.col("path").isin(*schemas.INDEX_CHANNELS)).withColumn("seg", F.floor(F.col("bin") / length).cast("int"))
    means = rows.groupBy("stim_id", "seg", "path").agg(F.round(F.avg("num"), 4).alias("v"), (F.max("bin") + 1).alias("n"))
    longest = F.max("n").over(Window.partitionBy("stim_id"))
    t1 = F.least((F.col("seg") + 1) * length, longest) / F.lit(rate)
    return means.select("stim_id", "seg", "path", (F.col("seg") * length / F.lit(rate)).alias("t0"), t1.alias("t1"), "v")


def channel_stats(segments: DataFrame) -> DataFrame:
    """(path, mean, std) over segments, of the population; channels whose deviation rounds to 0 at four places are left out."""
    found = segments.groupBy("path").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return found.where(F.round("std", 4) > 0)


def search(segments: DataFrame, stats: DataFrame, directions: dict[str, int], n: int = 20, where: Column | None = None) -> DataFrame:
    """The ``n`` segments with the largest mean of direction x z-score over the chosen channels, and k, how many of these they have."""
    chosen = F.create_map(*[F.lit(x) for kv in directions.items() for x in kv])
    rows = segments.where(F.col("path").isin(*directions) & F.col("v").isNotNull())
    rows = rows.where(where) if where is not None else rows
    z = chosen[F.col("path")] * (F.col("v") - F.col("mean")) / F.col("std")
    scored = rows.join(stats.where("std > 0"), "path").groupBy("stim_id", "seg").agg(F.avg(z).alias("score"), F.count("*").alias("k"))
    return scored.orderBy(F.col("score").desc(), "stim_id", "seg").limit(n)


def ranked(found: DataFrame) -> DataFrame:
    """Adds rank, from 1, to the few rows of a search."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "stim_id", "seg")))


def timeline(segments: DataFrame, stats: DataFrame) -> DataFrame:
    """(stim_id, seg, t0, path, z): z-scores in time."""
    return segments.join(stats, "path").select("stim_id", "seg", "t0", "path", ((F.col("v") - F.col("mean")) / F.col("std")).alias("z"))

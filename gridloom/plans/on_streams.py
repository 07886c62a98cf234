"""The streaming operators over ``events``, read as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans import on_vectors  # noqa: F401  its SQL is taken up here
from gridloom.plans.on_events import NATIVE, hours
from gridloom.plans.registry import ORACLES
from gridloom.plans.registry import query
from gridloom.streaming import live


@query(f"WITH {NATIVE} SELECT stim_id, floor(t + 0.5)::BIGINT AS bin, round(avg(v), 6) AS v, count(*)::BIGINT AS n FROM native GROUP BY ALL")
def stream_grid_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = live.event_stream(spark, sf_dir, lambda e: e.select(F.col("event_type").alias("stim_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v")))
    found = live.latest(live.run_available(spark, live.grid_means(stream, 3600), "update", "grid"), ["stim_id", "time"])
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return found.select("stim_id", F.floor((F.unix_micros("time") - start) / F.lit(3.6e9)).alias("bin"), F.round("v", 6).alias("v"), "n")


@query(ORACLES["cut_detect"])
def stream_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = live.event_stream(spark, sf_dir, lambda e: e.select(F.col("event_type").alias("stim_id"), hours().alias("t"), F.col("value").alias("v")))
    return live.run_available(spark, live.cut_times(stream, 49.0, 0.5), "append", "cuts").select("stim_id", F.round("t", 6).alias("t"))


@query(ORACLES["frame_decimate"])
def stream_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = live.event_stream(spark, sf_dir, lambda e: e.select(F.col("event_type").alias("stim_id"), hours().alias("t")))
    return live.run_available(spark, live.kept_frames(stream, 0.5), "append", "kept").select("stim_id", F.round("t", 6).alias("t"))


@query(ORACLES["semantic_drift"])
def stream_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = live.event_stream(spark, sf_dir, lambda e: e.select(F.col("label").cast("string").alias("stim_id"), F.col("vec_id").alias("i"), F.transform("embedding", lambda x: x.cast("double")).alias("vec")), "embeddings")
    return live.run_available(spark, live.running_drift(stream), "append", "drift").select(F.col("stim_id").cast("int").alias("stim_id"), "i", F.round("drift", 6).alias("drift"))

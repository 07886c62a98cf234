"""Grid aggregation and cut detection on streams.

A stream's bins are those of the batch operators: centred on their times, so windows are shifted by half a bin. Samples
later than the watermark are dropped, as samples outside the grid are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.shared import new_path


def grid_means(stream: DataFrame, bin_seconds: int, late: str = "1 hour") -> DataFrame:
    """(stim_id, time, v, n): running means of a stream (stim_id, ts, v) in bins centred on multiples of ``bin_seconds``."""
    half = f"{-bin_seconds // 2} seconds" if bin_seconds % 2 == 0 else f"{-bin_seconds * 500} milliseconds"
    window = F.window("ts", f"{bin_seconds} seconds", startTime=half)
    binned = stream.withWatermark("ts", late).groupBy("stim_id", window.alias("w")).agg(F.avg("v").alias("v"), F.count("v").alias("n"))
    return binned.select("stim_id", (F.col("w.start") + F.expr(f"INTERVAL {bin_seconds * 500} MILLISECONDS")).alias("time"), "v", "n")


def cut_times(stream: DataFrame, threshold: float, gap: float) -> DataFrame:
    """(stim_id, t): samples (stim_id, t, v) that differ by more than ``threshold`` from the one before, ``gap`` or more after the last cut.

    What is kept of a stimulus between batches is its last value and its last cut.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, last = state.get if state.exists else (None, None)
        cuts = []
        for t, v in pd.concat(list(batches)).sort_values(["t", "v"])[["t", "v"]].itertuples(index=False):
            if value is not None and abs(v - value) > threshold and (last is None or t - last >= gap):
                cuts.append(t)
                last = t
            value = v
        state.update((value, last))
        yield pd.DataFrame({"stim_id": [key[0]] * len(cuts), "t": cuts})

    return stream.select("stim_id", "t", "v").groupBy("stim_id").applyInPandasWithState(step, "stim_id string, t double", "value double, last double", "append", GroupStateTimeout.NoTimeout)


def kept_frames(stream: DataFrame, rate: float) -> DataFrame:
    """(stim_id, t): samples (stim_id, t) kept at ``rate``. What is kept of a stimulus between batches is when the next one is due."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (due,), kept = state.get if state.exists else (0.0,), []
        for t in pd.concat(list(batches))["t"].sort_values():
            if t + 1e-6 >= due:
                kept.append(t)
                due = t + 1.0 / rate
        state.update((due,))
        yield pd.DataFrame({"stim_id": [key[0]] * len(kept), "t": kept})

    return stream.select("stim_id", "t").groupBy("stim_id").applyInPandasWithState(step, "stim_id string, t double", "due double", "append", GroupStateTimeout.NoTimeout)


def running_drift(stream: DataFrame) -> DataFrame:
    """(stim_id, i, drift): the product of each vector (stim_id, i, vec) with the direction of the sum of all before it. What is kept of a stimulus is that sum."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = np.array(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("i")
        out = []
        for vec in rows["vec"]:
            x = np.asarray(vec, float)
            out.append(None if total is None else float(x @ total / np.sqrt(total @ total) + 1e-9 * x.sum()))
            total = x if total is None else total + x
        state.update((total.tolist(),))
        yield pd.DataFrame({"stim_id": [key[0]] * len(rows), "i": rows["i"].to_numpy(), "drift": out})

    return stream.select("stim_id", "i", "vec").groupBy("stim_id").applyInPandasWithState(step, "stim_id string, i long, drift double", "total array<double>", "append", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, result: DataFrame, mode: str, name: str, folder: str | None = None) -> DataFrame:
    """Run a stream over what there is now and return all that it gave, with the number of the batch that gave it.

    Each batch is a folder of its own, overwritten where the batch is repeated, so a restart gives no row twice. With a
    ``folder`` the run goes on from where the last one with it ended.
    """
    out, schema = (f"{folder}/rows" if folder else new_path(spark, name)), result.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state" if folder else new_path(spark, f"{name}-state")).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(schema.add("batch", "long")).parquet(out)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of all batches of an updated result, the last of each key."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("batch").desc()))
    return rows.withColumn("newest", newest).where("newest = 1").drop("newest", "batch")


def event_stream(spark: SparkSession, sf_dir: str, shape: Callable[[DataFrame], DataFrame], table: str = "events") -> DataFrame:
    """A table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return shape(spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]"))

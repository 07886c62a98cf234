"""From stimuli and their native data to channels of one constant shape.

Extractors that read pixels or sound turn each native row into samples (stim_id, path, t, v); what such a one needs to
have at hand is loaded once in each Python worker. One that fails on a row gives a row in ``failed`` and nothing else is
lost. They are nodes of the graph of ``graph``, beside those of ``extractors``, which read what models gave. Samples are
reduced onto the grid; what the template has and a stimulus has not is filled with nulls. Post-extractors read the
channels that the others made.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import media
from gridloom.operators import events, shape, typed
from gridloom.plans import graph, loading
from gridloom.plans.extractors import NODES
from gridloom.shared import staged

SAMPLES = "stim_id string, path string, t double, until double, v double, vec array<double>, error string"
KINDS = pa.schema([("stim_id", pa.string()), ("path", pa.string()), ("t", pa.float64()), ("until", pa.float64()), ("v", pa.float64()), ("vec", pa.list_(pa.float64())), ("error", pa.string())])


Numbers = dict[str, tuple[np.ndarray, ...]]  # by path: times, values (a row a time where they are vectors), and until when each holds, if not for a moment


@dataclass(frozen=True)
class Extractor:
    """``read`` makes the numbers of one native row; ``table`` names the native table it reads.

    With ``load``, ``read`` gets what it gave as well: weights or tables that each worker loads once, for all its tasks.
    """

    name: str
    modalities: tuple[str, ...]
    table: str
    read: Callable[..., Numbers]
    group: str = "core"
    load: Callable[[], object] | None = None


def frame(row: dict) -> np.ndarray:
    return np.frombuffer(row["rgb"], np.uint8).reshape(row["height"], row["width"], 3)


def _one(prefix: str, t: float, numbers: dict[str, float]) -> Numbers:
    return {f"{prefix}/{k}": (np.array([t], float), np.array([v], float)) for k, v in numbers.items()}


def _picture(row: dict) -> Numbers:
    return _one("visual/low_level_static", row["t"], media.picture(frame(row)))


def _saliency(row: dict) -> Numbers:
    return _one("visual/saliency_aesthetics_depth", row["t"], media.saliency(frame(row)))


def _sound(row: dict, bands: Callable[[float, int], np.ndarray]) -> Numbers:
    """Numbers and vectors of each frame of sound; the tempo holds for the whole stretch."""
    y, rate, start = np.asarray(row["samples"], float), row["rate"], row["start"]
    times, numbers = media.sound(y, rate)
    numbers |= {"mfcc": media.cepstrum(y, rate, filters=bands(rate, 128)), "chroma": media.chroma(y, rate)}
    found = {f"audio/low_level/{name}": (start + times, values) for name, values in numbers.items()}
    return found | {"audio/low_level/tempo": (np.array([start], float), np.array([media.tempo(numbers["onset_strength"], rate)]), np.array([start + len(y) / rate]))}


EXTRACTORS = (
    Extractor("VisualLowLevel", ("audiovisual", "video-only"), "frames", _picture),
    Extractor("VisualSaliency", ("audiovisual", "video-only"), "frames", _saliency, "vision"),
    Extractor("AudioLowLevel", ("audiovisual", "audio-only"), "sound", _sound, load=lambda: functools.cache(media.mel_bands)),
)


def chosen(groups: tuple[str, ...] = ("core",), extractors: tuple[Extractor, ...] = EXTRACTORS) -> list[Extractor]:
    """The core extractors and those of the groups asked for, in their order."""
    return [e for e in extractors if e.group == "core" or e.group in groups]


FLUSH = 4096  # samples, and numbers of them, that a task holds before it hands them on


class _Samples:
    """Samples as columns, handed on whenever there are enough of them."""

    def __init__(self) -> None:
        self.columns: dict[str, list] = {c: [] for c in KINDS.names}
        self.held = 0

    def add(self, stim_id: str, path: str, t: np.ndarray, v: np.ndarray, until: np.ndarray | None = None) -> None:
        n, v = len(t), np.asarray(v, float)
        flat = v.ndim == 1
        for c, values in (("stim_id", [stim_id] * n), ("path", [path] * n), ("t", t), ("until", [None] * n if until is None else until), ("v", v if flat else [None] * n), ("vec", [None] * n if flat else list(v)), ("error", [None] * n)):
            self.columns[c].extend(values.tolist() if isinstance(values, np.ndarray) else values)
        self.held += max(n, v.size)

    def fail(self, stim_id: str, said: str) -> None:
        for c in KINDS.names:
            self.columns[c].append({"stim_id": stim_id, "error": said}.get(c))
        self.held += 1

    def taken(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict(self.columns, schema=KINDS)
        self.__init__()
        return out


def extract(extractor: Extractor, stimuli: DataFrame, native: DataFrame) -> DataFrame:
    """Samples of the stimuli (stim_id, modality) that the extractor takes; an exception makes a row with its message.

    A task holds the native rows of one Arrow batch and FLUSH samples, or those of one native row. Native rows are dealt
    out evenly: they are few bytes in their files, but much to compute.
    """
    taken = stimuli.where(F.col("modality").isin(*extractor.modalities)).select("stim_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, made = (loading.state(extractor.name, extractor.load),) if extractor.load else (), _Samples()
        for batch in batches:
            for k in range(batch.num_rows):  # one native row, a picture or a stretch of sound, is a stretch of columns
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                try:
                    found = [(row["stim_id"], path, *numbers) for path, numbers in extractor.read(row, *held).items()]
                except Exception as problem:  # one stimulus's broken data must not end the others'
                    made.fail(row["stim_id"], f"{extractor.name}: {problem!r}")
                    continue
                for numbers in found:
                    made.add(*numbers)
                    if made.held >= FLUSH:
                        yield made.taken()
        if made.held:
            yield made.taken()

    tasks = int(native.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return native.join(taken, "stim_id", "left_semi").repartition(tasks).mapInArrow(run, SAMPLES)


def node(extractor: Extractor) -> graph.Node:
    """An extractor of native rows as a node: what it read is staged once, for its samples and its failures."""

    def make(stimuli: DataFrame, bins: DataFrame, tables: dict[str, DataFrame]) -> graph.Made:
        found = staged(extract(extractor, stimuli, tables[extractor.table]), extractor.name)
        good = found.where("error is null").select("stim_id", "path", F.col("t").alias("start"), F.col("until").alias("end"), "v", "vec", *(F.lit(None).cast(typed.FIELDS[c]).alias(c) for c in ("code", "label")))
        return graph.Made(good, failed=found.where("error is not null").select("stim_id", "error"))

    return graph.Node(extractor.name, (extractor.table,), make, (), extractor.modalities, extractor.group)


def annotate(stimuli: DataFrame, native: dict[str, DataFrame], template: DataFrame, groups: tuple[str, ...] = ("core",), rate: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(stim_id, path, bin, num, vec, code, label) of every channel of the template for every stimulus, and failed (stim_id, error).

    Stimuli have stim_id, modality and duration_sec; one without a bin is an error. Every extractor runs, of the core and
    of ``groups``, whose native tables are there.
    """
    short = stimuli.where(F.floor(F.col("duration_sec") * rate + 1e-9) < 1).limit(1).collect()
    if short:
        raise ValueError(f"{short[0].stim_id}: no bin in {short[0].duration_sec} s")
    nodes = [*(node(e) for e in chosen(groups)), *(n for n in NODES if n.group == "core" or n.group in groups)]
    done = graph.run(nodes, stimuli, native, template, rate)
    if "ok" not in done.status.values():
        raise ValueError(f"no extractor has a table to read: {done.status}")
    broken = [(n, s) for n, s in done.status.items() if s.startswith("failed")]
    failed = done.failed
    for name, said in broken:  # one that failed as a whole failed on each stimulus that it takes
        failed = failed.unionByName(stimuli.where(F.col("modality").isin(*next(n for n in nodes if n.name == name).modalities)).select("stim_id", F.lit(f"{name}: {said}").alias("error")))
    return done.values.select("stim_id", "path", "bin", "num", "vec", "code", "label"), failed


def shots(frames: DataFrame, bins: DataFrame, threshold: float = 0.6, gap: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Cut times (stim_id, t) and the number of the shot in each bin, of frames (stim_id, t, width, height, rgb)."""
    from pyspark.sql import Window

    from gridloom.operators import signals

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"stim_id": pdf["stim_id"], "t": pdf["t"], "h": [media.color_histogram(frame(r)).tolist() for r in pdf.to_dict("records")]})

    colors = frames.mapInPandas(read, "stim_id string, t double, h array<double>")
    before = F.lag("h").over(Window.partitionBy("stim_id").orderBy("t"))
    away = F.aggregate(F.zip_with("h", "p", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    cuts = signals.detect_cuts(colors.withColumn("p", before).where("p is not null").select("stim_id", "t", away.alias("distance")), threshold, gap)
    return cuts, signals.shot_index(cuts, bins)


def event_channels(values: DataFrame, paths: list[str]) -> DataFrame:
    """The post-extractor: states and boundaries from the scalar channels that were made."""
    wide = shape.to_wide(values.where(F.col("path").isin(*paths)), paths)
    return events.event_segments(wide, [p.replace("/", "__") for p in paths])


def run_batch(manifest: DataFrame, done: DataFrame, annotate_one: Callable[[DataFrame], DataFrame], index: DataFrame) -> DataFrame:
    """Annotate what the manifest (id, ...) has and ``done`` (id) has not, and return the index with the new rows (id, status) merged in."""
    waiting = shape.pending(manifest, done)
    skipped = manifest.join(waiting.select("id"), "id", "left_anti").select("id", F.lit("skipped").alias("status"))
    return shape.merge_index(index, annotate_one(waiting).select("id", "status").unionByName(skipped))


def batch_status(stimuli: DataFrame, values: DataFrame, failed: DataFrame) -> DataFrame:
    """(id, status, n_channels, n_measured, n_skeleton, n_failed, error) of what ``annotate`` gave: ok, partial where some extractor failed, error where no channel was measured and some failed."""
    per_path = values.groupBy("stim_id", "path").agg(F.max(F.coalesce(*(F.when(F.col(c).isNotNull(), True) for c in ("num", "vec", "code", "label") if c in values.columns), F.lit(False))).alias("measured"))
    counted = per_path.groupBy("stim_id").agg(F.count("*").alias("n_channels"), F.count_if("measured").alias("n_measured"), F.count_if(~F.col("measured")).alias("n_skeleton"))
    broken = failed.groupBy("stim_id").agg(F.count_distinct(F.split("error", ":")[0]).alias("n_failed"), F.array_join(F.array_sort(F.collect_set(F.split("error", ":")[0])), ",").alias("names"))
    rows = stimuli.select("stim_id").join(counted, "stim_id", "left").join(broken, "stim_id", "left").na.fill(0, ["n_channels", "n_measured", "n_skeleton", "n_failed"])
    status = F.when(F.col("n_failed") == 0, "ok").when(F.col("n_measured") > 0, "partial").otherwise("error")
    return rows.select(F.col("stim_id").alias("id"), status.alias("status"), "n_channels", "n_measured", "n_skeleton", "n_failed", F.when(F.col("n_failed") > 0, F.substring(F.concat(F.lit("failed: "), "names"), 1, 200)).otherwise("").alias("error"))


def refresh(manifest: DataFrame, native: dict[str, DataFrame], template: DataFrame, folder: str, groups: tuple[str, ...] = ("core",)) -> DataFrame:
    """From the manifest (id, modality, duration_sec) to annotations and their index, both kept in ``folder``: what the index has done is passed over, the rest annotated and written, and the new index, which is returned, put in its place.

    A stimulus without a bin has the status error and holds up no other.
    """
    from gridloom.sources import annotations

    spark = manifest.sparkSession
    schema = "id string, status string, n_channels long, n_measured long, n_skeleton long, n_failed long, error string"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/index")
    known = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    index = spark.read.schema(schema).parquet(f"{folder}/index") if known else spark.createDataFrame([], schema)
    waiting = shape.pending(manifest, index.where("status in ('ok', 'partial')")).withColumnRenamed("id", "stim_id")
    long = F.floor(F.col("duration_sec") + 1e-9) >= 1
    good = waiting.where(long)
    news = waiting.where(~F.coalesce(long, F.lit(False))).select(F.col("stim_id").alias("id"), F.lit("error").alias("status"), *(F.lit(0).cast("long").alias(c) for c in ("n_channels", "n_measured", "n_skeleton", "n_failed")), F.lit("no bin").alias("error"))
    values, failed = annotate(good, native, template, groups)
    whole = values.select("stim_id", "path", "bin", F.col("bin").cast("double").alias("time_sec"), "num", F.col("vec").cast("array<float>").alias("vec"), "code", "label")
    annotations.write_annotations(whole, f"{folder}/values")
    written = annotations.read_annotations(spark, f"{folder}/values").join(good.select("stim_id"), "stim_id", "left_semi")
    merged = staged(shape.merge_index(index, batch_status(good, written, failed).unionByName(news)).select(*index.columns), "index")
    merged.write.mode("overwrite").parquet(f"{folder}/index")
    return merged

"""Media that can be read without a codec: pictures given as bytes, and sound in WAV files."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import signals

FRAMES = "stim_id string, t double, width int, height int, rgb binary"
MOST_CACHED = 6000


def shrunk(rgb: np.ndarray, longest: int) -> np.ndarray:
    """A picture whose longer side is ``longest`` at the most: each pixel the mean of those that it takes the place of."""
    height, width = rgb.shape[:2]
    factor = max(height, width) / longest
    if factor <= 1:
        return rgb
    rows, cols = (max(1, round(n / factor)) for n in (height, width))
    sums = np.add.reduceat(np.add.reduceat(rgb.astype(np.float64), np.arange(rows) * height // rows, 0), np.arange(cols) * width // cols, 1)
    sizes = np.multiply.outer(np.diff(np.append(np.arange(rows) * height // rows, height)), np.diff(np.append(np.arange(cols) * width // cols, width)))
    return np.round(sums / sizes[..., None]).astype(np.uint8)


def analysis_frames(frames: DataFrame, rate: float, longest: int = 320) -> DataFrame:
    """Of frames (FRAMES) those kept at ``rate``, their longer side at most ``longest``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            small = [shrunk(np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3), longest) for r in pdf.itertuples(index=False)]
            yield pdf[["stim_id", "t"]].assign(width=[x.shape[1] for x in small], height=[x.shape[0] for x in small], rgb=[x.tobytes() for x in small])

    kept = signals.decimate(frames, rate)
    return frames.join(kept, ["stim_id", "t"], "left_semi").select("stim_id", "t", "width", "height", "rgb").mapInPandas(run, FRAMES)


def cached_frames(frames: DataFrame, most: int = MOST_CACHED) -> DataFrame:
    """Frames kept in memory, and on disk beyond it, if there are no more than ``most``; else they are read again by whoever asks."""
    return frames.persist(StorageLevel.MEMORY_AND_DISK) if frames.limit(most + 1).count() <= most else frames


def frame_stream(spark: SparkSession, folder: str, at_once: int = 1) -> DataFrame:
    """Frames as a stream of the Parquet files of a folder, ``at_once`` of them a batch, so that no more are held."""
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", at_once).parquet(folder)


def one_channel(content: bytes, rate: int) -> np.ndarray:
    """The samples of a WAV file of 8, 16 or 32 bits, from -1 to 1: the mean of its channels, at ``rate`` by straight lines between samples."""
    with wave.open(io.BytesIO(content)) as f:
        width, channels, own, n = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.getnframes()
        data = f.readframes(n)
    y = np.frombuffer(data, np.uint8).astype(float) - 128 if width == 1 else np.frombuffer(data, f"<i{width}").astype(float)
    y = y.reshape(-1, channels).mean(1) / 2.0 ** (8 * width - 1)
    if own == rate or not len(y):
        return y
    return np.interp(np.arange(int(len(y) * rate / own)) * own / rate, np.arange(len(y)), y)


def read_sound(spark: SparkSession, path: str, rate: int = 22050, seconds: float = 30.0) -> DataFrame:
    """(stim_id, start, rate, samples, error): WAV files in stretches of ``seconds``; a file that cannot be read has one row with the reason."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_extract("path", r"([^/]*)\.wav$", 1).alias("stim_id"), "content")
    step = int(seconds * rate)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for stim_id, content in pdf.itertuples(index=False):
                try:
                    y = one_channel(content, rate)
                except (wave.Error, EOFError, ValueError, TypeError) as problem:
                    yield pd.DataFrame([(stim_id, None, rate, None, repr(problem))], columns=["stim_id", "start", "rate", "samples", "error"])
                    continue
                for at in range(0, len(y), step):
                    yield pd.DataFrame([(stim_id, at / rate, rate, y[at : at + step], None)], columns=["stim_id", "start", "rate", "samples", "error"])

    return named.mapInPandas(run, "stim_id string, start double, rate int, samples array<double>, error string")

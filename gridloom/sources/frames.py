"""Decoded frames of an open format, YUV4MPEG2, as they stream from a file, and a cache of them bounded by bytes.

A frame is read when the one before it has been given, thinned to the analysis rate and shrunk before it leaves its task,
so a task holds one frame of a file however long the file is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.shared import staged
from gridloom.sources.media import shrunk

DECODED = "stim_id string, t double, width int, height int, rgb binary, problem string"
ROW = pa.schema([("stim_id", pa.string()), ("t", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary()), ("problem", pa.string())])
LINE = 256  # bytes of a header line at the most
#: How many times fewer columns and rows the colour planes of a pixel layout have.
LAYOUTS = {"420": (2, 2), "420jpeg": (2, 2), "420mpeg2": (2, 2), "420paldv": (2, 2), "422": (2, 1), "444": (1, 1)}


def _line(f: BinaryIO) -> bytes:
    out = bytearray()
    while (c := f.read(1)) and c != b"\n":
        out += c
        if len(out) > LINE:
            raise ValueError("a header line without an end")
    return bytes(out) if c or out else b""


def header(f: BinaryIO) -> tuple[int, int, float, tuple[int, int] | None]:
    """Width, height, frames a second, and the layout of the colour planes, None for gray."""
    words = _line(f).decode("latin-1").split(" ")
    if words[0] != "YUV4MPEG2":
        raise ValueError("no YUV4MPEG2")
    held = {w[0]: w[1:] for w in words[1:] if w}
    a, b = (held.get("F") or "25:1").split(":")
    layout = held.get("C", "420")
    if layout != "mono" and layout not in LAYOUTS:
        raise ValueError(f"layout {layout} is not read")
    width, height, rate = int(held["W"]), int(held["H"]), int(a) / int(b)
    if min(width, height) < 1 or rate <= 0:
        raise ValueError("a picture without size or rate")
    return width, height, rate, LAYOUTS.get(layout)


def to_rgb(y: np.ndarray, u: np.ndarray | None, v: np.ndarray | None) -> np.ndarray:
    """Pixels of BT.601 in its studio range."""
    light = 1.164383 * (y.astype(float) - 16)
    if u is None or v is None:
        return np.clip(np.round(np.stack([light] * 3, 2)), 0, 255).astype(np.uint8)
    u, v = u.astype(float) - 128, v.astype(float) - 128
    return np.clip(np.round(np.stack([light + 1.596027 * v, light - 0.391762 * u - 0.812968 * v, light + 2.017232 * u], 2)), 0, 255).astype(np.uint8)


def frames(f: BinaryIO, rate: float) -> Iterator[tuple[float, np.ndarray]]:
    """Times and pictures kept at ``rate``, each 1 / rate or more after the one kept before it; others are passed over undecoded."""
    width, height, own, parts = header(f)
    across, down = parts or (1, 1)
    small = (-(-height // down), -(-width // across))
    size = width * height + (2 * small[0] * small[1] if parts else 0)
    k, due = 0, 0.0
    while mark := _line(f):
        if not mark.startswith(b"FRAME"):
            raise ValueError("a frame without its mark")
        data = f.read(size)
        if len(data) < size:
            raise ValueError(f"frame {k} is cut short")
        if k / own + 1e-6 >= due:
            due = k / own + 1 / rate
            raw = np.frombuffer(data, np.uint8)
            y, colour = raw[: width * height].reshape(height, width), [None, None]
            if parts:
                planes = raw[width * height :].reshape(2, *small)
                colour = [np.repeat(np.repeat(p, down, 0), across, 1)[:height, :width] for p in planes]
            yield k / own, to_rgb(y, *colour)
        k += 1


def decode(files: DataFrame, rate: float, longest: int = 320) -> DataFrame:
    """Frames of files (stim_id, path: of a store that Arrow opens), their longer side at most ``longest``; of a file that breaks off, the frames before and a row that says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for stim, path in zip(batch.column("stim_id").to_pylist(), batch.column("path").to_pylist(), strict=True):
                try:
                    store, name = fs.FileSystem.from_uri(path)
                    with store.open_input_stream(name, buffer_size=1 << 20) as f:
                        for t, rgb in frames(f, rate):
                            rgb = shrunk(rgb, longest)
                            yield pa.RecordBatch.from_arrays([pa.array([x], kind.type) for x, kind in zip((stim, t, rgb.shape[1], rgb.shape[0], rgb.tobytes(), None), ROW, strict=True)], schema=ROW)
                except (ValueError, KeyError, OSError) as problem:
                    yield pa.RecordBatch.from_arrays([pa.array([x], kind.type) for x, kind in zip((stim, None, None, None, None, str(problem)[:200]), ROW, strict=True)], schema=ROW)

    return files.select(F.col("stim_id").cast("string").alias("stim_id"), "path").mapInArrow(run, DECODED)


def expected_bytes(files: DataFrame, rate: float, longest: int = 320) -> DataFrame:
    """(stim_id, bytes): what ``decode`` will give of each file (stim_id, path), from its header and length; 0 for one that cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            sizes = []
            for path in batch.column("path").to_pylist():
                try:
                    store, name = fs.FileSystem.from_uri(path)
                    with store.open_input_file(name) as f:
                        width, height, own, parts = header(f)
                        across, down = parts or (1, 1)
                        each = width * height + (2 * -(-height // down) * -(-width // across) if parts else 0) + 6
                        factor = max(1.0, max(width, height) / longest)
                        picture = 3 * max(1, round(width / factor)) * max(1, round(height / factor)) if factor > 1 else 3 * width * height
                        sizes.append(int(np.ceil((f.size() - f.tell()) / each / own * min(rate, own))) * picture)
                except (ValueError, KeyError, OSError):
                    sizes.append(0)
            yield pa.RecordBatch.from_arrays([batch.column("stim_id"), pa.array(sizes, pa.int64())], names=["stim_id", "bytes"])

    return files.select(F.col("stim_id").cast("string").alias("stim_id"), "path").mapInArrow(run, "stim_id string, bytes long")


def cached(files: DataFrame, rate: float, longest: int = 320, budget: int = 1 << 36) -> tuple[DataFrame, DataFrame]:
    """Frames to be read more than once, and which files (stim_id, kept) are in the cache.

    Files are kept in the order of what they need, the small first, while all together fit the budget; their frames are
    written once, to the shared folder. Those of the others are decoded again by whoever asks: the same rows.
    """
    sizes = staged(expected_bytes(files, rate, longest), "frame-sizes")
    bits = F.floor(F.log2(F.greatest(F.col("bytes"), F.lit(1)))).cast("int")
    room, whole, edge = budget, 0, None
    for r in sizes.groupBy(bits.alias("bits")).agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("most"), F.count("*").alias("n")).orderBy("bits").collect():  # 63 rows at the most
        if r.bytes <= room:
            room, whole = room - r.bytes, r.bits + 1
            continue
        edge = (r.bits, int(room // r.most))  # of the files of like size, so many surely fit
        break
    kept = sizes.where(bits < whole).select("stim_id", F.lit(True).alias("kept"))
    if edge is not None:
        some, n = edge
        kept = kept.unionByName(sizes.where(bits == some).orderBy("bytes", "stim_id").limit(n).select("stim_id", F.lit(True).alias("kept")))
    named = files.withColumn("stim_id", F.col("stim_id").cast("string"))
    known = staged(named.select("stim_id").distinct().join(kept.distinct(), "stim_id", "left").select("stim_id", F.coalesce("kept", F.lit(False)).alias("kept")), "frames-kept")
    held = staged(decode(named.join(known.where("kept"), "stim_id", "left_semi"), rate, longest), "frames")
    again = decode(named.join(known.where("not kept"), "stim_id", "left_semi"), rate, longest)
    return held.unionByName(again), known

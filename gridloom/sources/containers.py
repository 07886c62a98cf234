"""What media files say of themselves: durations, rates and sizes from the headers of WAV, AVI and MP4, without decoding.

Boxes and chunks are walked by their lengths, and only headers are read, wherever they stand in a file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame

PROBED = "path string, duration_sec double, has_video boolean, has_audio boolean, fps double, width int, height int, problem string"
HEADER = 1 << 16  # bytes of one header that are read; tables of samples go on behind, and only their counts are wanted


def boxes(f: BinaryIO, begin: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Kind, begin and end of the content of each MP4 box between two places."""
    while begin + 8 <= end:
        f.seek(begin)
        head = f.read(16)
        size, kind, skip = struct.unpack(">I", head[:4])[0], head[4:8].decode("latin-1"), 8
        if size == 1:
            size, skip = struct.unpack(">Q", head[8:16])[0], 16
        size = size or end - begin  # 0: to the end
        if size < skip or begin + size > end:
            raise ValueError(f"box {kind!r} of {size} bytes at {begin} does not fit")
        yield kind, begin + skip, begin + size
        begin += size


def chunks(f: BinaryIO, begin: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Kind, begin and end of the content of each RIFF chunk; a list's kind is that of the list. The last may be cut short."""
    while begin + 8 <= end:
        f.seek(begin)
        head = f.read(12)
        kind, size = head[:4].decode("latin-1"), struct.unpack("<I", head[4:8])[0]
        if kind in ("RIFF", "LIST"):
            yield head[8:12].decode("latin-1"), begin + 12, min(begin + 8 + size, end)
        else:
            yield kind, begin + 8, min(begin + 8 + size, end)
        begin += 8 + size + size % 2


def _read(f: BinaryIO, begin: int, end: int) -> bytes:
    f.seek(begin)
    return f.read(min(end - begin, HEADER))


def _times(data: bytes) -> float:
    """Seconds of an mvhd or mdhd box."""
    rate, length = struct.unpack(">IQ", data[20:32]) if data[0] == 1 else struct.unpack(">II", data[12:20])
    return length / rate


def _mp4(f: BinaryIO, end: int) -> dict:
    out = {"duration": 0.0, "streams": []}
    found = False
    for kind, a, b in boxes(f, 0, end):
        if kind != "moov":
            continue
        found = True
        for kind, a1, b1 in boxes(f, a, b):
            if kind == "mvhd":
                out["duration"] = _times(_read(f, a1, b1))
            if kind != "trak":
                continue
            s = {"kind": "", "duration": 0.0, "fps": 0.0, "width": 0, "height": 0}
            for kind, a2, b2 in boxes(f, a1, b1):
                if kind == "tkhd":
                    s["width"], s["height"] = (x >> 16 for x in struct.unpack(">II", _read(f, b2 - 8, b2)))
                for kind, a3, b3 in boxes(f, a2, b2) if kind == "mdia" else ():
                    if kind == "mdhd":
                        s["duration"] = _times(_read(f, a3, b3))
                    if kind == "hdlr":
                        s["kind"] = {b"vide": "video", b"soun": "audio"}.get(_read(f, a3, b3)[8:12], "")
                    for kind, a4, b4 in boxes(f, a3, b3) if kind == "minf" else ():
                        for kind, a5, b5 in boxes(f, a4, b4) if kind == "stbl" else ():
                            if kind == "stts":
                                data = _read(f, a5, b5)
                                runs = min(struct.unpack(">I", data[4:8])[0], (len(data) - 8) // 8)
                                s["samples"] = sum(struct.unpack(f">{2 * runs}I", data[8 : 8 + 8 * runs])[::2])
            if s["duration"]:
                s["fps"] = s.get("samples", 0) / s["duration"]
            out["streams"].append(s)
    if not found:
        raise ValueError("no moov box")
    return out


def _avi(f: BinaryIO, end: int) -> dict:
    out = {"duration": 0.0, "streams": []}
    for kind, a, b in chunks(f, 12, end):
        if kind != "hdrl":
            continue
        for kind, a1, b1 in chunks(f, a, b):
            if kind == "avih":
                step, *_, frames = struct.unpack("<5I", _read(f, a1, b1)[:20])
                out["duration"] = step * frames / 1e6
                width, height = struct.unpack("<2I", _read(f, a1, b1)[32:40])
            if kind != "strl":
                continue
            for kind, a2, b2 in chunks(f, a1, b1):
                if kind == "strh":
                    data = _read(f, a2, b2)
                    scale, rate, _, length = struct.unpack("<4I", data[20:36])
                    name = {b"vids": "video", b"auds": "audio"}.get(data[:4], "")
                    s = {"kind": name, "duration": length * scale / rate, "fps": rate / scale if name == "video" else 0.0, "width": 0, "height": 0}
                    out["streams"].append(s | ({"width": width, "height": height} if name == "video" else {}))
    return out


def _wav(f: BinaryIO, end: int) -> dict:
    rate, seconds = 0, 0.0
    for kind, a, b in chunks(f, 12, end):
        if kind == "fmt ":
            rate = struct.unpack("<I", _read(f, a, b)[8:12])[0]
        if kind == "data":
            seconds = (b - a) / rate
    return {"duration": seconds, "streams": [{"kind": "audio", "duration": seconds, "fps": 0.0, "width": 0, "height": 0}]}


def read_headers(f: BinaryIO, size: int) -> dict:
    """duration and streams (kind, duration, fps, width, height) of a media file of ``size`` bytes; ValueError where it is none, or broken."""
    f.seek(0)
    head = f.read(12)
    try:
        if head[:4] == b"RIFF" and head[8:] == b"AVI ":
            return _avi(f, size)
        if head[:4] == b"RIFF" and head[8:] == b"WAVE":
            return _wav(f, size)
        if head[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"wide", b"skip"):
            return _mp4(f, size)
    except (struct.error, ZeroDivisionError, IndexError, UnboundLocalError) as problem:
        raise ValueError(f"broken header: {problem}") from problem
    raise ValueError("no WAV, AVI or MP4")


def summary(found: dict) -> tuple:
    """duration, has_video, has_audio, fps, width, height: the container's duration, else the video's, else the sound's."""
    of = lambda kind: next((s for s in found["streams"] if s["kind"] == kind), None)
    video, audio = of("video"), of("audio")
    duration = found["duration"] or (video or {}).get("duration") or (audio or {}).get("duration") or 0.0
    return duration, video is not None, audio is not None, *((video["fps"], video["width"], video["height"]) if video else (0.0, 0, 0))


def _probed(path: str, f: BinaryIO, size: int) -> tuple:
    try:
        return (path, *summary(read_headers(f, size)), None)
    except ValueError as problem:
        return (path, *[None] * 6, str(problem)[:200])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.float64(), pa.bool_(), pa.bool_(), pa.float64(), pa.int32(), pa.int32(), pa.string())
    names = [c.split()[0] for c in PROBED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def probe_files(files: DataFrame) -> DataFrame:
    """What the media files (path: of a store that Arrow opens, such as file:// or hdfs://) say of themselves; of one that cannot be read, nulls and what is wrong.

    A task opens its files one by one and reads their headers only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                try:
                    store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":/", ":///", 1))
                    with store.open_input_file(name) as f:
                        rows.append(_probed(path, f, f.size()))
                except OSError as problem:
                    rows.append((path, *[None] * 6, str(problem)[:200]))
            yield _batch(rows)

    return files.select("path").mapInArrow(run, PROBED)


def probe_contents(files: DataFrame) -> DataFrame:
    """``probe_files`` of files (path, content) that are at hand, as Spark's own reader of binary files gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = zip(batch.column("path").to_pylist(), batch.column("content"), strict=True)
            yield _batch([_probed(p, pa.BufferReader(c.as_buffer() or b""), len(c.as_buffer() or b"")) for p, c in held])

    return files.select("path", "content").mapInArrow(run, PROBED)

"""Files as they come: headers of containers, annotation files by a data source, patches that are cut short."""

import io
import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from gridloom import schemas
from gridloom.sources import annotation_source, containers, versions


def box(kind, content):
    return struct.pack(">I", 8 + len(content)) + kind + content


def chunk(kind, content):
    return kind + struct.pack("<I", len(content)) + content + b"\0" * (len(content) % 2)


def track(kind, rate, length, samples=0, width=0, height=0, long=False):
    times = struct.pack(">B3xQQIQ", 1, 0, 0, rate, length) if long else struct.pack(">B3xIIII", 0, 0, 0, rate, length)
    stts = struct.pack(">4xI", 2) + struct.pack(">IIII", samples - 1, 1, 1, 1) if samples else struct.pack(">4xI", 0)
    mdia = box(b"mdhd", times + bytes(4)) + box(b"hdlr", bytes(8) + kind + bytes(12)) + box(b"minf", box(b"stbl", box(b"stts", stts)))
    return box(b"trak", box(b"tkhd", bytes(76) + struct.pack(">II", width << 16, height << 16)) + box(b"mdia", mdia))


def mp4(*tracks, rate=1000, length=4000, media=b"x" * 100, first=True):
    moov = box(b"moov", box(b"mvhd", struct.pack(">B3xIIII", 0, 0, 0, rate, length) + bytes(80)) + b"".join(tracks))
    mdat = box(b"mdat", media)
    return box(b"ftyp", b"isom" + bytes(4)) + (moov + mdat if first else mdat + moov)


def wav(rate=8000, seconds=2.5, cut=0):
    data = bytes(int(rate * 2 * seconds))
    body = chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, rate, rate * 2, 2, 16)) + chunk(b"LIST", b"INFO") + chunk(b"data", data)
    return (b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)[: -cut or None]


def avi(step=40000, frames=50, width=640, height=360):
    avih = struct.pack("<10I", step, 0, 0, 0, frames, 0, 2, 0, width, height) + bytes(16)
    strh = lambda kind, scale, rate, length: chunk(b"strh", kind + bytes(16) + struct.pack("<4I", scale, rate, 0, length) + bytes(20))
    strl = lambda s: chunk(b"LIST", b"strl" + s)
    body = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl(strh(b"vids", 1, 25, 50)) + strl(strh(b"auds", 1, 8000, 16000))) + chunk(b"LIST", b"movi" + bytes(500))
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"AVI " + body


FILES = {
    "a.mp4": (mp4(track(b"vide", 12800, 51200, 100, 1280, 720), track(b"soun", 48000, 190000)), (4.0, True, True, 25.0, 1280, 720)),
    "late.mp4": (mp4(track(b"soun", 48000, 144000, long=True), length=0, first=False), (3.0, False, True, 0.0, 0, 0)),
    "long.mp4": (mp4(track(b"vide", 600, 6000, 300, 320, 240), length=10000, media=b"y" * 3_000_000, first=False), (10.0, True, False, 30.0, 320, 240)),
    "b.avi": (avi(), (2.0, True, True, 25.0, 640, 360)),
    "c.wav": (wav(), (2.5, False, True, 0.0, 0, 0)),
    "short.wav": (wav(cut=8000), (2.0, False, True, 0.0, 0, 0)),
    "empty.mp4": (b"", None),
    "text.wav": (b"not a sound at all", None),
    "torn.mp4": (mp4(track(b"vide", 600, 6000, 300, 320, 240))[:200], None),
    "no_moov.mp4": (box(b"ftyp", b"isom") + box(b"mdat", bytes(40)), None),
    "zero.mp4": (mp4(rate=0), None),
    "torn.avi": (avi()[:60], None),
}


@pytest.mark.parametrize("name", FILES)
def test_headers(name):
    data, want = FILES[name]
    if want is None:
        with pytest.raises(ValueError):
            containers.summary(containers.read_headers(io.BytesIO(data), len(data)))
    else:
        assert containers.summary(containers.read_headers(io.BytesIO(data), len(data))) == want


def test_only_headers_are_read():
    class Counted(io.BytesIO):
        n = 0

        def read(self, size=-1):
            got = super().read(size)
            Counted.n += len(got)
            return got

    data = FILES["long.mp4"][0]
    containers.read_headers(Counted(data), len(data))
    assert Counted.n < 5000


def test_files_of_a_folder(spark, tmp_path):
    for name, (data, _) in FILES.items():
        (tmp_path / name).write_bytes(data)
    listed = spark.createDataFrame([(f"file://{tmp_path}/{name}",) for name in [*FILES, "missing.wav"]], "path string")
    got = {r.path.rsplit("/", 1)[1]: r for r in containers.probe_files(listed.repartition(3)).collect()}
    assert got["missing.wav"].problem
    for name, (_, want) in FILES.items():
        assert tuple(got[name])[1:7] == (want or (None,) * 6) and (got[name].problem is None) == (want is not None)


PROFILE = {
    "stimulus": {"id": "m"},
    "features": {
        "visual": {"low": {"luminance": {"dtype": "scalar", "applicable": True, "value": [0.5, None, 0.0]}, "faces": {"dtype": "bool", "value": [1, -1, 0]}}},
        "audio": {"low": {"mfcc": {"dtype": "vector", "value": [[1.0, None], None, [2.0, 3.0]]}, "top": {"dtype": "categorical", "value": [2, -1, 0]}, "gone": {"dtype": "scalar", "applicable": False, "value": [0, 0, 0]}}, "speech": {"text": {"dtype": "label", "value": ["a", "", None]}, "cut": {"dtype": "event", "value": [0, 2, 0], "onsets": [1.0, 1.4]}}},
    },
}


def profiles(folder):
    os.makedirs(f"{folder}/deep")
    with open(f"{folder}/m.json", "w") as f:
        json.dump(PROFILE, f, indent=1)
    with open(f"{folder}/deep/two.json", "w") as f:
        f.write("\n".join(json.dumps(PROFILE | {"stimulus": {"id": i}}) for i in "xy"))
    for name, text in (("torn", json.dumps(PROFILE)[:-40]), ("list", "[1]"), ("none", "")):
        with open(f"{folder}/{name}.json", "w") as f:
            f.write(text)


def test_annotation_files(spark, tmp_path):
    profiles(tmp_path / "in")
    rows = annotation_source.read_files(spark, str(tmp_path / "in"))
    assert rows.rdd.getNumPartitions() == 5
    assert {r.file.rsplit("/", 1)[1] for r in annotation_source.corrupt_files(rows).collect()} == {"torn.json", "list.json"}
    good = rows.where("problem is null")
    assert {r.stim_id: r["count"] for r in good.groupBy("stim_id").count().collect()} == {"m": 21, "x": 21, "y": 21}
    got = {(r.path.rsplit("/", 1)[1], r.bin): r for r in good.where("stim_id = 'm'").collect()}
    assert [got["luminance", b].num for b in range(3)] == [0.5, None, 0.0] and [got["faces", b].num for b in range(3)] == [1, None, 0]
    assert [got["mfcc", b].vec for b in range(3)] == [[1.0, None], None, [2.0, 3.0]] and [got["top", b].code for b in range(3)] == [2, None, 0]
    assert [got["text", b].label for b in range(3)] == ["a", "", None] and got["cut", 1].onsets == [1.0, 1.4] and got["faces", 0].onsets is None
    assert got["gone", 0].num is None and not got["gone", 0].applicable and got["luminance", 1].applicable


def test_paths_are_pushed_down(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    profiles(tmp_path / "in")
    reader = annotation_source.AnnotationReader({"path": str(tmp_path / "in")})
    other = GreaterThan(("num",), 1.0)
    assert list(reader.pushFilters([In(("path",), ("audio/low/mfcc", "audio/speech/cut")), StringStartsWith(("path",), "audio/low"), other])) == [other]
    part = next(p for p in reader.partitions() if p.file.endswith("/m.json"))
    assert {p for b in reader.read(part) for p in b.column("path").to_pylist()} == {"audio/low/mfcc"}
    reader = annotation_source.AnnotationReader({"path": str(tmp_path / "in")})
    assert list(reader.pushFilters([EqualTo(("path",), "visual/low/faces")])) == []
    assert reader.wanted("visual/low/faces") and not reader.wanted("visual/low/luminance")


def lines(f, wanted):
    """A decoder of its own: a channel a line."""
    for line in f.read().decode().splitlines():
        stim, path, *values = line.split()
        if wanted(path):
            yield stim, path, "scalar", True, [float(v) for v in values], None


def test_another_decoder(spark, tmp_path):
    (tmp_path / "m.txt").write_text("m a/b/c 1 2\nm a/b/d 3\n")
    (tmp_path / "n.txt").write_text("n a/b/c x\n")
    rows = annotation_source.read_files(spark, str(tmp_path), suffix=".txt", decoder="tests.test_files:lines" if os.path.exists("tests") else "test_files:lines")
    assert sorted((r.path, r.bin, r.num) for r in rows.where("problem is null").where(F.col("path") == "a/b/c").collect()) == [("a/b/c", 0, 1.0), ("a/b/c", 1, 2.0)]


def values(spark, *rows):
    return spark.createDataFrame([(s, p, b, float(b), v, None, None, None) for s, p, b, v in rows], schemas.CHANNEL_VALUES)


def held(spark, folder):
    return sorted((r.stim_id, r.path, r.bin, r.num) for r in versions.read_current(spark, folder).collect())


def test_patches_replace_channels(spark, tmp_path):
    folder = str(tmp_path / "v")
    assert held(spark, folder) == [] and versions.clean(spark, folder) == []
    versions.patch(spark, folder, values(spark, ("a", "x", 0, 1.0), ("a", "y", 0, 2.0), ("b", "x", 0, 3.0)))
    versions.patch(spark, folder, values(spark, ("a", "x", 0, 9.0), ("a", "x", 1, 8.0)))
    assert held(spark, folder) == [("a", "x", 0, 9.0), ("a", "x", 1, 8.0), ("a", "y", 0, 2.0), ("b", "x", 0, 3.0)]
    assert not [f for f in os.listdir(f"{folder}/data/{max(os.listdir(folder + '/data'))}") if f == "stim_id=b"]  # b was not written again
    versions.patch(spark, folder, values(spark, ("b", "x", 0, 4.0)))
    assert len(versions.clean(spark, folder)) == 1 and held(spark, folder)[-1] == ("b", "x", 0, 4.0) and len(held(spark, folder)) == 4


@pytest.mark.parametrize("where", ["data", "index"])
def test_a_patch_cut_short_changes_nothing(spark, tmp_path, where):
    folder = str(tmp_path / "v")
    versions.patch(spark, folder, values(spark, ("a", "x", 0, 1.0), ("b", "x", 0, 3.0)))
    before, new = held(spark, folder), values(spark, ("a", "x", 0, 7.0))

    def die(done):
        if done == where:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        versions.patch(spark, folder, new, die)
    assert held(spark, folder) == before
    versions.patch(spark, folder, new)  # it is run again
    assert held(spark, folder) == [("a", "x", 0, 7.0), ("b", "x", 0, 3.0)]
    gone = versions.clean(spark, folder)
    assert len(gone) == 1 and held(spark, folder) == [("a", "x", 0, 7.0), ("b", "x", 0, 3.0)]


def test_a_long_file_of_profiles_is_not_held_whole(tmp_path):
    """Thirty thousand profiles, a line each: what a task holds does not grow with them; a line that is torn still takes its file with it."""
    import tracemalloc

    line = json.dumps({"stimulus": {"id": "s"}, "features": {"a": {"b": {"c": {"dtype": "scalar", "applicable": True, "value": [1.0, None, 2.0]}}}}}) + "\n"
    (tmp_path / "long.json").write_text(line * 30_000)
    (tmp_path / "torn.json").write_text(line * 600 + line[:40] + "\n")
    reader = annotation_source.AnnotationReader({"path": str(tmp_path)})
    long, torn = reader.partitions()
    tracemalloc.start()
    n = sum(b.num_rows for b in reader.read(long))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 90_000 and most < 4_000_000
    rows = [r for b in reader.read(torn) for r in b.to_pylist()]
    assert len(rows) == 1 and "JSONDecodeError" in rows[0]["problem"]

"""Decoded frames and their cache; HDF5 by a stand-in; what had no test of its own."""

import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import factors, search
from gridloom.sources import annotation_source, annotations, frames


def y4m(pictures, width, height, rate="10:1", layout="444"):
    across, down = frames.LAYOUTS.get(layout, (1, 1))
    small = (-(-height // down)) * (-(-width // across))
    out = f"YUV4MPEG2 W{width} H{height} F{rate} Ip C{layout}\n".encode()
    for y, u, v in pictures:
        out += b"FRAME\n" + bytes([y]) * (width * height) + (b"" if layout == "mono" else bytes([u]) * small + bytes([v]) * small)
    return out


PICTURES = [(16, 128, 128), (235, 128, 128), (81, 90, 240)] * 7  # black, white, red


def files(spark, folder, **data):
    for name, content in data.items():
        (folder / f"{name}.y4m").write_bytes(content)
    return spark.createDataFrame([(n, f"file://{folder}/{n}.y4m") for n in data], "stim_id string, path string")


@pytest.mark.parametrize("layout", ["444", "422", "420jpeg", "mono"])
def test_pictures(spark, tmp_path, layout):
    got = frames.decode(files(spark, tmp_path, m=y4m(PICTURES, 9, 5, layout=layout)), 10.0).orderBy("t").collect()
    assert len(got) == 21 and [r.t for r in got[:3]] == [0, 0.1, 0.2] and {(r.width, r.height) for r in got} == {(9, 5)}
    pixel = [tuple(np.frombuffer(r.rgb, np.uint8).reshape(5, 9, 3)[4, 8]) for r in got[:3]]
    assert pixel[0] == (0, 0, 0) and pixel[1] == (255, 255, 255)
    want = (76, 76, 76) if layout == "mono" else (255, 0, 0)
    assert all(abs(int(a) - b) <= 1 for a, b in zip(pixel[2], want, strict=True))


def test_thinned_shrunk_and_broken(spark, tmp_path):
    whole = y4m(PICTURES, 64, 32)
    data = {"m": whole, "torn": whole[:-100], "text": b"hello", "layout": y4m(PICTURES, 4, 4).replace(b"C444", b"C440"), "none": y4m([], 4, 4)}
    got = frames.decode(files(spark, tmp_path, **data), 2.0, 16).collect()
    of = lambda name: [r for r in got if r.stim_id == name and r.problem is None]
    assert [r.t for r in of("m")] == [0, 0.5, 1, 1.5, 2] and {(r.width, r.height) for r in of("m")} == {(16, 8)}
    assert len(of("torn")) == 4 and not of("text") and not of("none")
    assert {r.stim_id: r.problem for r in got if r.problem} == {"torn": "frame 20 is cut short", "text": "no YUV4MPEG2", "layout": "layout 440 is not read"}


def test_cache_of_a_budget(spark, tmp_path):
    """What fits is read from the cache, even when its files are gone; the rest is decoded again: the same rows."""
    listed = files(spark, tmp_path, a=y4m(PICTURES, 8, 8), b=y4m(PICTURES, 8, 8), c=y4m(PICTURES, 64, 64), text=b"hello")
    assert {r.stim_id: r.bytes for r in frames.expected_bytes(listed, 5.0).collect()} == {"a": 11 * 192, "b": 11 * 192, "c": 11 * 12288, "text": 0}
    plain = sorted(map(repr, frames.decode(listed, 5.0).collect()))
    for budget, kept in ((0, {"text"}), (11 * 192, {"text", "a"}), (11 * 400, {"text", "a", "b"}), (1 << 20, {"text", "a", "b", "c"})):
        found, known = frames.cached(listed, 5.0, budget=budget)
        assert {r.stim_id for r in known.where("kept").collect()} == kept
        assert sorted(map(repr, found.collect())) == plain
    (tmp_path / "c.y4m").write_bytes(y4m(PICTURES[:1], 4, 4))
    assert sorted(map(repr, found.collect())) == plain
    found, _ = frames.cached(listed, 5.0, budget=0)
    assert found.where("stim_id = 'c'").count() == 1


class Dataset:
    def __init__(self, values, **attrs):
        self.values, self.attrs = np.array(values), attrs

    def __getitem__(self, _):
        return self.values


class Group(dict):
    def visititems(self, visit):
        for name, item in self.items():
            visit(name, item)


def test_hdf5_of_a_stand_in(monkeypatch):
    held = Group({"a/b/v": Dataset([[1.0, 2.0], [3.0, float("nan")]], dtype=b"vector"), "a/b/flag": Dataset([1, -1], dtype="bool"), "a/b/cut": Dataset([0, 1], dtype="event"), "a/b/cut__onsets": Dataset([1.25]), "a/b/text": Dataset([b"x", b""], dtype="label"), "a/b/off": Dataset([0.0, 0.0], dtype="scalar", applicable=False)})

    class File(dict):
        attrs = {"stimulus_id": "m"}

        def __init__(self, f, mode):
            super().__init__(features=held)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=File, Dataset=Dataset))
    rows = [r for c in annotation_source.hdf5(None, lambda p: p != "a/b/text") for r in annotation_source._rows(c, "m.h5").to_pylist()]
    got = {(r["path"][4:], r["bin"]): r for r in rows}
    assert len(got) == 8 and got["v", 1]["vec"] == [3.0, None] and got["flag", 1]["num"] is None and got["flag", 0]["num"] == 1
    assert got["cut", 0]["onsets"] == [1.25] and got["off", 0]["num"] is None and not got["off", 0]["applicable"] and got["v", 0]["stim_id"] == "m"


def test_hdf5_without_its_library(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(sys.modules, "h5py", None)
    with pytest.raises((ImportError, ValueError)):
        annotations.read_hdf5(spark, str(tmp_path))


def test_nearest_positive_and_order_of_factors():
    bad = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    fixed = factors.nearest_positive(bad)
    assert np.linalg.eigvalsh(bad)[0] < 0 < np.linalg.eigvalsh(fixed)[0] and np.diag(fixed) == pytest.approx(np.ones(3)) and fixed == pytest.approx(fixed.T)
    good = np.array([[1, 0.5], [0.5, 1]])
    assert factors.nearest_positive(good) == pytest.approx(good)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 2)) @ np.array([[0.9, 0.8, 0.9, 0.7, 0, 0, 0], [0, 0, 0, 0, 0.8, 0.9, 0.7]]) + 0.5 * rng.normal(size=(4000, 7))
    load = factors.factor_analysis(np.corrcoef(x.T), 2)
    power = (load**2).sum(0)
    assert power[0] > power[1] and (np.abs(load[:4, 0]) > 0.6).all() and (np.abs(load[4:, 1]) > 0.6).all()
    assert load == pytest.approx(factors.factor_analysis(np.corrcoef(x.T), 2, 20000), abs=1e-6)  # it had ended


def test_short_names_and_filtered_search(spark):
    got = spark.createDataFrame([("a/b/c",), ("b/c",), ("c",)], "p string").select(scalars.short_name(F.col("p")).alias("s")).collect()
    assert [r.s for r in got] == ["b/c", "b/c", "c"]
    segments = spark.createDataFrame([(s, k, "p", float(k), src) for s, src in (("a", "x"), ("b", "y")) for k in range(4)], "stim_id string, seg int, path string, v double, source string")
    stats = search.channel_stats(segments)
    found = search.search(segments, stats, {"p": 1}, 3, F.col("source") == "y").collect()
    assert [(r.stim_id, r.seg) for r in found] == [("b", 3), ("b", 2), ("b", 1)]

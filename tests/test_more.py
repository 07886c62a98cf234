"""Media, templates, human tables, scores, streams with late rows and restarts, the refresh chain, and orders of leaves."""

import itertools
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import factors, shape
from gridloom.plans import annotate
from gridloom.sources import annotations, media
from gridloom.sources import stimuli as sources
from gridloom.streaming import live


def write_wav(path, y, rate, width=2, channels=1):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        data = np.repeat(y, channels)
        f.writeframes((data * 127 + 128).astype(np.uint8).tobytes() if width == 1 else (data * (2 ** (8 * width - 1) - 1)).astype(f"<i{width}").tobytes())


def test_sound_files(spark, tmp_path):
    y = 0.5 * np.sin(2 * np.pi * 440 * np.arange(44100) / 44100)
    for name, width, channels in (("a", 2, 1), ("b", 2, 2), ("c", 1, 1), ("d", 4, 1)):
        write_wav(tmp_path / f"{name}.wav", y, 44100, width, channels)
    (tmp_path / "broken.wav").write_bytes(b"RIFFxxxx")
    got = media.read_sound(spark, str(tmp_path), 22050, 0.6).collect()
    assert {(r.stim_id, r.start, len(r.samples)) for r in got if r.error is None} == {(s, t, n) for s in "abcd" for t, n in ((0.0, 13230), (0.6, 8820))}
    assert [r.stim_id for r in got if r.error is not None] == ["broken"]
    want = 0.5 * np.sin(2 * np.pi * 440 * np.arange(13230) / 22050)
    for r in got:
        if r.error is None and r.start == 0:
            assert np.abs(np.array(r.samples) - want).max() < (0.02 if r.stim_id == "c" else 1e-3)


def test_frames_shrink_and_thin_out(spark):
    rgb = np.zeros((8, 4, 3), np.uint8)
    rgb[:, 2:] = 200
    assert media.shrunk(rgb, 8) is rgb
    assert media.shrunk(rgb, 4).tolist() == np.repeat(np.repeat([[[0] * 3, [200] * 3]], 4, 0), 1, 1).tolist()
    assert media.shrunk(np.full((7, 5, 3), 9, np.uint8), 3).shape == (3, 2, 3)
    df = spark.createDataFrame([("m", k / 4, 4, 8, bytearray(rgb.tobytes())) for k in range(9)], media.FRAMES)
    got = media.analysis_frames(df, 2.0, 4).orderBy("t").collect()
    assert [(r.t, r.width, r.height) for r in got] == [(t / 2, 2, 4) for t in range(5)]
    cached = media.cached_frames(df, 9)
    assert cached.is_cached and not media.cached_frames(df.select("*"), 8).is_cached
    cached.unpersist()


def test_template_file(spark, tmp_path):
    assert sources.read_template(spark, str(tmp_path / "none.json")) is None
    rows = [r.asDict() for r in sources.template(spark).drop("class", "subclass", "leaf").collect()]
    (tmp_path / "t.json").write_text(json.dumps(rows))
    got = sources.read_template(spark, str(tmp_path / "t.json"))
    assert sorted(map(str, got.collect())) == sorted(map(str, sources.template(spark).collect()))


def test_human_tables_and_scores(spark, tmp_path):
    annotations.write_human(spark, str(tmp_path), ["visual", "audio"])
    one = spark.createDataFrame([("a", "x", 0, 0.0, 1.0, None, None, None)], annotations.schemas.CHANNEL_VALUES)
    one.write.mode("overwrite").parquet(f"{tmp_path}/human/visual")
    annotations.write_human(spark, str(tmp_path), ["visual", "audio"])
    assert [spark.read.parquet(f"{tmp_path}/human/{c}").count() for c in ("visual", "audio", "_free")] == [1, 0, 0]
    scores = spark.createDataFrame([("a", 0, 0.5), ("a", 1, -0.5)], "stim_id string, bin int, f1 double")
    annotations.write_scores(scores, str(tmp_path / "scores"), "visual")
    annotations.write_scores(scores.withColumn("f2", F.lit(1.0)), str(tmp_path / "scores"), "audio")
    annotations.write_scores(scores.limit(1), str(tmp_path / "scores"), "visual")
    assert sorted((r.category, r.bin, r.f1, r.f2) for r in annotations.read_scores(spark, str(tmp_path / "scores")).collect()) == [("audio", 0, 0.5, 1.0), ("audio", 1, -0.5, 1.0), ("visual", 0, 0.5, None)]


def test_nested_manifest(spark):
    rows = [("s", "b/x/q", "scalar", "m"), ("s", "a/y/r", "bool", ""), ("s", "a/x/z", "scalar", "s"), ("s", "a/x/b", "event", ""), ("t", "a/x/b", "event", "")]
    got = {r.stim_id: r.manifest for r in shape.nested_sidecar(spark.createDataFrame(rows, "stim_id string, path string, dtype string, units string")).collect()}
    leaf = lambda p, d, u: {"dtype": d, "units": u, "data_ref": f"features/{p}"}
    want = {"a": {"x": {"b": leaf("a/x/b", "event", ""), "z": leaf("a/x/z", "scalar", "s")}, "y": {"r": leaf("a/y/r", "bool", "")}}, "b": {"x": {"q": leaf("b/x/q", "scalar", "m")}}}
    assert got["s"] == json.dumps(want, separators=(",", ":")) and set(got) == {"s", "t"}


def test_one_clip(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "stim_id string, v int")
    assert shape.one_clip(df, "b").first().v == 2
    with pytest.raises(ValueError, match="no stimulus c"):
        shape.one_clip(df, "c")


def test_late_rows_are_dropped_and_runs_go_on(spark, tmp_path):
    """Three files, a batch each: a row older than the watermark is not counted, and a restart reads only what is new."""
    def put(k, rows):
        spark.createDataFrame(rows, "stim_id string, s double, v double").select("stim_id", F.timestamp_seconds("s").alias("ts"), "v").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    put(0, [("a", 10.0, 1.0), ("a", 11.0, 3.0)])
    schema = "stim_id string, ts timestamp, v double"
    stream = lambda: live.grid_means(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), 10, "20 seconds")
    run = lambda: {(int(r.time.timestamp()), r.v, r.n) for r in live.latest(live.run_available(spark, stream(), "update", "late", str(tmp_path / "run")), ["stim_id", "time"]).collect()}
    assert run() == {(10, 2.0, 2)}
    put(1, [("a", 100.0, 5.0)])
    assert run() == {(10, 2.0, 2), (100, 5.0, 1)}
    put(2, [("a", 12.0, 9.0), ("a", 101.0, 7.0)])  # the first is 88 s late
    assert run() == {(10, 2.0, 2), (100, 6.0, 2)}
    assert run() == {(10, 2.0, 2), (100, 6.0, 2)}


def test_frames_come_a_file_at_a_time(spark, tmp_path):
    rows = [("m", k / 2, 1, 1, bytearray(b"abc")) for k in range(12)]
    for k in range(0, 12, 3):  # files come in the order of their times
        spark.createDataFrame(rows[k : k + 3], media.FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "frames"))
    got = live.run_available(spark, live.kept_frames(media.frame_stream(spark, str(tmp_path / "frames")), 1.0), "append", "frames")
    assert sorted(r.t for r in got.collect()) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    assert got.select("batch").distinct().count() == 4


def test_refresh_goes_on_where_it_ended(spark, tmp_path):
    red = np.full((16, 16, 3), 200, np.uint8).tobytes()
    native = {"frames": spark.createDataFrame([(s, float(k), 16, 16, bytearray(red)) for s in "ab" for k in range(3)] + [("b", 9.0, 16, 16, bytearray(b"x")), ("c", 0.0, 16, 16, bytearray(b"x"))], media.FRAMES)}
    manifest = spark.createDataFrame([("a", "video-only", 3.0), ("b", "video-only", 3.0), ("c", "video-only", 2.0), ("d", "video-only", 0.2), ("e", "text-only", 2.0)], "id string, modality string, duration_sec double")
    template, folder = sources.template(spark), str(tmp_path / "corpus")
    first = {r.id: (r.status, r.n_channels, r.n_failed, r.error) for r in annotate.refresh(manifest.where("id <> 'e'"), native, template, folder).collect()}
    assert first["a"] == ("ok", 103, 0, "") and first["b"] == ("partial", 103, 1, "failed: VisualLowLevel")
    assert first["c"] == ("error", 103, 1, "failed: VisualLowLevel") and first["d"] == ("error", 0, 0, "no bin")
    second = {r.id: r.status for r in annotate.refresh(manifest, native, template, folder).collect()}
    assert second == {"a": "ok", "b": "partial", "c": "error", "d": "error", "e": "ok"}
    assert spark.read.parquet(f"{folder}/index").count() == 5 and annotations.read_annotations(spark, f"{folder}/values").select("stim_id").distinct().count() == 4


@pytest.mark.parametrize("seed", range(5))
def test_leaf_order_is_the_shortest(seed):
    """Against all orders that the tree allows."""
    rng = np.random.default_rng(seed)
    r = np.corrcoef(rng.normal(size=(6, 8)))
    merges = factors.average_linkage(r)
    orders = {i: [[i]] for i in range(6)}
    for k, (a, b, _) in enumerate(merges):
        orders[6 + k] = [x + y for x, y in itertools.product(orders[a], orders[b])] + [y + x for x, y in itertools.product(orders[a], orders[b])]
    length = lambda o: sum(1 - abs(r[i, j]) for i, j in itertools.pairwise(o))
    got = factors.leaf_order(merges, r)
    assert got in orders[10] and length(got) == pytest.approx(min(map(length, orders[10])))

"""Streams in any order against the batch, and what is left of their state; leading eigenpairs against the full ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import eigen, signals
from gridloom.streaming import live, timed

SCHEMA = "stim_id string, ts timestamp, v double"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    timed.configure(spark)
    yield spark
    spark.conf.set(key, before)


def batches(spark, folder, parts):
    for k, part in enumerate(parts):
        spark.createDataFrame([(s, t, v) for s, t, v in part], "stim_id string, t double, v double").select("stim_id", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "v").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_cuts_of_rows_out_of_order(rocks, tmp_path):
    spark, rng = rocks, random.Random(3)
    rows = [(s, 100 + i * 0.25, float(rng.choice([0, 0, 0, 5]))) for s in "ab" for i in range(120)]
    first, second = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]  # interleaved: each in the other's past
    stream = batches(spark, tmp_path, [first, second, [("z", 1000.0, 0.0)], [("z", 2000.0, 0.0)], [("y", 9000.0, 0.0)]])
    found = live.run_available(spark, timed.cuts_in_order(stream, 2.0, 0.6, "60 seconds", 100), "append", "timed", str(tmp_path / "run"))
    got = sorted((r.stim_id, r.us / 1e6) for r in found.collect())
    samples = spark.createDataFrame(rows, "stim_id string, t double, v double")
    delta = signals.pair_delta(samples).where("delta is not null").select("stim_id", "t", F.col("delta").alias("distance"))
    want = sorted((r.stim_id, r.t) for r in signals.detect_cuts(delta, 2.0, 0.6).collect())
    assert got == want and len(want) > 10
    state = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "run" / "state"))
    left = {r[0] for r in state.select("key.stim_id").collect()}
    assert left <= {"y", "z"} and not left & {"a", "b"}


def test_rows_of_an_ended_stimulus_are_gone(rocks, tmp_path):
    spark = rocks
    stream = batches(spark, tmp_path, [[("a", 10.0, 0.0), ("a", 11.0, 9.0)], [("z", 5000.0, 0.0)], [("z", 5001.0, 0.0)], [("z", 90000.0, 0.0)], [("z", 90001.0, 0.0)]])
    found = live.run_available(spark, timed.cuts_in_order(stream, 2.0, 0.5, "5 seconds", 60), "append", "ended", str(tmp_path / "run"))
    assert [(r.stim_id, r.us) for r in found.collect() if r.stim_id == "a"] == [("a", 11_000_000)]
    for name in ("held", "waiting"):
        options = spark.read.format("statestore").option("stateVarName", name)
        assert "a" not in {r[0] for r in options.load(str(tmp_path / "run" / "state")).select("key.stim_id").collect()}


def test_frames_and_drift_out_of_order(rocks, tmp_path):
    """Thinned samples and the drift of vectors, whose rows come in two interleaved batches."""
    spark, rng = rocks, np.random.default_rng(4)
    rows = [("a", 50 + k * 0.25, float(k)) for k in range(40)]
    stream = batches(spark, tmp_path / "kept", [rows[1::2], rows[::2], [("z", 5000.0, 0.0)], [("z", 9000.0, 0.0)]])
    found = live.run_available(spark, timed.kept_in_order(stream, 1.0, "60 seconds", 60), "append", "kept").where("stim_id = 'a'")
    assert sorted(r.us / 1e6 for r in found.collect()) == [50 + k for k in range(10)]
    x = rng.normal(size=(12, 3))
    table = spark.createDataFrame([("a", 100.0 + k, v.tolist()) for k, v in enumerate(x)] + [("z", 9000.0, [1.0, 0.0, 0.0]), ("z", 9900.0, [1.0, 0.0, 0.0])], "stim_id string, t double, vec array<double>").select("stim_id", F.timestamp_seconds("t").alias("ts"), "vec", "t")
    for k in (table.where("t < 200 and t % 2 = 1"), table.where("t < 200 and t % 2 = 0"), table.where("t = 9000"), table.where("t = 9900")):
        k.drop("t").coalesce(1).write.mode("append").parquet(f"{tmp_path}/vec")
    stream = spark.readStream.schema("stim_id string, ts timestamp, vec array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/vec")
    got = {r.us / 1e6 - 100: r.drift for r in live.run_available(spark, timed.drift_in_order(stream, "60 seconds", 600), "append", "drift").where("stim_id = 'a'").collect()}
    for k in range(12):
        total = x[:k].sum(0)
        assert got[k] == (pytest.approx(float(x[k] @ total / np.sqrt(total @ total) + 1e-9 * x[k].sum())) if k else None)


@pytest.mark.parametrize("correlation", [False, True])
def test_ten_pairs_of_4096_components(spark, correlation):
    """Within 1e-8 of the full decomposition, which for few rows follows from their products."""
    rng, n, dim = np.random.default_rng(1), 160, 4096
    x = rng.normal(size=(n, 24)) * np.linspace(9, 1, 24) @ rng.normal(size=(24, dim)) + 0.3 * rng.normal(size=(n, dim)) + 5
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(4)
    values, vectors = eigen.top_eigenpairs(rows, "v", dim, 10, correlation)
    z = x - x.mean(0)
    z = z / z.std(0, ddof=1) if correlation else z
    want, left = np.linalg.eigh(z @ z.T / (n - 1))
    want, left = want[::-1][:10], left[:, ::-1][:, :10]
    assert values == pytest.approx(want, rel=1e-8)
    directions = z.T @ left
    directions /= np.sqrt((directions**2).sum(0))
    assert np.abs((directions * vectors).sum(0)) == pytest.approx(np.ones(10), abs=1e-8)
    assert (vectors[np.abs(vectors).argmax(0), np.arange(10)] > 0).all()


def test_small_and_odd_tables(spark):
    rows = [([1.0, 2.0, 3.0],), ([2.0, 2.0, 1.0],), ([4.0, 2.0, 0.0],), (None,), ([1.0],), ([float("nan"), 0.0, 0.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    values, _ = eigen.top_eigenpairs(df, "v", 3, 5)
    assert values == pytest.approx(np.linalg.eigvalsh(np.cov(np.array([r[0] for r in rows[:3]]).T))[::-1], abs=1e-12)
    values, _ = eigen.top_eigenpairs(df, "v", 3, 3, True)
    r = np.corrcoef([1, 2, 4], [3, 1, 0])[0, 1]
    assert values == pytest.approx([1 + abs(r), 1 - abs(r), 0], abs=1e-12)
    with pytest.raises(ValueError):
        eigen.top_eigenpairs(df.limit(0), "v", 3, 2)


class Held:
    """A map or value state in a dict."""

    def __init__(self):
        self.d = {}

    exists = lambda self: bool(self.d)
    get = lambda self: self.d[()]
    update = lambda self, v: self.d.update({(): v})
    clear = lambda self: self.d.clear()
    getValue = lambda self, k: self.d[k]
    updateValue = lambda self, k, v: self.d.update({k: v})
    removeKey = lambda self, k: self.d.pop(k)
    iterator = lambda self: iter(list(self.d.items()))


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, Held())

    getValueState = getMapState
    listTimers = lambda self: iter(self.timers)
    deleteTimer = lambda self, ms: self.timers.discard(ms)
    registerTimer = lambda self, ms: self.timers.add(ms)


def test_a_fold_sees_a_bounded_piece_of_a_stimulus(monkeypatch):
    """However many rows are due at once, entries and pieces are bounded, and all rows come once, in order."""
    import json
    import types

    import pandas as pd

    for name, n in (("RUN", 40), ("CHUNK", 7), ("RUNS", 3), ("PIECE", 10)):
        monkeypatch.setattr(timed, name, n, raising=False)
    seen, sizes, rng = [], [], random.Random(1)

    def fold(state, rows):
        sizes.append(len(rows))
        seen.extend(rows["us"])
        return [len(seen)], [(int(rows["us"].iloc[0]),)]

    handle = Handle()
    one = timed.InOrder(fold, ["us"], 10**9)
    one.init(handle)
    times = rng.sample(range(100_000), 1000) + [500] * 30  # thirty rows of one time stay together
    rng.shuffle(times)
    at = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    for k in range(0, len(times), 100):
        some = times[k : k + 100]
        parts = [pd.DataFrame({"ms": some[i : i + 30], "row": [json.dumps({"us": t}) for t in some[i : i + 30]]}) for i in range(0, len(some), 30)]
        list(one.handleInputRows(("a",), iter(parts), at))
    assert not seen and max(v[0].count("\n") for v in handle.states["waiting"].d.values()) < 7
    assert len(handle.states["runs"].d) < 12
    for watermark in (50_000, 10**6):
        at.getCurrentWatermarkInMs = lambda w=watermark: w
        list(one.handleExpiredTimer(("a",), at, None))
        assert seen == sorted(t for t in times if t < watermark)
    assert sorted(sizes)[-2] <= 11 and max(sizes) < 45 and not handle.states["waiting"].d and not handle.states["runs"].d

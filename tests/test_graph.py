"""The graph of extractors and typed channels: order, failures, shapes, load hooks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import products, typed
from gridloom.plans import annotate, extractors, graph
from gridloom.sources import stimuli as sources

STIMULI = "stim_id string, modality string, duration_sec double"


def node(name, reads=(), gives=(), make=None):
    return graph.Node(name, reads, make or (lambda s, b, t: graph.Made(tables={g: s for g in gives})), gives)


def test_order_circles_and_double_makers():
    a, b, c = node("a", ("y",)), node("b", ("x",), ("y",)), node("c", (), ("x",))
    assert [n.name for n in graph.in_order([a, b, c])] == ["c", "b", "a"]
    with pytest.raises(ValueError):
        graph.in_order([node("a", ("y",), ("x",)), node("b", ("x",), ("y",))])
    with pytest.raises(ValueError, match="both make"):
        graph.in_order([node("a", (), ("x",)), node("b", (), ("x",))])


def test_a_failure_takes_its_dependants_only(spark):
    stimuli = spark.createDataFrame([("m", "audiovisual", 3.0)], STIMULI)

    def broken(s, bins, t):
        return graph.Made(tables={"x": s.select(F.raise_error(F.lit("no model")).alias("v"))})

    good = lambda s, b, t: graph.Made(typed.sample(b, "audio/speech/word_rate", "time_sec", v=F.lit(1.0)))
    nodes = [node("last", ("y",)), node("next", ("x",), ("y",)), node("first", (), ("x",), broken), node("other", (), (), good), node("lost", ("nothing",))]
    done = graph.run(nodes, stimuli, {}, sources.template(spark))
    assert done.status["first"].startswith("failed") and "no model" in done.status["first"]
    assert done.status["next"] == "skipped: needs first" and done.status["last"] == "skipped: needs next" and done.status["lost"] == "absent: nothing" and done.status["other"] == "ok"
    assert done.values.where("num is not null").count() == 3 and done.values.count() == 3 * 103


def test_every_kind_of_channel(spark):
    kinds = [("a/b/mean", "scalar", "mean"), ("a/b/any", "bool", "any"), ("a/b/count", "event", "count"), ("a/b/near", "scalar", "nearest"), ("a/b/step", "scalar", "step"), ("a/b/vec", "vector", "mean"), ("a/b/top", "categorical", "mode"), ("a/b/text", "label", "concat"), ("a/b/said", "label", "vlm"), ("a/b/none", "scalar", "mean")]
    template = spark.createDataFrame(kinds, "path string, dtype string, resample string")
    stimuli = spark.createDataFrame([("m", 3.0)], "stim_id string, duration_sec double")
    rows = []
    add = lambda path, start, end=None, v=None, vec=None, code=None, label=None: rows.append(("m", f"a/b/{path}", start, end, v, vec, code, label))
    for t, v in ((0.0, 1.0), (0.4, 3.0), (0.5, float("nan")), (1.5, 8.0), (9.0, 7.0), (-3.0, 7.0)):
        for path in ("mean", "any", "count", "near", "step"):
            add(path, t, v=v)
    add("vec", 0.1, vec=[1.0, None])
    add("vec", 0.2, vec=[3.0, 5.0])
    for code in (2, 1, 2, 1, 0):
        add("top", 1.1, code=code)
    add("text", 1.2, label="b")
    add("text", 0.9, label="a")
    add("said", 0.0, 2.0, label="early")
    add("said", 1.0, 1.0, label="late")
    samples = spark.createDataFrame(rows, "stim_id string, path string, start double, end double, v double, vec array<double>, code int, label string")
    got = {(r.path[4:], r.bin): (r.num, r.vec, r.code, r.label, r.applicable) for r in typed.channels(samples, template, stimuli).collect()}
    assert len(got) == 30
    num = lambda path: [got[path, b][0] for b in range(3)]
    assert num("mean") == [2, None, 8] and num("any") == [3, None, 8] and num("count") == [2, 0, 1] and num("near") == [1, None, 8] and num("step") == [None, None, 8]
    assert got["vec", 0][1] == [2, 5] and got["vec", 1][1] is None
    assert [got["top", b][2] for b in range(3)] == [None, 1, None]
    assert [got["text", b][3] for b in range(3)] == ["", "a b", ""] and [got["said", b][3] for b in range(3)] == ["early", "late", "early"]
    assert not got["none", 0][4] and got["mean", 1][4]


def test_no_samples_and_no_stimuli(spark):
    template = sources.template(spark).limit(5)
    none = spark.createDataFrame([], "stim_id string, path string, start double, end double, v double, vec array<double>, code int, label string")
    stimuli = spark.createDataFrame([("m", 2.0)], "stim_id string, duration_sec double")
    assert typed.channels(none, template, stimuli).where("not applicable").count() == 10
    assert typed.channels(none, template, stimuli.limit(0)).count() == 0


def test_loaded_once_a_worker(spark, tmp_path):
    """Many tasks of two runs; each worker loads once."""

    def load():
        with open(f"{tmp_path}/{os.getpid()}", "a") as f:
            f.write("x")
        return 3.0

    def read(row, held):
        return {"audio/low_level/rms": (np.array([row["t"]]), np.array([held * os.getpid()]))}

    extractor = annotate.Extractor(f"Counted{tmp_path}", ("audiovisual",), "rows", read, load=load)
    stimuli = spark.createDataFrame([("m", "audiovisual", 4.0)], STIMULI)
    native = spark.range(400).select(F.lit("m").alias("stim_id"), (F.col("id") / 100).alias("t")).repartition(16)
    seen = {int(r.v / 3) for _ in range(2) for r in annotate.extract(extractor, stimuli, native).select("v").distinct().collect()}
    assert {int(p) for p in os.listdir(tmp_path)} == seen and all((tmp_path / str(p)).read_text() == "x" for p in seen)


def test_annotate_runs_pixels_sound_and_transcripts_together(spark):
    stimuli = spark.createDataFrame([("m", "audiovisual", 4.0), ("s", "text-only", 4.0)], STIMULI)
    said = spark.createDataFrame([("m", 0, "one two", 0.0, 1.0), ("m", 1, "three", 2.0, 3.0), ("s", 0, "four five", 0.0, 2.0)], "stim_id string, i int, text string, start double, end double")
    rate = 22050
    tone = np.sin(2 * np.pi * 440 * np.arange(4 * rate) / rate)
    sound = spark.createDataFrame([("m", 0.0, rate, tone.tolist())], "stim_id string, start double, rate int, samples array<double>")
    norms = spark.createDataFrame([("one", 2.0), ("four", 6.0)], "word string, valence double")
    bad = spark.createDataFrame([("m", 0, "x")], "stim_id string, i int, logits string")
    values, failed = annotate.annotate(stimuli, {"segments": said, "sound": sound, "norms": norms, "sentiment_logits": bad}, sources.template(spark))
    rows = values.collect()
    assert len({(r.stim_id, r.path, r.bin) for r in rows}) == len(rows) == 2 * 4 * 103
    got = {(r.stim_id, r.path.split("/")[-1], r.bin): r for r in rows if r.path.startswith(("audio/", "language/lexical/v"))}
    assert got["m", "asr_text", 0].label == "one" and got["m", "asr_text", 1].label == "two" and got["s", "speech_present", 3].num == 0
    assert len(got["m", "mfcc", 1].vec) == 13 and got["s", "mfcc", 1].vec is None and max(range(12), key=got["m", "chroma", 2].vec.__getitem__) == 9
    assert got["m", "f0", 2].num == pytest.approx(440, rel=0.01) and got["m", "valence", 0].num == 2 and got["s", "valence", 0].num == 6
    assert {(r.stim_id, r.error.split(":")[0]) for r in failed.collect()} == {("m", "TextSentiment"), ("s", "TextSentiment")}
    status = {r.id: (r.status, r.n_failed) for r in annotate.batch_status(stimuli, values, failed).collect()}
    assert status == {"m": ("partial", 1), "s": ("partial", 1)}


def test_shots_of_colours(spark):
    rows = [("m", k / 2, [1.0, 0.0] if k < 4 else [0.0, 1.0]) for k in range(8)]
    stimuli = spark.createDataFrame([("m", "audiovisual", 4.0)], STIMULI)
    done = graph.run([n for n in extractors.NODES if n.name == "VisualShots"], stimuli, {"colors": spark.createDataFrame(rows, "stim_id string, t double, h array<double>")}, sources.template(spark))
    got = {(r.path.split("/")[-1], r.bin): r.num for r in done.values.where("applicable").collect()}
    assert [got["cut", b] for b in range(4)] == [0, 0, 1, 0] and [got["shot_index", b] for b in range(4)] == [0, 0, 1, 1]


def test_prompts_for_expectations(spark):
    said = spark.createDataFrame([("m", 0, "a"), ("m", 1, "b"), ("m", 2, "c")], "stim_id string, i int, text string")
    got = {r.i: r.prompt for r in extractors.expectation_prompts(said).collect()}
    assert set(got) == {1, 2} and got[2].startswith("So far: a b\nNext: c\n")


@pytest.mark.parametrize(("block", "most"), [(4096, 64), (16, 64), (4, 3)])
def test_novelty_in_blocks(spark, block, most):
    rng = np.random.default_rng(1)
    rows = [(s, i, rng.normal(size=4).tolist()) for s in "ab" for i in range(60 if s == "a" else 1)]
    got = {(r.stim_id, r.i): r.alike for r in products.most_alike_before(spark.createDataFrame(rows, "stim_id string, i int, e array<double>"), block, most).collect()}
    for s, i, e in rows:
        before = [float(np.dot(e, f)) for t, j, f in rows if t == s and j < i]
        assert got[s, i] == (pytest.approx(max(before)) if before else None)


def test_prompts_in_packs(spark, monkeypatch):
    monkeypatch.setattr(products, "PACK", 3)
    monkeypatch.setattr(products, "BLOCK", 4)
    rng = np.random.default_rng(2)
    v, p = rng.normal(size=(11, 5)), rng.normal(size=(8, 5))
    v[3] = 0
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, e array<double>")
    prompts = spark.createDataFrame([(k, f"p{k}", x.tolist()) for k, x in enumerate(p)], "k int, name string, vec array<double>")
    for r in products.prompt_cosines(vectors, "e", prompts).collect():
        assert [c.name for c in r.cosines] == [f"p{k}" for k in range(8)]
        want = [float(v[r.id] @ x / np.sqrt((v[r.id] @ v[r.id]) * (x @ x))) if r.id != 3 else None for x in p]
        assert [c.cosine for c in r.cosines] == [None if w is None else pytest.approx(w) for w in want]


def test_frequencies(spark):
    words = spark.createDataFrame([("The",), ("the,",), ("cat",), ("...",)], "text string")
    assert {r.word: r.freq_zipf for r in extractors.frequencies(words).collect()} == {"the": pytest.approx(np.log10(2e9 / 3)), "cat": pytest.approx(np.log10(1e9 / 3))}


def test_events_from_what_the_others_made(spark):
    """The second phase reads the channels of the first; too short a stimulus has no events, and others' channels stay."""
    rng = np.random.default_rng(5)
    paths = list(extractors.EVENT_PATHS[:8])
    level = np.repeat(rng.normal(size=(4, 8)), 8, 0) + 0.05 * rng.normal(size=(32, 8))
    stimuli = spark.createDataFrame([("m", "audio-only", 32.0), ("s", "audio-only", 3.0)], STIMULI)
    names = {f"c{k}": p for k, p in enumerate(paths)}
    rows = spark.createDataFrame([("m", float(k), *map(float, x)) for k, x in enumerate(level)] + [("s", 0.0, *[1.0] * 8)], "stim_id string, t double, " + ", ".join(f"{c} double" for c in names))
    first = graph.Node("First", ("rows",), lambda s, b, t: graph.Made(typed.scalars_of(t["rows"], "", names, "t")))
    last = next(n for n in extractors.NODES if n.name == "EventSegmentation")
    done = graph.run([last, first], stimuli, {"rows": rows}, sources.template(spark))
    assert done.status == {"First": "ok", "EventSegmentation": "ok"}
    rows = done.values.collect()
    assert len(rows) == len({(r.stim_id, r.path, r.bin) for r in rows}) == 35 * 103
    got = {(r.stim_id, r.path.split("/")[-1], r.bin): r.num for r in rows if r.path.startswith("situation/") or r.path in paths}
    assert [got["m", "event_id", b] for b in range(32)] == np.repeat(np.arange(4.0), 8).tolist()
    assert [b for b in range(32) if got["m", "event_boundary", b] == 1] == [8, 16, 24] and got["m", "event_boundary", 3] == 0
    assert got["s", "event_id", 0] is None and got["s", "event_boundary", 0] is None and got["s", "rms", 0] == 1 and got["m", "luminance", 3] == pytest.approx(level[3, 0])


def test_embeddings_of_segments(spark):
    said = spark.createDataFrame([("m", 0, "a", 0.0, 1.0), ("m", 1, "b", 1.0, 2.0)], "stim_id string, i int, text string, start double, end double")
    vectors = spark.createDataFrame([("m", 0, [1.0, 0.0]), ("m", 1, [0.0, 1.0])], "stim_id string, i int, vec array<double>")
    nodes = [n for n in extractors.NODES if n.name in ("ASR", "LanguageEmbedding")]
    done = graph.run(nodes, spark.createDataFrame([("m", "text-only", 3.0)], STIMULI), {"segments": said, "embeddings": vectors}, sources.template(spark))
    assert {r.bin: r.vec for r in done.values.where("path = 'language/embedding/qwen3'").collect()} == {0: [1.0, 0.0], 1: [0.5, 0.5], 2: [0.0, 1.0]}


def sent_to_all(df):
    """The plans of what a query sends to all tasks, before it runs."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    found = []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((j for j in range(k + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))
            found.append("\n".join(lines[k:below]))
    return found


def test_no_bins_and_no_samples_are_sent_to_all(spark, tmp_path):
    """Files of samples, and stimuli before their bins are counted out, are small; in memory they are not."""
    spark.range(300).select(F.col("id").cast("string").alias("stim_id"), F.lit(50.0).alias("duration_sec")).write.parquet(f"{tmp_path}/stimuli")
    stimuli = spark.read.parquet(f"{tmp_path}/stimuli")
    bins = stimuli.select("stim_id", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("start"))
    typed.together(typed.sample(bins, "audio/speech/word_rate", v=F.lit(1.0)), typed.sample(bins, "audio/speech/asr_text", label=F.lit("a"))).write.parquet(f"{tmp_path}/samples")
    samples = spark.read.parquet(f"{tmp_path}/samples")
    got = typed.channels(samples, sources.template(spark), stimuli)
    for plan in sent_to_all(got):
        assert "Generate" not in plan and "/samples" not in plan, plan
    assert got.where("applicable").count() == 300 * 50 * 2 and got.count() == 300 * 50 * 103
    assert {r[0] for r in got.where("path = 'audio/speech/word_rate'").select("num").distinct().collect()} == {1.0}


def test_native_rows_are_dealt_to_all_tasks(spark):
    """Rows of one small file are much work: each task gets its share, and what fails in between loses nothing."""

    def read(row):
        if row["k"] == 7:
            raise ValueError("broken")
        t = np.arange(3000.0)
        return {"a/v": (t, t + row["k"]), "a/w": (t[:2], np.ones((2, 2)) * row["k"])}

    extractor = annotate.Extractor("Dealt", ("audiovisual",), "rows", read)
    stimuli = spark.createDataFrame([("m", "audiovisual", 3.0)], STIMULI)
    native = spark.range(40, numPartitions=1).select(F.lit("m").alias("stim_id"), F.col("id").alias("k"))
    found = annotate.extract(extractor, stimuli, native)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {r.path: r for r in found.groupBy("path").agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.sum(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)).alias("w"), F.max("error").alias("error")).collect()}
    ks = sum(range(40)) - 7
    assert got["a/v"].n == 39 * 3000 and got["a/v"].v == 39 * 2999 * 1500 + 3000 * ks and got["a/w"].n == 78 and got["a/w"].w == 4 * ks and "broken" in got[None].error and got[None].n == 1


def test_numbers_that_round_to_zero_keep_their_sign_as_in_sql(spark):
    import duckdb

    from gridloom.plans.on_graph import flat

    numbers = [-4e-7, -6e-8, 6e-8, 0.0, -1e-17, -6e-7, None]
    rows = spark.createDataFrame([("a", "p", k, x, None, None, None) for k, x in enumerate(numbers)], "stim_id string, path string, bin int, num double, vec array<double>, code int, label string")
    got = [r.num for r in flat(rows).orderBy("bin").collect()]
    want = [duckdb.sql(f"SELECT round({x!r}::DOUBLE, 6)").fetchall()[0][0] for x in numbers if x is not None and x != -1e-17]
    assert [repr(x) for x in got] == [*map(repr, want[:4]), "0.0", repr(want[4]), "None"]


def test_words_are_made_once_and_where_they_are(spark, tmp_path):
    """Words are timed within their segment, without a shuffle; samples come from the table as written, and silence is one sample of a stimulus."""
    spark.createDataFrame([("m", k, "The cat,  the HAT's mat" if k % 2 else "a b", 40.0 * k, 40.0 * k + 30) for k in range(20)], "stim_id string, i int, text string, start double, end double").write.parquet(f"{tmp_path}/segments")
    stimuli = spark.createDataFrame([("m", "audiovisual", 800.0), ("n", "audiovisual", 5.0)], STIMULI)
    bins = spark.createDataFrame([("m", k, float(k)) for k in range(800)], "stim_id string, bin int, time_sec double")
    made = extractors.transcript(stimuli, bins, {"segments": spark.read.parquet(f"{tmp_path}/segments")})
    plan = made.tables["words"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan, plan
    words = {(r.seg, r.i): (r.text, r.start) for r in made.tables["words"].collect()}
    assert len(words) == 70 and words[1, 3] == ("HAT's", 40 + 3.5 / 5 * 30) and words[2, 0] == ("a", 80 + 0.5 / 2 * 30)
    other = made.tables["words"].where("seg = 1")
    found = made.samples({"words": other}).collect()
    assert sorted(r.label for r in found if r.label is not None) == sorted(["The", "cat,", "the", "HAT's", "mat"])
    assert [(r.stim_id, r.start, r.end) for r in found if r.v == 0] == [("m", 0.0, 800.0)]
    zipf = {r.word: round(r.freq_zipf, 6) for r in extractors.frequencies(made.tables["words"]).collect()}
    assert zipf == {w: round(np.log10(n / 70 * 1e9), 6) for w, n in {"the": 20, "cat": 10, "hat's": 10, "mat": 10, "a": 10, "b": 10}.items()}


def test_counting_channels_does_not_make_their_values(spark, tmp_path):
    """What only the shape is asked of needs no samples of points but to know which channels apply."""
    stimuli = spark.createDataFrame([(str(k), 50.0) for k in range(9)], "stim_id string, duration_sec double")
    bins = stimuli.select("stim_id", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("start"))
    typed.together(typed.sample(bins, "audio/speech/word_rate", v=F.lit(1.0)), typed.sample(bins, "audio/speech/asr_text", label=F.lit("a"))).write.parquet(f"{tmp_path}/samples")
    got = typed.channels(spark.read.parquet(f"{tmp_path}/samples"), sources.template(spark), stimuli).groupBy("path").agg(F.count("*").alias("n"), F.count_if("applicable").alias("applies"))
    assert not [f for f in got.inputFiles() if "/samples/" in f]
    assert {(r.path, r.n, r.applies) for r in got.where("applies > 0").collect()} == {("audio/speech/word_rate", 450, 450), ("audio/speech/asr_text", 450, 450)} and got.where("n = 450").count() == 103


def shuffled(spark):
    """How many rows were written to shuffles so far."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


KINDS = [("mean", "scalar", "mean"), ("any", "bool", "any"), ("count", "event", "count"), ("near", "scalar", "nearest"), ("step", "scalar", "step"), ("often", "scalar", "mode"), ("vec", "vector", "mean"), ("top", "categorical", "mode"), ("text", "label", "concat"), ("said", "label", "vlm"), ("usual", "label", "mode")]


def test_spans_give_what_their_bins_would(spark):
    """Spans of all lengths, over the bounds of stretches, some alike, some of nothing, some beyond the grid."""
    rng = np.random.default_rng(3)
    n_bins = {"a": 3 * typed.STRETCH + 5, "b": 7, "c": typed.STRETCH}
    rows = []
    for stim, n in n_bins.items():
        for path, *_ in KINDS:
            for k in range(40):
                start = float(np.round(rng.uniform(-5, n + 5), 1)) + k / 1000
                end = [None, start, start + float(rng.integers(0, 6)), start + float(rng.integers(0, 2 * typed.STRETCH))][rng.integers(4)]
                v, code, label = (float(rng.integers(0, 4)), int(rng.integers(0, 3)), "xyz"[rng.integers(3)]) if rng.random() < 0.9 else (None, None, None)
                rows.append((stim, path, start, end, v, None if v is None else [v, None, v + 1], code, label))
    samples = spark.createDataFrame(rows, "stim_id string, path string, start double, end double, v double, vec array<double>, code int, label string")
    stimuli = spark.createDataFrame([(s, float(n)) for s, n in n_bins.items()], "stim_id string, duration_sec double")
    got = {(r.stim_id, r.path, r.bin): r for r in typed.channels(samples, spark.createDataFrame(KINDS, "path string, dtype string, resample string"), stimuli).collect()}
    assert len(got) == sum(n_bins.values()) * len(KINDS)
    most = lambda xs: min(xs, key=lambda x: (-xs.count(x), x)) if xs else None
    held: dict = {}
    for r in rows:
        for b in range(max(0, round(r[2])), min(n_bins[r[0]] - 1, round(r[2] if r[3] is None else r[3])) + 1):
            held.setdefault((r[0], r[1], b), []).append(r)
    for (stim, path, b), r in got.items():
        of = sorted(held.get((stim, path, b), []), key=lambda s: s[2])
        vs, labels = [s[4] for s in of if s[4] is not None], [s[7] for s in of if s[7] is not None]
        if path in ("mean", "any", "count", "often", "near", "step"):
            near = min(of, key=lambda s: (abs(s[2] - b), s[2]), default=None)
            want = {"mean": sum(vs) / len(vs) if vs else None, "any": max(vs, default=None), "count": len(vs), "often": most(vs), "near": near and near[4], "step": of[-1][4] if of else None}[path]
            assert r.num == (want if want is None else pytest.approx(want)), (stim, path, b)
        elif path == "vec":
            assert r.vec == (None if not vs else pytest.approx([sum(vs) / len(vs), None, sum(vs) / len(vs) + 1])), (stim, path, b)
        elif path == "top":
            assert r.code == most([s[6] for s in of if s[6] is not None])
        else:
            assert r.label == {"text": " ".join(labels), "said": of[-1][7] if of else None, "usual": most(labels)}[path], (stim, path, b)


def test_bins_of_spans_are_not_shuffled_and_dealt_to_all_tasks(spark):
    """A span is a few rows to the last, however many bins it has; what comes of few rows is made by all tasks."""
    stimuli = spark.createDataFrame([(str(k), 20_000.0) for k in range(8)], "stim_id string, duration_sec double")
    spans = stimuli.select("stim_id", F.explode(F.sequence(F.lit(0), F.lit(19_900), F.lit(100))).alias("start"))
    parts = [typed.sample(spans, path, end=F.col("start") + 99, **value) for path, value in (("language/syntax/tree_depth", {"v": F.lit(1.0)}), ("affect/depicted/text_sentiment", {"vec": F.lit([1.0, 2.0, 3.0])}), ("affect/depicted/text_sentiment_top", {"code": F.lit(1)}))]
    got = typed.channels(typed.together(*parts), sources.template(spark), stimuli).where("applicable")
    before = shuffled(spark)
    assert got.agg(F.count("num") + F.count("vec") + F.count("code")).first()[0] == 3 * 8 * 20_000
    assert shuffled(spark) - before < 80_000  # 4,800 spans; their bins are 480,000
    assert got.where("vec is not null").select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_samples_of_no_channel_asked_for_are_not_made(spark):
    """Of an extractor that others need only its table is written, where none of its channels is in the template."""
    stimuli = spark.createDataFrame([("m", "audiovisual", 3.0)], STIMULI)

    def make(s, bins, t):
        never = typed.sample(bins, "audio/speech/word_rate", "time_sec", v=F.raise_error(F.lit("made")).cast("double"))
        return graph.Made(typed.together(never, typed.sample(bins, "audio/speech/speech_present", "time_sec", v=F.lit(1.0))), {"x": s})

    after = lambda s, bins, t: graph.Made(typed.sample(t["x"], "language/syntax/tree_depth", F.lit(1.0), v=F.lit(2.0)))
    template = sources.template(spark).where("path like 'language/%' or path = 'audio/speech/speech_present'")
    done = graph.run([node("first", (), ("x",), make), node("next", ("x",), (), after)], stimuli, {}, template)
    assert done.status == {"first": "ok", "next": "ok"}
    assert sorted((r.path, r.bin, r.num) for r in done.values.where("num is not null").collect()) == [*(("audio/speech/speech_present", k, 1.0) for k in range(3)), ("language/syntax/tree_depth", 1, 2.0)]

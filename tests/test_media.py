"""Painted pictures and sound, blocks' rule and segments' determinants against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import media
from gridloom.operators import design, factors
from gridloom.plans import on_corpus, on_media
from gridloom.plans.annotate import annotate
from gridloom.plans.all import QUERIES
from gridloom.sources import stimuli as sources


def painted(e):
    y, x = np.mgrid[:16, :16]
    plane = lambda s: np.clip(np.floor(256 * (8 * e[(y + s) % 64] * e[(16 + x + s) % 64] + e[(32 + (y + x) % 32 + s) % 64])) + 128, 0, 255)
    return np.stack([plane(s) for s in on_media.PLANES], 2).astype(np.uint8)


def test_pictures_are_painted_as_said(spark, sf):
    vectors = {(str(r.label), r.vec_id % 40 * 0.5, painted(np.array(r.embedding, float)).tobytes()) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert {(r.stim_id, r.t, bytes(r.rgb)) for r in on_media.pictures(spark, sf).collect()} == vectors


def test_short_and_broken_vectors_make_no_picture(spark, tmp_path):
    rows = [(1, [0.1] * 64, 1), (2, [0.1] * 63, 1), (3, None, 1), (4, [float("nan"), *[0.1] * 63], 1), (5, [None, *[0.1] * 63], 1), (6, [], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert [r.t for r in on_media.pictures(spark, str(tmp_path)).collect()] == [0.5]


def test_edges_of_pictures_are_those_of_the_grid(spark, sf):
    """The one low-level channel that the query leaves out: means by bin of plain pictures."""
    want = {}
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        want.setdefault((str(r.label), int(np.rint(r.vec_id % 40 * 0.5))), []).append(media.picture(painted(np.array(r.embedding, float)))["edge_density"])
    got = on_media.of_pictures(spark, sf, "visual/low_level_static").where("endswith(path, 'edge_density')").collect()
    assert {(r.stim_id, r.bin): r.num for r in got} == {k: pytest.approx(np.mean(v), abs=1e-6) for k, v in want.items() if k[1] < 20}


def test_every_channel_of_sound_is_that_of_its_stretch(spark, sf):
    heard = on_media.sound(spark, sf)
    films = heard.groupBy("stim_id").agg((F.max("start") + 1).alias("duration_sec")).withColumn("modality", F.lit("audio-only"))
    values, failed = annotate(films, {"sound": heard}, sources.template(spark).where("startswith(path, 'audio/low_level')"))
    assert failed.isEmpty()
    got = {(r.stim_id, r.bin, r.path.rsplit("/", 1)[1]): r.num if r.num is not None else r.vec for r in values.collect()}
    row = heard.where("start = 0").orderBy("stim_id").first()
    y = np.array(row.samples)
    times, numbers = media.sound(y, on_media.RATE)
    early = np.rint(times) == 0
    for name in ("spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "spectral_flatness", "onset_strength"):
        assert got[row.stim_id, 0, name] == pytest.approx(numbers[name][early].mean())
    assert got[row.stim_id, 0, "mfcc"] == pytest.approx(media.cepstrum(y, on_media.RATE)[early].mean(0).tolist())
    assert got[row.stim_id, 0, "chroma"] == pytest.approx(media.chroma(y, on_media.RATE)[early].mean(0).tolist())


def test_rule_of_blocks(spark):
    rows = spark.range(400).select(F.col("id").cast("int").alias("d")).select("d", factors.block_rule(F.col("d")).alias("r")).collect()
    for r in rows:
        m = factors.block_size(r.d)
        assert (r.r.most_factors, r.r.m, r.r.components) == (factors.most_factors(r.d), m, factors.use_components(r.d, m)), r.d


def test_determinants_of_segments(spark, sf):
    rows = on_corpus.items(spark, sf).toPandas()
    plain = {k: g[on_corpus.ITEMS[:2]].to_numpy() for k, g in rows.assign(seg=rows.bin // 10).groupby(["stim_id", "seg"]) if len(g) == 10}
    stats = design.sufficient_stats(design.design_segments(on_corpus.items(spark, sf), 10), on_corpus.ITEMS[:2])
    got = {(r.stim_id, r.seg): r.log_det for r in design.segment_log_dets(stats, 2).collect()}
    assert got == {k: pytest.approx(np.linalg.slogdet(np.cov(x, rowvar=False) + 1e-3 * np.eye(2))[1]) for k, x in plain.items()}
    assert design.segment_log_dets(stats.limit(0), 2).collect() == []


def test_a_segment_of_one_row_and_one_of_equal_rows(spark):
    """Both have no variance: the ridge alone is left."""
    rows = spark.createDataFrame([(1, 0, 2.0, 3.0), (2, 0, 5.0, 5.0), (2, 0, 5.0, 5.0)], "stim_id long, seg int, a double, b double")
    got = {r.stim_id: r.log_det for r in design.segment_log_dets(design.sufficient_stats(rows, ["a", "b"]), 2).collect()}
    assert got == {1: pytest.approx(2 * np.log(1e-3)), 2: pytest.approx(2 * np.log(1e-3))}


def test_tree_of_variables_is_that_of_the_matrix(spark, sf):
    got = sorted(tuple(r) for r in QUERIES["variable_clusters"](spark, sf).collect())
    assert [g[0] for g in got] == [1, 2, 3, 4]
    assert all(a[3] <= b[3] + 1e-9 for a, b in zip(got, got[1:], strict=False))
    assert sorted(x for g in got for x in g[1:3]) == list(range(8))

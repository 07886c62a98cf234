"""Reading and writing what a corpus is kept in."""

import json

import numpy as np
import pytest

from gridloom import schemas
from gridloom.operators import factors, search
from gridloom.sources import annotations
from gridloom.sources import stimuli as sources


def test_scan_of_a_folder(spark, tmp_path):
    for name in ("movies/open/a.MP4", "movies/hcp/Post_20140821_version/b.mp4", "movies/hcp/c.mp4", "movies/open/README.txt", "movies/open/d.jpg", "movies/open/e.story"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    found = sources.scan_media(spark, str(tmp_path / "movies")).collect()
    assert sorted((r.id, r.source, r.extension) for r in found) == [("a", "open", "mp4"), ("c", "hcp", "mp4"), ("e", "open", "story")]


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "valence.csv").write_text("word,value,note\n The ,1.5,\nthe,2.5,x\nbad,n/a,\n")
    assert [tuple(r) for r in sources.read_norms(spark, str(tmp_path / "valence.csv")).collect()] == [("the", 2.5)]


def test_manifest_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,path,source,modality,duration_sec,fps,width,height,has_video,has_audio,rights\na,p,open,audiovisual,12.5,24,10,10,True,True,x\n")
    row = sources.read_manifest(spark, str(tmp_path / "m.csv")).first()
    assert (row.id, row.duration_sec) == ("a", 12.5)


def values(spark, rows):
    return spark.createDataFrame([(s, p, b, float(b), n, None, None, None) for s, p, b, n in rows], schemas.CHANNEL_VALUES)


def test_annotations_replace_their_own_stimulus_only(spark, tmp_path):
    out = str(tmp_path / "annotations")
    annotations.write_annotations(values(spark, [("a", "x/y/z", 0, 1.0), ("b", "x/y/z", 0, 2.0)]), out)
    annotations.write_annotations(values(spark, [("a", "x/y/z", 0, 3.0), ("a", "x/y/z", 1, None)]), out)
    (tmp_path / "annotations" / "stim_id=b" / "part-broken.parquet").write_text("no parquet")
    got = sorted((r.stim_id, r.bin, r.num) for r in annotations.read_annotations(spark, out).collect())
    assert got == [("a", 0, 3.0), ("a", 1, None), ("b", 0, 2.0)]


def test_transcripts_there_and_back(spark, tmp_path):
    segments = spark.createDataFrame([("s", 0, "a b", 0.0, 1.0)], "stim_id string, i int, text string, start double, end double")
    words = spark.createDataFrame([("s", 1, "b", 0.5, 1.0, 0.9), ("s", 0, "a", 0.0, 0.5, 1.0)], "stim_id string, i int, text string, start double, end double, prob double")
    text = annotations.transcripts_json(segments, words).first().json
    assert [w["text"] for w in json.loads(text)["words"]] == ["a", "b"]
    (tmp_path / "s.base.json").write_text(text)
    assert [(r.stim_id, r.i, r.text) for r in annotations.read_transcripts(spark, str(tmp_path)).orderBy("i").collect()] == [("s", 0, "a"), ("s", 1, "b")]


def test_search_index(spark):
    rows = spark.createDataFrame([("s", b, p, float(b + k)) for b in range(6) for k, p in enumerate(("a/b", "c/d"))], "stim_id string, bin int, path string, num double")
    segments = search.segment_means(rows, 3)
    lines = [json.loads(r.json) for r in annotations.index_json(segments, search.channel_stats(segments)).collect()]
    assert sorted((x["seg"], x["t0"], x["t1"], x["v"]) for x in lines) == [(0, 0.0, 3.0, [1.0, 2.0]), (1, 3.0, 6.0, [4.0, 5.0])]


def test_missing_annotation(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        annotations.find_annotation(spark, str(tmp_path))
    (tmp_path / "b.h5").write_text("")
    (tmp_path / "a.h5").write_text("")
    assert annotations.find_annotation(spark, str(tmp_path)).endswith("a.h5")


def test_clusters_of_variables():
    r = np.eye(4)
    r[0, 2] = r[2, 0] = 0.9
    r[1, 3] = r[3, 1] = -0.8
    merges = factors.average_linkage(r)
    assert [m[:2] for m in merges] == [(0, 2), (1, 3), (4, 5)]
    order = factors.leaf_order(merges, r)
    assert abs(order.index(0) - order.index(2)) == 1 and abs(order.index(1) - order.index(3)) == 1


@pytest.mark.parametrize(("rate", "grid_rate"), [(3.0, 1.0), (2.0, 1.0), (2.5, 2.0), (0.7, 1.0), (4.0, 0.5)])
def test_rates_are_counts_of_words(spark, rate, grid_rate):
    """Counted from a bin's number, and word by word; with ties of rounding."""
    docs = spark.createDataFrame([(i, " ".join(["a"] * i) + "\t ") for i in range(0, 40, 3)] + [(99, None), (98, "  ")], "stim_id long, text string")
    got = {(r.stim_id, r.bin): r.n for r in sources.text_rates(docs, rate, grid_rate).collect()}
    want = {(i, b): sum(round(k / rate * grid_rate) == b for k in range(i)) for i in range(0, 40, 3) for b in range(int(np.floor(i / rate * grid_rate + 1e-9)))}
    assert got == want


def test_words_meet_a_small_lexicon_where_they_are(spark, sf):
    """Words are made once and shuffled by stimulus and bin only."""
    from gridloom.plans.all import QUERIES

    plan = QUERIES["lexical_channels"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [word" in plan and "SortMergeJoin [word" not in plan
    assert plan.count("Scan parquet") == 2 and plan.count("posexplode") == 1

"""The stages one after the other on a small corpus, each against what its own input asks for."""

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import queries, sentencepieces
from gridloom.llm.storage import stage


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, function in corpus_pipeline.STAGES:
        out.append(stage(function(spark, out[-1], sf), name.replace(" ", "-")))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").distinct().collect()}


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns and df.schema == stages[0].schema


def test_quality_keeps_what_the_limits_keep(stages, spark, sf):
    kept = texts(stages[1])
    assert all(not brute.counts(t)[-1] for t in kept.values())
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    passed = {d for d, t in texts(stages[0]).items() if d in good and not brute.counts(t)[-1]}
    assert len(passed - set(kept)) <= 0.02 * len(passed)


def test_lines(stages):
    before = sorted(texts(stages[1]).items())
    lines, want = {}, {}
    for doc, text, _, _ in brute_lines(before):
        want[doc] = text
    lines = texts(stages[2])
    assert lines == want
    assert stages[2].where(F.char_length("text") != F.col("n_chars")).count() == stages[1].where(F.char_length("text") != F.col("n_chars")).count()


def brute_lines(rows):
    """``brute.near_lines`` with a cheap bound before each distance."""
    from collections import Counter

    seen, out, exact = [], [], set()
    for doc, text in rows:
        lines, gone = text.split("\n"), []
        for line in lines:
            near = line in exact
            if len(line) >= 20 and not near:
                c = Counter(line)
                near = any(abs(len(x) - len(line)) <= 2 and sum((c - d).values()) + sum((d - c).values()) <= 4 and brute.edits(x, line) <= 2 for x, d in seen)
                seen.append((line, c))
                exact.add(line)
            gone.append(near)
        out.append((doc, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), sum(gone)))
    return out


def test_one_of_each_class_stays(stages):
    before, kept = texts(stages[2]), texts(stages[3])
    ids = sorted(before)
    prints = [brute.simhash(before[i]) for i in ids]
    points = list(dict.fromkeys(prints))
    root = dict(zip(points, brute.classes(points), strict=True))
    first = {}
    for i, p in zip(ids, prints, strict=True):
        first.setdefault(root[p], i)
    assert set(kept) == set(first.values())


def test_mix(stages):
    rows = stages[3].groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n"), F.max(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("most")).collect()
    want = brute.targets({r.source: r.n for r in rows})
    got = {r.source: r.n for r in stages[4].groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    for r in rows:
        assert abs(got.get(r.source, 0) - want[r.source]) <= r.most
    assert stages[4].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_tokens(stages):
    with open(sentencepieces.MODEL, "rb") as f:
        m = sentencepieces.pieces(f.read())
    rows = texts(stages[4])
    got = stages[5].collect()
    assert len(got) == stages[4].count()
    assert all(list(r.token_ids) == m.encode(rows[r.doc_id]) and r.round_trip for r in got)


def test_run_is_the_stages(stages, spark, sf):
    ids = lambda df: sorted((r.doc_id, tuple(r.token_ids)) for r in df.collect())
    assert ids(corpus_pipeline.run(spark, sf)) == ids(stages[5])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    place = [want.columns.index(c) for c in columns]
    assert sorted(tuple(str(plain(r[c])) for c in columns) for r in df.collect()) == sorted(tuple(str(plain(r[k])) for k in place) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op3_quality", "op4_sentencepiece", "op5_mixing", "op7_sharding", "op9_simhash", "op10_line_dedup"])
def test_queries_give_every_document(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert sorted(r.doc_id for r in df.select("doc_id").collect()) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())

"""Texts of ten megabytes through the operators and the pipeline, beside others."""

import hashlib
import random

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, mixing, sharding
from gridloom.llm.substrings import remove_repeats


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(7)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "straße", "日本", "delta\n"]) + str(rng.randrange(10**5)) for _ in range(900_000))


@pytest.fixture(scope="module")
def documents(spark, long_text):
    rows = [(1, long_text), (2, "short text of a few words"), (3, long_text), (4, None), (5, "x" * 10_000_000)]
    return spark.createDataFrame([(i, t, "en", "a", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_chat(spark, long_text):
    turns = [(1, 0, "user", long_text), (1, 1, "assistant", long_text[::-1]), (1, 2, "user", None), (2, 0, "assistant", "ok")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    n, sha, chars, loss = brute.digest([("user", long_text), ("assistant", long_text[::-1]), ("user", "")])
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (n, sha, chars, loss) and got[2].loss_chars == 2


def test_mixing(documents, long_text):
    rows = {r.doc_id: r for r in mixing.mix(documents).collect()}
    assert rows[1].size == rows[3].size == len(long_text.split()) and rows[5].size == 1 and rows[4].taken == 0
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in rows.values())


def test_sharding(documents, long_text):
    got = sharding.shard_documents(documents).select("doc_id", "shard", "slot", F.sha2(F.col("text").cast("binary"), 256).alias("h")).collect()
    want = hashlib.sha256(long_text.encode()).hexdigest()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 5] and {r.h for r in got if r.doc_id in (1, 3)} == {want}


def test_substrings(documents, long_text):
    got = {r.doc_id: r for r in remove_repeats(documents).select("doc_id", "n_words", "n_removed", F.length("text").alias("n")).collect()}
    n = len(long_text.split())
    assert (got[1].n_words, got[1].n_removed) == (n, 0) and got[3].n_removed == n and got[3].n == 0
    assert got[5].n_removed == 0 and got[4].n_words == 0


def test_pipeline(spark, documents, long_text, tmp_path):
    """The long text is kept with all its pieces, of its copy no more than lines too short to compare; the one of a single word is no document."""
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "round_trip").collect()
    tokens = {r.doc_id: r.n_tokens for r in got}
    assert {1} <= set(tokens) <= {1, 3} and all(r.round_trip for r in got) and tokens[1] > 900_000 and tokens.get(3, 0) < tokens[1] / 2

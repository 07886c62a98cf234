"""Inputs made to defeat hashes, very long texts, names that clash, and many rows of one doc_id."""

import brute
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from gridloom.llm import graphs, quality, sharding, simhash, tokens
from gridloom.llm.lines import banded_distance, dedup_lines, line_keys
from gridloom.llm.substrings import remove_repeats


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


A, B = thue_morse(1024), thue_morse(1024, "ba")  # alike under any polynomial modulo a power of two


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def test_words_that_polynomials_confuse(spark):
    common = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{common} {A}"), (2, f"{common} {B}"), (3, f"{common} {A}"), (4, " ".join((A, B)[i.bit_count() & 1] for i in range(64)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(remove_repeats(docs).collect(), brute.repeats(rows))
    assert [r.n_removed for r in remove_repeats(docs).orderBy("doc_id").collect()][1] == 0


def test_repeated_words_that_polynomials_confuse():
    texts = [f"a b c d {A} x a b c d {B} y", f"a b c d {A} x a b c d {A} y"]
    found = quality.rule_counts(pa.array(texts))
    assert found["n_repeat_words"].tolist() == [brute.counts(t)[4] for t in texts] == [0, 10]


def test_lines_that_polynomials_confuse(spark):
    rows = [(1, A), (2, B), (3, f"{A}\n{B}"), (4, "first\n\n" + A[:-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(docs).collect()], brute.near_lines(rows))


def test_all_lengths_of_lines_can_take_part(spark):
    rows = [(1, "\nab\nab\nxyz"), (2, "ab\n\nthe cat\nxyz"), (3, "the cat\nthe dog that ran\n"), (4, "the dog that ran")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(docs, max_edits=0, min_chars=0).collect()], brute.near_lines(rows, 0, 0))


def test_very_long_lines(spark):
    """Lines of a megabyte, longer than what is hashed at once: equal, near and apart."""
    rng = np.random.default_rng(0)
    x = "".join(rng.choice(list("abcdefgh "), 1 << 20))
    near = x[:500_000] + "!" + x[500_001:900_000] + x[900_001:]
    apart = x[:100] + "!!!" + x[103:]
    edge = x[: (1 << 14) - 1]  # just below what is hashed one by one; a near line just above
    rows = [(1, x), (2, near), (3, apart), (4, x), (5, edge), (6, edge + "z"), (7, "zz" + edge)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in dedup_lines(docs).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 1, 7: 1}


def test_long_pairs_are_compared_whole():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 4, 3000).astype(np.uint32)
    pairs = [(a, a), (a, np.delete(a, [5, 2900])), (a, np.insert(a[:-1], 1500, 9)), (a, np.concatenate([[7, 8, 9], a[3:]]).astype(np.uint32)), (a, a[:40])]
    assert banded_distance([p for p, _ in pairs], [t for _, t in pairs], 2).tolist() == [min(3, brute.edits(p.tolist(), t.tolist())) for p, t in pairs]
    keys, line, own = line_keys(np.concatenate([a, a[1:]]), np.array([0, 3000]), np.array([3000, 2999]), 2, 8)
    assert set(keys[(line == 1) & own]) & set(keys[line == 0])


def test_one_very_long_text():
    """Ten megabytes of one word, one line, and many words through the counts."""
    for text in ("x" * 10_000_000, "word " * 2_000_000):
        c = quality.rule_counts(pa.array([text, "a b"]))
        n = len(text.split())
        assert c["n_words"].tolist() == [n, 2] and c["n_repeat_words"].tolist() == [n if n > 5 else 0, 0]


def test_spans_of_many_sizes():
    rng = np.random.default_rng(2)
    pieces = [bytes(rng.integers(0, 256, int(n)).astype(np.uint8)) for n in rng.integers(0, 50, 300)] + [b"q" * (tokens.SEGMENT + 5), b"", b"end"]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    starts = ends - [len(p) for p in pieces]
    one, two = tokens.span_prints(data, starts, ends)
    assert len(set(zip(one.tolist(), two.tolist(), strict=True))) == len(set(pieces)) == len(set(one.tolist()))
    assert tokens.spans_as_array(data, starts, ends).to_pylist() == pieces


@pytest.mark.parametrize("again", ["n_lines_in", "n_removed_in_in", "SLOT_in"])
def test_names_that_clash(spark, again):
    docs = spark.createDataFrame([(1, "a line that is long enough\nx", 1, 2, 3, 4, 5)], f"doc_id long, text string, n_lines int, n_removed int, shard int, slot int, {again} int")
    once = dedup_lines(docs)
    assert dedup_lines(once).count() == 1 and len(set(dedup_lines(once).columns)) == len(docs.columns) + 4
    sharded = sharding.shard_documents(docs, 2)
    assert sharded.count() == 1 and len({c.lower() for c in sharded.columns}) == len(docs.columns) + 2
    assert sharding.shard_documents(sharded, 2).count() == 1


def test_fingerprints_of_very_long_texts(monkeypatch):
    """Taken in pieces, a text has the fingerprint that it has whole."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["Alpha", "beta", "É", "x1", "the"], n)) for n in (0, 1, 2, 3, 4, 50, 129, 400)]
    want = [brute.simhash(t) for t in texts]
    assert [simhash.simhash(t.encode()) for t in texts] == want
    monkeypatch.setattr(simhash, "LONG", 0)
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert [simhash.simhash(t.encode()) for t in texts] == want


def test_joins_of_hot_keys(spark):
    many = spark.createDataFrame([(5 if i % 3 else i, i) for i in range(3000)], "k long, v long").repartition(4)
    one = many.groupBy("k").agg(F.max("v").alias("top"))
    got = graphs.join_to_one(many, one, "k", 3000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, many.join(one, "k").collect()))

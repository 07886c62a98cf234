"""Operators on documents against plain versions, on odd rows and on none."""

import os
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import licenses, mixing, quality, sentencepieces, sharding
from gridloom.llm.lines import banded_distance, dedup_lines, line_keys
from gridloom.llm.substrings import remove_repeats


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_quality_counts(odd, odd_rows):
    got = quality.judge(odd, None).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], [(r[0], *brute.counts(r[1])) for r in odd_rows])
    assert all(r.kept == (not r.base_failed) for r in got)


def test_quality_of_nothing(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(nothing, labels) is None
    assert quality.judge(nothing, None).count() == 0
    assert quality.keep_good(nothing, None).columns == nothing.columns


def test_quality_on_labels_not_fitted(spark):
    """Held out: fitted on one half of the labelled rows, junk of the other half goes and good text stays."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    forest = quality.fit(docs, labels.where(half))
    again = quality.fit(docs, labels.where(half))
    assert forest.threshold == again.threshold and (forest.cut == again.cut).all()
    rows = quality.judge(docs, forest).where("not base_failed").join(labels.where(~half), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n.get((0, True), 0) <= 0.1 * n[0, False]


def test_quality_verdicts_are_the_forest_s(odd, odd_rows):
    """Path lengths by walking each tree a row at a time."""
    rng = np.random.default_rng(0)
    forest = quality.fit_forest(rng.random((300, 4)), trees=7, sample=64)
    x = quality.features(quality.rule_counts(pa.array([r[1] for r in odd_rows])))

    def path(t, row):
        node = 0
        while (f := forest.feature[t, node]) >= 0:
            node = 2 * node + 1 + int(row[f] >= forest.cut[t, node])
        return forest.path[t, node]

    want = [2 ** (-np.mean([path(t, row) for t in range(7)]) / float(quality._mean_path(64))) for row in x]
    assert forest.scores(x) == pytest.approx(want)
    forest.threshold = float(np.median(want))
    kept = Counter((r.doc_id, r.kept) for r in quality.judge(odd, forest).collect())
    assert kept == Counter((r[0], bool(not brute.counts(r[1])[-1] and s <= forest.threshold)) for r, s in zip(odd_rows, want, strict=True))
    assert quality.keep_good(odd, forest).count() == sum(n for (_, k), n in kept.items() if k)


def test_substrings(odd, odd_rows):
    same(remove_repeats(odd).collect(), brute.repeats(odd_rows))
    same(remove_repeats(odd, part_bytes=300, bucket_windows=40).collect(), brute.repeats(odd_rows))


def test_substrings_of_nothing(nothing):
    assert remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_banded_distance_and_keys(limit):
    rng = np.random.default_rng(limit)
    pairs = []
    for _ in range(600):
        a = rng.integers(0, 4, rng.integers(1, 30)).tolist()
        b = list(a)
        for _ in range(rng.integers(0, 5)):
            i = int(rng.integers(0, len(b) + 1))
            if rng.random() < 0.4:
                b.insert(i, int(rng.integers(0, 4)))
            elif i < len(b) and rng.random() < 0.5:
                b.pop(i)
            elif i < len(b):
                b[i] = int(rng.integers(0, 4))
        pairs.append((np.array(a, np.uint32), np.array(b, np.uint32)))
    want = [min(brute.edits(a.tolist(), b.tolist()), limit + 1) for a, b in pairs]
    assert banded_distance([a for a, _ in pairs], [b for _, b in pairs], limit).tolist() == want
    for (a, b), d in zip(pairs, want, strict=True):
        if d <= limit and min(len(a), len(b)) >= 8:
            keys, line, index = line_keys(np.concatenate([a, b]), np.array([0, len(a)]), np.array([len(a), len(b)]), limit, 8)
            of = lambda n, own: set(keys[(line == n) & (index | (not own))].tolist())
            assert of(0, True) & of(1, False) or of(1, True) & of(0, False)


def test_lines(odd, odd_rows):
    for sizes in ({}, {"part_bytes": 400, "bucket_keys": 20, "block": 3}):
        got = dedup_lines(odd, **sizes)
        assert got.columns == [{"n_lines": "n_lines_in"}.get(c, c) for c in odd.columns] + ["n_lines", "n_removed"]
        same([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()], brute.near_lines(odd_rows))


def test_many_lines_under_one_key(spark):
    """A template with a number: every line shares its segments, few are near; blocks of a key meet each other."""
    rows = [(i, f"the template line that all of them share, with number {i * 7919 % 10007:05d}") for i in range(120)] + [(500 + i, "x" * 30 + str(i)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(docs, block=16).collect()], brute.near_lines(rows))


def test_lines_of_nothing(nothing):
    assert dedup_lines(nothing).count() == 0


def test_licenses(odd, odd_rows):
    got = licenses.scan(odd).collect()
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], [(r[0], *brute.phrases(r[1])) for r in odd_rows])
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_licenses_in_spite_of_changed_words(spark, nothing):
    mit = licenses.TEMPLATES["mit"][1].split(" ")
    rows = [(1, "before " + " ".join([*mit[:8], "put", "in", *mit[8:]]) + " after"), (2, " ".join(mit[:6])), (3, "Released under the MIT License.")]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == "mit" and 0.9 < got[1][1] < 1
    assert got[2][0] == "" and 0 < got[2][1] < 0.8
    assert got[3] == ("mit", 1.0)
    assert licenses.scan(nothing).count() == 0


def test_mixing(odd, odd_rows):
    got = mixing.mix(odd).collect()
    size = lambda t: len(brute.WORD.findall(t or ""))
    total = defaultdict(int)
    for r in odd_rows:
        total[r[3]] += size(r[1])
    want = brute.targets(total)
    same([(r.doc_id, r.source, r.size, r.source_size) for r in got], [(r[0], r[3], size(r[1]), total[r[3]]) for r in odd_rows])
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for source, words in taken.items():
        assert abs(words - want[source]) <= max(r.size for r in got if r.source == source)
    again = mixing.mix(odd.repartition(7)).collect()
    same(got, again)
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert Counter((r.doc_id, r.source, size(r.text)) for r in mixed.collect()) == Counter({k: n for k, n in _sum((r.doc_id, r.source, r.size, r.copies) for r in got).items() if n})


def _sum(rows):
    out = Counter()
    for *k, n in rows:
        out[tuple(k)] += n
    return out


def test_mixing_is_fair(spark):
    """On average a source's documents get the copies that its target asks for."""
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    copies = Counter()
    for seed in range(12):
        for r in mixing.mix(docs, fan_in=8, seed=seed).collect():
            copies[r.source] += r.copies / r.target * r.source_size
    for source in "ab":
        assert copies[source] / (12 * 30) == pytest.approx(1, abs=0.12)


def test_mixing_caps(spark, nothing):
    rows = [(0, "w " * 10, "a"), (1, "w " * 1000, "b"), (2, "", "c")]
    got = {r.source: (r.target, r.taken) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got["a"] == (30.0, 30) and got["b"][0] == pytest.approx(980) and got["c"] == (0.0, 0)
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed_documents(nothing).count() == 0


def test_sharding(odd, odd_rows, nothing, tmp_path):
    out = str(tmp_path / "shards")
    got = sharding.shard_documents(odd, 4, out, bucket_bytes=500).collect()
    data = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.text, r.slot_in, r.shard_in) for r in got) == Counter((r[0], r[1], r[12], r[11]) for r in odd_rows)
    count = Counter(r.shard for r in got)
    assert max(count.values()) - min(count.values()) <= 1 and set(count) == {0, 1, 2, 3}
    for shard, n in count.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    assert sorted(x for x in os.listdir(out) if x.startswith("shard")) == [f"shard={k}" for k in range(4)]
    again = sharding.shard_documents(odd.repartition(5), 4, bucket_bytes=500).collect()
    assert Counter((r.doc_id, zlib.crc32(data(r.text)), r.shard, r.slot) for r in got) == Counter((r.doc_id, zlib.crc32(data(r.text)), r.shard, r.slot) for r in again)
    assert sharding.shard_documents(nothing).count() == 0


def test_pieces_in_chunks():
    with open(sentencepieces.MODEL, "rb") as f:
        m = sentencepieces.pieces(f.read())
    rng = np.random.default_rng(1)
    vocabulary = [p.replace("▁", " ") for p in list(m.rank)[:6000]]
    cases = ["".join(rng.choice(vocabulary, rng.integers(1, 80))) for _ in range(120)]
    cases += ["".join(rng.choice(list("abc de日本😀\n  "), 200)) for _ in range(120)]
    cases += ["a" * 300, " " * 200, "x" * 64, "日本" * 90, " " * 64 + "x", "the" * 90, "=" * 130, ""]
    for text in cases:
        assert sentencepieces.encode_in_chunks(m, text, 64) == m.encode(text), text
        assert m.decode(m.encode(text)) == text
    short = [t for t in cases if len(t) < 60][:20]
    for text in short:
        assert m.ids_of(m.merge(sentencepieces.marked(text))) == m.encode(text)


def test_max_plus_products_are_associative():
    rng = np.random.default_rng(2)
    a, b, c = (np.where(rng.random(s) < 0.6, 0.0, -np.inf) for s in ((2, 3), (3, 4), (4, 2)))
    left, right = sentencepieces.combine(sentencepieces.combine(a, b), c), sentencepieces.combine(a, sentencepieces.combine(b, c))
    assert (left == right).all()


def test_encoding(odd, odd_rows, nothing):
    with open(sentencepieces.MODEL, "rb") as f:
        m = sentencepieces.pieces(f.read())
    for chunk in (1 << 14, 64):
        got = sentencepieces.encode_documents(odd, chunk=chunk).collect()
        same([(r.doc_id, tuple(r.token_ids), r.n_tokens, r.round_trip) for r in got], [(r[0], tuple(i := m.encode(r[1] or "")), len(i), "▁" not in (r[1] or "")) for r in odd_rows])
    assert sentencepieces.encode_documents(nothing).count() == 0

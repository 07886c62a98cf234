"""Near-dedup by Jaccard similarity against all pairs."""

import random

import brute
import corpus_pipeline
import numpy as np
import pytest

from gridloom.llm import similar


def shingles(text):
    w = brute.WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b, percent=80):
    return a == b or 100 * len(a & b) >= percent * len(a | b) > 0


def classes(sets):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and alike(sets[i], sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.fixture(scope="module")
def corpus():
    """Texts with near copies of all degrees, chains, a passage that many share, short texts and exact copies."""
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts, shared = [], say(70)
    for size in (40, 120, 300, 700):
        for changes in (1, 1, 2, 3, 5, 8):
            base = say(size)
            texts.append(base)
            for _ in range(3):
                copy = list(base)
                for _ in range(max(1, changes * size // 100)):
                    copy[rng.randrange(size)] = f"v{rng.randrange(10**6)}"
                texts.append(copy)
    for _ in range(60):
        texts.append(say(30) + shared + say(30))
    chain = say(150)
    for _ in range(40):
        chain = list(chain)
        chain[rng.randrange(150)] = f"u{rng.randrange(10**6)}"
        texts.append(chain)
    texts += [["ONE", "two"], ["one", "two"], ["one", "two", "x"], [], [], texts[0], say(9)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_stage_drops_all_that_is_similar(spark, corpus):
    """With three words and two bits most copies of similarity 0.8 to 0.9 stayed."""
    sets = [shingles(t) for _, t in corpus]
    root = classes(sets)
    assert len(set(root)) < len(set(map(frozenset, sets))) - 60
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, df, "").collect()} == set(root)
    for small, block in ((2, 3), (5, 16)):
        assert {r.doc_id for r in similar.drop_similar(df, small=small, block=block).collect()} == set(root)


def test_one_side_of_candidates_alone(spark, corpus, monkeypatch):
    """Least hashes find every link without the fingerprints; their keys are equal as often as the similarity says."""
    want = set(classes([shingles(t) for _, t in corpus]))
    monkeypatch.setattr(similar, "linked_classes", lambda fps, radius: fps.sparkSession.createDataFrame([], "node long, root long"))
    assert {r.doc_id for r in similar.drop_similar(spark.createDataFrame(corpus, "doc_id long, text string")).collect()} == want
    rng = np.random.default_rng(1)
    shared = 0
    for _ in range(400):  # at a similarity of 0.8, a key of one least hash
        both = np.sort(rng.integers(0, 2**63, 100, dtype=np.uint64))
        keys = similar.band_keys([both[:90], both[10:]], rows=1)
        shared += (keys[0] == keys[1]).mean() / 400
    assert abs(shared - 0.8) < 0.02


def test_odd_rows(spark, odd, odd_rows, nothing):
    kept = similar.drop_similar(odd)
    assert kept.columns == odd.columns
    sets = [shingles(r[1]) for r in odd_rows]
    root = classes(sets)
    got = [root[sets.index(shingles(r.text))] for r in kept.collect()]
    assert sorted(got) == sorted(set(root))
    assert similar.drop_similar(nothing).count() == 0


def test_sets_whose_names_clash(spark):
    """With names of three bits nearly all clash, and the same documents stay."""
    from gridloom.llm.similar import drop_similar

    texts = [f"document {i} speaks of thing {i} and of thing {i + 1} and of nothing else than thing {i + 2}" for i in range(60)]
    df = spark.createDataFrame([(i, texts[i % 60]) for i in range(90)], "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in drop_similar(df, id_bits=3).collect())
    assert kept == sorted(r.doc_id for r in drop_similar(df).collect()) and 0 in kept and 60 not in kept

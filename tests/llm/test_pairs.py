"""Near-duplicates, components, top-k search and chats against plain versions."""

import brute
import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import chat, graphs, simhash, topk


def test_fingerprints_and_classes(odd, odd_rows, nothing):
    got = simhash.near_duplicates(odd).collect()
    prints = [brute.simhash(r[1]) for r in odd_rows]
    points = sorted(set(prints))
    root = dict(zip(points, brute.classes(points), strict=True))
    first = {}
    for r, p in zip(odd_rows, prints, strict=True):
        if r[0] is not None:
            first[root[p]] = min(first.get(root[p], r[0]), r[0])
    want = sorted((str(r[0]), f"{p:016x}", str(first.get(root[p]))) for r, p in zip(odd_rows, prints, strict=True))
    assert sorted((str(r.doc_id), f"{r.fp & (1 << 64) - 1:016x}", str(r.component_id)) for r in got) == want
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(root[brute.simhash(r.text)] for r in kept.collect()) == sorted(set(root.values()))
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.drop_near_duplicates(nothing).count() == 0


def test_every_link_is_found_in_spite_of_splits(spark):
    """Clusters, chains and noise; leaves of a few points, so that most links cross a split."""
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64)
    points = set(seeds.tolist())
    for s in seeds[:20].tolist():
        for _ in range(12):
            points.add(s ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
        chain = s
        for _ in range(8):
            chain ^= 1 << int(rng.integers(64))
            points.add(chain)
    points = sorted(points, key=lambda p: p - (1 << 64) if p >> 63 else p)
    root = brute.classes(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for leaf in (5, 40, 8192):
        got = {r.node: r.root for r in simhash.linked_classes(df, 2, leaf).collect()}
        assert [got.get(p, p) for p in signed] == [signed[r] for r in root]


def test_links_within_a_leaf_with_guests(monkeypatch):
    monkeypatch.setattr(simhash, "BRUTE", 64)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(6), base ^ np.uint64(1 << 40)]))
    classes = simhash.Classes(len(points))
    simhash.link_within(points, np.ones(len(points), bool), 2, classes)
    assert classes.root.tolist() == brute.classes(points.tolist())


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(int(a), int(b)) for a, b in rng.integers(300, 400, (60, 2))] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges if None not in e for n in e}
    for _ in range(200):
        for a, b in edges:
            if None not in (a, b):
                root[a] = root[b] = min(root[a], root[b])
    assert {n: r for n, r in root.items() if n != r} == got


def brute_topk(ids, v, k):
    out = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = v @ v[q]
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out += [(int(ids[q]), rank + 1, int(ids[i]), int(score[i])) for rank, i in enumerate(best)]
    return sorted(out)


def test_topk(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(400, 12)) * rng.integers(1, 30, (400, 1))
    v[::3] = v[0]  # a third of all rows alike
    v[5] = 0
    ids = rng.permutation(1000)[:400]
    rows = [(int(i), x.tolist(), 0) for i, x in zip(ids, v.astype(np.float32), strict=True)]
    odd = [(2000, None, 0), (2020, [1.0, None], 0), (2040, [float("nan")] * 12, 0), (2060, [float("inf")] * 12, 0), (None, [1.0] * 12, 0), (2080, [], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("group", F.lit(1)).withColumn("score", F.lit("x"))
    want = brute_topk(ids, np.floor(64 * v.astype(np.float32).astype(float)).astype(np.int64), 20)
    for sizes in ({}, {"bucket": 32, "block": 5, "seed_vectors": 30, "group_buckets": 2}):
        got = topk.top_k(df, F.col("vec_id") % 20 == 0, **sizes)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect())) == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_topk_prunes():
    """High thresholds: coordinate bounds leave few products, and none that counts is lost."""
    rng = np.random.default_rng(2)
    v = rng.integers(-64, 64, (500, 16))
    v[:30] = rng.integers(-3, 4, (30, 16))
    v[:30, 0] = 150 + np.arange(30)
    order = np.argsort(-(v.astype(float) ** 2).sum(1), kind="stable")
    bucket = topk.Vectors(np.arange(500)[order], v[order])
    best = topk.Best(1, 20)
    query = topk.Vectors(np.array([-1]), np.eye(1, 16, dtype=np.int64) * 61)
    topk.search_bucket(best, query, bucket)
    best2 = topk.Best(1, 20)
    best2.floor[0] = best.floor[0]
    assert topk.search_bucket(best2, query, bucket) < 250
    assert best2.ids[0].tolist() == best.ids[0].tolist()


def test_topk_of_few_and_of_large_components(spark):
    df = spark.createDataFrame([(0, [1e13, -1e13]), (20, [1e13, 1e13]), (1, [1.0, 2.0]), (1, [3.0, 2.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()}
    assert len(got) == 4 and got[0, 20] == 0
    assert got[20, 1] == 64 * 10**13 * (192 + 128)  # of two rows of one id, the better


def test_chats(spark):
    text = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", text), (1, 2, "assistant", None), (2, None, None, None), (2, 5, "assistant", "\\e\\\\h ### "), (2, 5, "assistant", "\\e\\\\h ### "), (None, 0, "a:b\nc", "x\n### y:\n")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"turn {i} <turn " + text * (i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(9)).withColumn("formatted", F.lit("?"))
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(chat.format_conversations(df.repartition(4))).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        want[conv] = (*brute.digest(turns), len(chat.render(turns)), False)
        assert chat.read_back(chat.render(turns)) == turns
    assert got == want
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_spans_of_any_template():
    turns = [("user", "hi"), ("assistant", "a<b"), ("user", "")]
    plain = chat.locate(chat.render, turns)
    assert [plain.text[a:b] for a, b in plain.contents] == [chat.escape(t) for _, t in turns]
    assert "".join(plain.text[a:b] for a, b in plain.turns) == plain.text

    def ending(ts):
        return "<s>" + "".join(f"[{r}]{t};" for r, t in ts) + "<end>"

    moved = chat.locate(ending, turns)
    assert moved.rewritten_at == -1 and [moved.text[a:b] for a, b in moved.contents] == [t for _, t in turns]

    def forgets(ts):  # earlier replies lose their text
        return "".join(f"[{r}]{t if r == 'user' or i == len(ts) - 1 else ''};" for i, (r, t) in enumerate(ts))

    assert chat.locate(forgets, turns).rewritten_at == 2


def test_templates_that_look_back(spark):
    def numbered(ts):
        return "".join(f"{'same' if i and ts[i - 1][0] == r else r}: {t}\n" for i, (r, t) in enumerate(ts))

    rows = [(1, i, "user" if i % 5 else "assistant", f"t{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for back in (1, None):
        parts = chat.format_conversations(df, chat.Template(numbered, back), run=8).orderBy("place").collect()
        assert "".join(p.formatted for p in parts) == numbered([r[2:] for r in rows])
        assert all(p.formatted[a:b] == f"t{i}" for i, (p, (a, b)) in enumerate((p, c) for p in parts for c in p.contents))

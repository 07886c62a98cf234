"""Rounding and sharding against plain versions, with Spark's hash made again; the forest on planted outliers; both sides of a switch."""

import struct
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
import xxhash

from gridloom.llm import mixing, quality, sentencepieces, sharding


def spark_hash(*values):
    """xxhash64 of Spark: ints as (value, 'i'), others by their kind; a null leaves the hash as it is."""
    h = 42
    for v in values:
        if v is None:
            continue
        if isinstance(v, tuple):
            data = struct.pack("<i", v[0])
        elif isinstance(v, int):
            data = struct.pack("<q", v)
        elif isinstance(v, float):
            data = struct.pack("<d", v + 0.0)
        else:
            data = v.encode()
        h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def chance(*values):
    return ((spark_hash(*values) & (1 << 64) - 1) >> 11) / 2.0**53


def rounded(items, seed):
    """Pivotal rounding of (size, doc_id, p) in order: what is settled, as (doc_id, size, 0 or 1), and the one that is open."""
    done, now = [], None
    for size, doc, p in items:
        if now is None:
            now = (doc, size, p)
            continue
        a_doc, a_size, a = now
        up, down = min((1 - a) * a_size, p * size), min(a * a_size, (1 - p) * size)
        rise = chance((seed, "i"), a_doc, doc, a_size, size, a, p) * (up + down) < down
        # the whole of the smaller room of the two moves: to the open one, or from it
        if rise:
            if (1 - a) * a_size <= p * size:
                done.append((a_doc, a_size, 1))
                now = (doc, size, min(max(p - up / size, 0.0), 1.0))
            else:
                done.append((doc, size, 0))
                now = (a_doc, a_size, min(max(a + up / a_size, 0.0), 1.0))
        elif a * a_size <= (1 - p) * size:
            done.append((a_doc, a_size, 0))
            now = (doc, size, min(max(p + down / size, 0.0), 1.0))
        else:
            done.append((doc, size, 1))
            now = (a_doc, a_size, min(max(a - down / a_size, 0.0), 1.0))
    return done, now


def plain_mix(rows, fan_in, seed):
    """(doc_id, source, size, copies) of rows (doc_id, text, source)."""
    sized = [(d, s, len(brute.WORD.findall(t or ""))) for d, t, s in rows]
    total = Counter()
    for _, s, n in sized:
        total[s] += n
    target, out, levels, deepest = brute.targets(total), [], {}, 1
    for source in total:
        own = [r for r in sized if r[1] == source]
        blocks = -(-sum(r[2] > 0 for r in own) // fan_in)
        deepest = max(deepest, blocks)
        held, seen = defaultdict(list), Counter()
        for doc, _, size in own:
            seen[doc, size] += 1
            wanted = target[source] / total[source] if size else 0.0
            base, p = min(int(wanted), 3), wanted - int(wanted)
            if not size or p == 0:
                out.append((doc, source, size, base))
            else:
                held[spark_hash((seed, "i"), doc, (seen[doc, size], "i")) % max(blocks, 1)].append((size, doc, p))
        levels[source] = (held, min(int(target[source] / total[source]), 3) if total[source] else 0)
    for source, (held, base) in levels.items():
        most = deepest
        while True:
            following = defaultdict(list)
            for block, items in held.items():
                done, (doc, size, p) = rounded(sorted(items), seed)
                out += [(d, source, n, base + x) for d, n, x in done]
                if 0 < p < 1:
                    following[block // fan_in].append((size, doc, p))
                else:
                    out.append((doc, source, size, base + (p >= 1)))
            held = following
            if most <= 1:
                break
            most = -(-most // fan_in)
        for items in held.values():
            out += [(doc, source, size, base + (chance((seed, "i"), "last", doc, size, source) < p)) for size, doc, p in items]
    return out


@pytest.mark.parametrize("fan_in", [4, 128])
def test_copies_are_those_of_plain_rounding(spark, fan_in):
    rng = np.random.default_rng(3)
    rows = [(int(i), "w " * int(n), str(s)) for i, n, s in zip(range(300), rng.integers(0, 40, 300), rng.choice(list("abcd"), 300, p=[0.5, 0.3, 0.15, 0.05]), strict=True)]
    rows += [(7, "w " * 5, "a")] * 6  # rows alike
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), fan_in=fan_in, seed=11).collect()
    assert Counter((r.doc_id, r.source, r.size, r.copies) for r in got) == Counter(plain_mix(rows, fan_in, 11))


def test_places_are_those_of_plain_shuffles(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i) if i % 17 else None, "" if i % 11 == 0 else "é" * int(n)) for i, n in enumerate(rng.integers(0, 60, 400))]
    n_shards, size, seed = 5, 700, 9
    total, n_bytes = len(rows), sum(len((t or "").encode()) + 1 for _, t in rows)
    buckets = max(1, -(-n_bytes // size))
    draws = sorted((spark_hash((seed, "i"), d, zlib.crc32(t.encode()), (len(t.encode()), "i")), d, t) for d, t in rows if d is not None)
    draws = sorted([*draws, *((spark_hash((seed, "i"), None, zlib.crc32(t.encode()), (len(t.encode()), "i")), None, t) for d, t in rows if d is None)], key=lambda r: r[0])
    want, at = [], 0
    for bucket in range(buckets):
        own = [r for r in draws if r[0] % buckets == bucket]
        order = np.arange(len(own))
        np.random.default_rng([seed, bucket]).shuffle(order)
        for k, place in enumerate(order):
            shard = (at + k) * n_shards // total
            want.append((own[place][1], own[place][2], shard, at + k - -(-shard * total // n_shards)))
        at += len(own)
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n_shards, bucket_bytes=size, seed=seed).collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in got) == Counter(want)


def test_forest_isolates_outliers():
    """Rows far from all others, in one feature or in several, have the shortest paths; the trees part their samples as they say."""
    rng = np.random.default_rng(5)
    x = rng.normal(0.5, 0.05, (1000, 4)).clip(0, 1)
    odd = rng.normal(0.5, 0.05, (20, 4))
    odd[:10, 0] += 0.6
    odd[10:, 1:3] -= 0.5
    forest = quality.fit_forest(np.concatenate([x, odd]))
    scores = forest.scores(np.concatenate([x, odd]))
    assert scores[1000:].min() > np.quantile(scores[:1000], 0.99)
    again = quality.fit_forest(np.concatenate([x, odd]))
    assert (again.cut == forest.cut).all() and (again.feature == forest.feature).all()
    good = np.arange(1020) < 1000
    forest.threshold = quality.calibrate(scores, good, 0.005)
    assert (scores[:1000] > forest.threshold).mean() <= 0.005 and (scores[1000:] > forest.threshold).all()


def test_both_sides_of_a_chunk(spark):
    """At the default size: texts below a chunk, of one, and of several, all as the library has them."""
    with open(sentencepieces.MODEL, "rb") as f:
        m = sentencepieces.pieces(f.read())
    rng = np.random.default_rng(6)
    words = ["the", "Straße", "日本語", "running", " ", "x1", "\n", "😀", "internationalization"]
    texts = ["".join(w + " " * int(rng.integers(0, 2)) for w in rng.choice(words, 9000)) for _ in range(2)]
    rows = [(10 * k + j, t[:n]) for k, t in enumerate(texts) for j, n in enumerate((16383, 16384, 16385, 40000))] + [(99, "a" * 50_000)]
    got = {r.doc_id: (r.n_chunks, list(r.token_ids)) for r in sentencepieces.encode_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i][1] == m.encode(t) for i, t in rows)
    assert {got[i][0] for i in (0, 10)} == {1} and min(got[i][0] for i in (3, 13, 99)) >= 3

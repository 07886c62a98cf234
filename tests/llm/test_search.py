"""The search prunes, by lengths and by coordinates, and loses nothing; repeated ids agree with the SQL."""

import brute  # noqa: F401
import duckdb
import numpy as np
import pytest

from gridloom.llm import queries, topk


def share_verified(v, k=20, bucket=2048):
    """The share of all products of queries (every 20th row) and rows that is verified, after a check of the results."""
    order = np.argsort(-(v.astype(float) ** 2).sum(1), kind="stable")
    ids, v = np.arange(len(v))[order], v[order]
    asking = topk.Vectors(ids[ids % 20 == 0], v[ids % 20 == 0])
    best = topk.Best(len(asking.ids), k)
    best.floor[:] = topk.floors(asking, topk.Vectors(ids[:1024], v[:1024]), k, True)
    verified = sum(topk.search_bucket(best, asking, topk.Vectors(ids[a : a + bucket], v[a : a + bucket])) for a in range(0, len(v), bucket))
    scores = asking.v @ v.T
    scores[asking.ids[:, None] == ids[None]] = -(1 << 60)
    for q in range(len(asking.ids)):
        want = np.lexsort((ids, -scores[q]))[:k]
        assert best.ids[q].tolist() == ids[want].tolist() and best.score[q].tolist() == scores[q][want].tolist()
    return verified / scores.size


def unit(x):
    return np.floor(64 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)


def test_products_verified(spark):
    """Of unit vectors, without any structure, in clusters and those of the test data; and of vectors of many lengths."""
    rng = np.random.default_rng(0)
    plain = unit(rng.normal(size=(20_000, 64)))
    clusters = unit(rng.normal(size=(100, 64))[rng.integers(0, 100, 20_000)] + 0.3 * rng.normal(size=(20_000, 64)))
    given = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()], float)
    lengths = unit(rng.normal(size=(20_000, 64))) * rng.integers(1, 40, (20_000, 1))
    found = [share_verified(x) for x in (plain, clusters, np.floor(64 * given).astype(np.int64), lengths)]
    assert found[0] < 0.15 and found[1] < 0.1 and found[2] < 0.3 and found[3] < 0.15, found


def test_repeated_ids_as_in_sql(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(i), x.tolist()) for i, x in zip(rng.integers(0, 60, 300), rng.normal(size=(300, 6)), strict=True)]
    rows += [(20, None), (40, [float("nan")] * 6), (None, [1.0] * 6)] + [(7, rows[0][1])] * 40
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    names = ["query_id", "rank", "vec_id", "score"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLES['op1_topk']})").fetchall()
    got = queries.QUERIES["op1_topk"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("top", [100, 30_000, 2**31, 2**62])
def test_packed_vectors_unpack(top):
    rng = np.random.default_rng(2)
    v = rng.integers(-top, top, (5, 3))
    v[0, 0] = -top
    assert (topk._unpack(np.arange(5).tobytes(), topk._narrow(v), 3).v == v).all()

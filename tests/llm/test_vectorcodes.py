"""Codebooks and codes against a plain version in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import vectorcodes


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Rows of (id, code, error) and the digest."""
    kept = sorted(((i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(scale * c) for c in v] for _, v in kept]
    d = len(x[0])
    cut = [k * d // parts for k in range(parts + 1)]
    books = [[v[a:b] for v in x[:entries]] for a, b in zip(cut, cut[1:], strict=False)]
    gap = lambda p, e: sum((s - t) ** 2 for s, t in zip(p, e, strict=True))

    def assign(k):
        return [min(range(len(books[k])), key=lambda e, p=v[cut[k] : cut[k + 1]]: (gap(p, books[k][e]), e)) for v in x]

    for _ in range(rounds):
        for k in range(parts):
            code = assign(k)
            for e in range(len(books[k])):
                mine = [v[cut[k] : cut[k + 1]] for v, c in zip(x, code, strict=True) if c == e]
                if mine:
                    books[k][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    codes = [assign(k) for k in range(parts)]
    out = []
    for j, (i, _) in enumerate(kept):
        out.append((i, "".join(f"{codes[k][j]:02x}" for k in range(parts)), sum(gap(x[j][cut[k] : cut[k + 1]], books[k][codes[k][j]]) for k in range(parts))))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def run(spark, rows, kind="float", **how):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    books = vectorcodes.fit(df, **how)
    return sorted(((r.vec_id, r.code, r.error) for r in vectorcodes.encode(df, books).collect()), key=repr), books.digest()


def test_random_vectors_with_ties_and_repeats(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(-3, 4) / 8 for _ in range(24)]) for i in range(400)]
    rows += [rows[3], rows[3], (rows[3][0], rows[4][1]), (None, rows[5][1]), (None, rows[6][1]), (-5, None), (-4, [None] + [0.0] * 23), (-3, [float("nan")] * 24), (-2, [float("inf")] + [0.0] * 23)]
    want, digest = plain(rows)
    assert run(spark, rows) == (sorted(want, key=repr), digest)


@pytest.mark.parametrize(("n", "dims"), [(5, 16), (1, 8), (40, 11), (40, 3)])
def test_few_vectors_and_widths_that_do_not_divide(spark, n, dims):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dims)]) for i in range(n)]
    want, digest = plain(rows)
    assert run(spark, rows, "double") == (sorted(want, key=repr), digest)


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-50_000, 50_000) for _ in range(16)]) for i in range(60)]
    want, digest = plain(rows)
    assert run(spark, rows, "double") == (sorted(want, key=repr), digest)


def test_other_widths_take_no_part(spark):
    rows = [(0, [0.5] * 8), (1, [0.25] * 8), (2, [0.5] * 7), (3, []), (4, [1e300] * 8)]
    assert [r[0] for r in run(spark, rows, "double")[0]] == [0, 1]


def test_partial_distances_find_the_nearest():
    rng = np.random.default_rng(3)
    part, book = rng.integers(-9, 9, (6, 500)), rng.integers(-9, 9, (16, 6))
    whole = ((part.T[:, None, :] - book[None]) ** 2).sum(2)
    code, best = vectorcodes.nearest(part, book)
    assert (code == whole.argmin(1)).all() and (best == whole.min(1)).all()


def test_no_vectors_and_names_that_clash(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, code string")
    coded = vectorcodes.encode(df, vectorcodes.fit(df))
    assert coded.columns == ["vec_id", "code_in", "code", "error"] and coded.count() == 0
    df = spark.createDataFrame([(1, [0.5] * 8, "mine")], "vec_id long, embedding array<float>, code string")
    assert tuple(vectorcodes.encode(df, vectorcodes.fit(df)).first()) == (1, "mine", "00" * 8, 0)
    assert df.select(F.size("embedding")).first()[0] == 8

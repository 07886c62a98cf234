"""Fill-in-middle against a plain version, near and dealt chunks alike, and its way back."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(df, made):
    rows = made.select("doc_id", "text", *infill.COLUMNS, infill.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text)
        assert r.back == r.text
    return rows


@pytest.mark.parametrize(("chunk", "near"), [(1 << 16, 16), (7, 1 << 20), (5, 0), (64, 2)])
def test_odd_rows(spark, odd, chunk, near):
    rows = check(odd, infill.fill_in_middle(odd, chunk=chunk, near=near))
    assert {"plain", "spm"} <= {r.form for r in rows}


@pytest.mark.parametrize("near", [0, 1 << 20])
def test_random_texts(spark, near):
    """Every kind of space, chunk edges within characters, sentinels, and many doc_ids."""
    rng = random.Random(5)
    some = ["a", "b", " ", "  ", "\n", "\t\r", "\x0b", "\x0c", "\x1c", "\xa0", "é", "日本", "😀", "word"]
    rows = [(i, "".join(rng.choice(some) for _ in range(rng.randrange(30)))) for i in range(-300, 900)] + [(i, f"x <{'PSM'[i % 3]}> y") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.form for r in check(df, infill.fill_in_middle(df, chunk=4, near=near))} == {"plain", "spm", "psm"}


def test_texts_of_ten_megabytes(spark):
    text = "ein Wort, noch ein Wörtchen\n" * 350_000
    df = spark.createDataFrame([(i, text) for i in range(6)] + [(3, text), (7, "x" * 10_000_000), (8, " " * 2_000_000)], "doc_id long, text string").repartition(3)
    made = infill.fill_in_middle(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.xxhash64("output").alias("x"), (infill.restore(F.col("output"), F.col("form")) == F.col("text")).alias("same"))
    rows = made.collect()
    assert len(rows) == 9 and all(r.same for r in rows) and len({tuple(r) for r in rows if r.doc_id == 3}) == 1
    for r in rows:
        if r.doc_id in (0, 1, 3):
            assert (r.n, r.form, r.prefix_chars, r.middle_chars) == plain(r.doc_id, text)[:4]


def test_names_that_clash_and_no_rows(spark, nothing):
    df = spark.createDataFrame([(0, "a b c", 5, "f", "o")], "doc_id long, text string, N long, form string, output string")
    made = infill.fill_in_middle(df)
    assert made.columns == ["doc_id", "text", "N_in", "form_in", "output_in", *infill.COLUMNS]
    assert made.first()[:5] == (0, "a b c", 5, "f", "o")
    assert infill.fill_in_middle(nothing).count() == 0

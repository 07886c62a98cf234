"""Parts: in order, even, and split where one doc_id has most rows."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from gridloom.llm import parts
from gridloom.llm.lines import dedup_lines
from gridloom.llm.substrings import remove_repeats


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


@pytest.mark.parametrize("hot", [None, 7])
def test_many_rows_of_one_id(spark, hot):
    """100,000 rows of one doc_id, half of them equal: no part holds many, and the order is that of ids and texts."""
    rng = random.Random(1)
    rows = [(hot, None if i % 2 else f"text {rng.randrange(10**6)}") for i in range(100_000)] + [(i, f"row {i} " * 20) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    plan = parts.plan_parts(df, "doc_id", "text", 1 << 14)
    got = df.select(plan.part.alias("part"), F.coalesce("doc_id", F.lit(1 << 40)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).cache()
    sizes = [r["count"] for r in got.groupBy("part").count().collect()]
    assert max(sizes) < 20_000 and len(sizes) > 40 and got.agg(F.max("part")).first()[0] < plan.count
    ends = got.groupBy("part").agg(F.min(F.struct("id", "text")).alias("a"), F.max(F.struct("id", "text")).alias("z")).orderBy("part").collect()
    assert all(x.z <= y.a for x, y in zip(ends, ends[1:], strict=False))


def test_fine_parts_are_in_order(spark, monkeypatch):
    """More parts than quantiles: ranges of ids are divided evenly."""
    monkeypatch.setattr(parts, "SPLITS", 16)
    df = spark.createDataFrame([(i * i, "x" * 99) for i in range(-500, 1500)], "doc_id long, text string")
    plan = parts.plan_parts(df, "doc_id", "text", 1000)
    got = df.select("doc_id", plan.part.alias("part")).distinct().orderBy("doc_id").collect()
    numbers = [r.part for r in got]
    assert numbers == sorted(numbers) and len(set(numbers)) > 100 and max(numbers) < plan.count and min(numbers) >= 0


@pytest.mark.parametrize("hot", [None, 3])
def test_operators_on_one_hot_id(spark, hot):
    rng = random.Random(2)
    phrase = [" ".join(f"w{rng.randrange(50)}" for _ in range(25)) for _ in range(12)]
    rows = [(hot, f"line {i} {rng.choice(phrase)}\n{rng.choice(phrase)} tail {i % 7}") for i in range(120)]
    rows += [(hot, None)] * 40 + [(hot, rows[0][1])] * 20 + [(i, f"{phrase[i % 12]} and {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(remove_repeats(df, part_bytes=2000, bucket_windows=200).collect(), brute.repeats(rows))
    same([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(df, part_bytes=2000, bucket_keys=200).collect()], brute.near_lines(rows))


def test_short_repeats_of_lines(spark):
    rows = [(1, "yes\n\nno\nyes"), (2, "no\n  \n\nNo\n-"), (3, "-\na line that is long enough\n  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(df, short_repeats=True).collect()}
    assert got == {1: ("yes\n\nno", 1), 2: ("  \n\nNo\n-", 1), 3: ("a line that is long enough\n  ", 1)}


def in_order(df, plan):
    got = df.select(plan.part.alias("part"), F.coalesce("doc_id", F.lit(1 << 40)).alias("id"), F.coalesce("text", F.lit("")).alias("text"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("w")).cache()
    ends = got.groupBy("part").agg(F.min(F.struct("id", "text")).alias("a"), F.max(F.struct("id", "text")).alias("z"), F.sum("w").alias("w")).orderBy("part").collect()
    assert all(x.z <= y.a for x, y in zip(ends, ends[1:], strict=False)) and 0 <= ends[0].part and ends[-1].part < plan.count
    return [r.w for r in ends]


def test_thousands_of_heavy_ids(spark):
    """5,000 ids of more than a part each: the plan stays as it is, and no part is above twice the size asked."""
    rows = spark.range(5000 * 6).select((F.col("id") % 5000 * 7).alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(" text " * 20)).alias("text"))
    light = spark.range(3000).select((F.col("id") * 11 + 3).alias("doc_id"), F.lit("light").alias("text"))
    df = rows.unionByName(light).repartition(8)
    plan = parts.plan_parts(df, "doc_id", "text", 600)
    weights = in_order(df, plan)
    assert max(weights) <= 1200 and len(weights) > 5000


def test_texts_that_begin_alike(spark):
    """10,000 different texts of no id that share 1,000 characters, behind others that share more: no part is above twice the size asked."""
    head, other = "the same heading " * 60, "another page " * 300
    rows = [(None, f"{head}{i * 7919 % 10007}") for i in range(10_000)] + [(None, f"{other}{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert max(in_order(df, parts.plan_parts(df, "doc_id", "text", 1 << 18))) <= 1 << 19


def test_operators_on_many_heavy_ids(spark):
    """600 ids of three rows and more than a part each, which alike begin."""
    rng = random.Random(3)
    phrase = [" ".join(f"w{rng.randrange(50)}" for _ in range(25)) for _ in range(300)]
    rows = [(i % 600, f"{'the same heading of a site ' * 4}{rng.choice(phrase)}\n{rng.choice(phrase)} tail {i % 7}") for i in range(1800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(remove_repeats(df, part_bytes=1000).collect(), brute.repeats(rows))

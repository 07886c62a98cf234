"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each document of a source is wanted target / size times, a number with a whole part, which it gets, and a fraction.
The fractions are settled in pairs: words of expected copies move from one document of the pair to the other, in one
direction or the other at random so that nothing changes on average, until one of the fractions is 0 or 1. That
document is settled; the other meets the next one. A source's expected words never change, so what it takes misses its
target by less than one document. Pairs are met in blocks of bounded size; the one fraction each block leaves goes up
a reduction tree, whose next level holds 1 / ``fan_in`` as many rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import word_count
from gridloom.llm.storage import stage

WORD = r"[^\x20\x09-\x0D]"
WEIGHTS = (5, 2, 1)  # of the sources in order, over and over
MOST = 3  # times its own size that a source may be taken

SETTLED = "array<struct<doc_id:bigint,size:bigint,extra:int>>"
STATE = f"struct<doc_id:bigint,size:bigint,p:double,open:boolean,done:{SETTLED}>"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Of (source, size) rows: source, source_size, n (rows with words), target.

    Sources in the order of their code points, null last, weigh ``weights`` over and over. All words are shared out by
    weight; a source stops at ``most`` times its own words, and the excess is shared again until none is above.
    """
    spark = sizes.sparkSession
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    sort_key = F.struct(F.col("source").isNull().alias("last"), "source")
    row = F.monotonically_increasing_id()
    found = stage(found.repartitionByRange(sort_key).sortWithinPartitions(sort_key).select("*", F.shiftright(row, 33).alias("part"), row.bitwiseAND((1 << 33) - 1).alias("at")), "sources")
    # one row for each partition of the sorted sources: how many sources stand before it
    parts = found.groupBy("part").agg(F.count("*").alias("rows"))
    starts = parts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("at") + F.col("before"), F.lit(len(weights))) + 1).cast("int")).cast("long")
    found = stage(found.join(starts, "part").select("source", "source_size", "n", weight.alias("weight")), "weights")
    words = found.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") > most * F.col("source_size")
        stopped, taken, free = found.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if stopped == capped:
            break
        capped, level = stopped, (words - most * taken) / free if free else level
    share = F.when(full, (most * F.col("source_size")).cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return found.select("source", "source_size", "n", share.alias("target"))


def _chance(*of: Column) -> Column:
    """A number in [0, 1) that depends on nothing but its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def _meet(seed: int):
    """The fold that settles one of the open document and the next one."""

    def settled(doc: Column, size: Column, extra: Column) -> Column:
        return F.array(F.struct(doc.alias("doc_id"), size.alias("size"), extra.cast("int").alias("extra"))).cast(SETTLED)

    def state(doc: Column, size: Column, p: Column, is_open: Column, done: Column) -> Column:
        return F.struct(doc.alias("doc_id"), size.alias("size"), p.alias("p"), is_open.alias("open"), done.alias("done")).cast(STATE)

    def merge(s: Column, x: Column) -> Column:
        a, b, size_a, size_b = s["p"], x["p"], s["size"].cast("double"), x["size"].cast("double")
        up, down = F.least((1 - a) * size_a, b * size_b), F.least(a * size_a, (1 - b) * size_b)
        rise = _chance(F.lit(seed), s["doc_id"], x["doc_id"], s["size"], x["size"], a, b) * (up + down) < down
        # words move to the open document (rise) or from it; which of the two becomes whole follows from the lesser bound
        whole_a = F.when(rise, (1 - a) * size_a <= b * size_b).otherwise(a * size_a <= (1 - b) * size_b)
        rest_b = F.when(rise, b - up / size_b).otherwise(b + down / size_b)
        rest_a = F.when(rise, a + up / size_a).otherwise(a - down / size_a)
        next_a = state(x["doc_id"], x["size"], F.least(F.greatest(rest_b, F.lit(0.0)), F.lit(1.0)), F.lit(True), F.concat(s["done"], settled(s["doc_id"], s["size"], rise)))
        next_b = state(s["doc_id"], s["size"], F.least(F.greatest(rest_a, F.lit(0.0)), F.lit(1.0)), F.lit(True), F.concat(s["done"], settled(x["doc_id"], x["size"], ~rise)))
        first = state(x["doc_id"], x["size"], x["p"], F.lit(True), s["done"])
        return F.when(~s["open"], first).when(whole_a, next_a).otherwise(next_b)

    return merge


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, fan_in: int = 128, seed: int = 5) -> DataFrame:
    """How many times the mix takes each row of ``docs`` (doc_id, source, text; other columns are not read).

    Returns doc_id, source, size (words), source_size, target (the source's), copies (0 to ``most``), taken (copies
    times size), one row for each row of ``docs``. The result depends on the rows alone, not on their order or
    partitions. A null or empty text has no words: no copies. A null source is a source of its own, the last. Rows alike
    in doc_id, source and size are told apart by a number; a null doc_id is a value like others. An empty table gives an
    empty table.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(word_count(F.col("text"), WORD), F.lit(0)).cast("long").alias("size"))
    sized = stage(sized, "sizes")
    targets = stage(source_targets(sized, weights, most), "targets")
    alike = sized.groupBy("doc_id", "source", "size").count()
    rows = alike.join(targets, alike.source.eqNullSafe(targets.source)).drop(targets.source)
    rows = rows.withColumn("alike", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
    wanted = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.ceil(F.col("n") / F.lit(fan_in))
    rows = rows.select(
        "doc_id", "source", "size", "source_size", "target", F.least(F.floor(wanted), F.lit(most)).cast("int").alias("base"), (wanted - F.floor(wanted)).alias("p"), "n",
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "alike"), F.greatest(blocks, F.lit(1))).alias("block"),
    )
    rows = stage(rows, "wanted")
    keep = ["source", "source_size", "target", "base"]
    whole = rows.where("size = 0 or p = 0").select("doc_id", "size", *keep, F.lit(0).alias("extra"))
    out, now = [whole], rows.where("size > 0 and p > 0").select("doc_id", "size", "p", "block", *keep)
    most_blocks = targets.agg(F.coalesce(F.max(blocks), F.lit(1))).first()[0]
    while True:
        # hashed blocks hold fan_in rows on average and never many more; a row is three numbers
        held = now.groupBy(*keep, "block").agg(F.array_sort(F.collect_list(F.struct("size", "doc_id", "p"))).alias("items"))
        start = F.struct(F.lit(0).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("p"), F.lit(False).alias("open"), F.array().cast(SETTLED).alias("done")).cast(STATE)
        folded = stage(held.select(*keep, "block", F.aggregate("items", start, _meet(seed)).alias("s")), "rounded")
        out.append(folded.select(F.explode("s.done").alias("d"), *keep).select("d.doc_id", "d.size", *keep, "d.extra"))
        left = folded.select("s.doc_id", "s.size", "s.p", F.floor(F.col("block") / F.lit(fan_in)).alias("block"), *keep)
        out.append(left.where("p <= 0 or p >= 1").select("doc_id", "size", *keep, (F.col("p") >= 1).cast("int").alias("extra")))
        now = left.where("p > 0 and p < 1")
        if most_blocks <= 1:
            break
        most_blocks = -(-most_blocks // fan_in)
    last = _chance(F.lit(seed), F.lit("last"), "doc_id", "size", "source") < F.col("p")
    out.append(now.select("doc_id", "size", *keep, last.cast("int").alias("extra")))
    copies = F.col("base") + F.col("extra")
    return reduce(DataFrame.unionByName, out).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, with all their columns.

    Rows alike in doc_id, source and size are numbered by their texts, and the first get the larger numbers of copies.
    """
    taken = mix(docs, weights, most).groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("__mix_copies"))
    taken = stage(taken.select(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_size"), "__mix_copies").where(F.exists("__mix_copies", lambda x: x > 0)), "copies")
    found = docs.withColumn("__mix_words", F.coalesce(word_count(F.col("text"), WORD), F.lit(0)).cast("long")).withColumn("__mix_number", F.lit(1))
    if taken.where(F.size("__mix_copies") > 1).limit(1).count():
        alike = Window.partitionBy("doc_id", "source", "__mix_words").orderBy("text")
        found = found.withColumn("__mix_number", F.row_number().over(alike))
    same = found["doc_id"].eqNullSafe(taken["__mix_id"]) & found["source"].eqNullSafe(taken["__mix_source"]) & (found["__mix_words"] == taken["__mix_size"])
    times = F.col("__mix_copies")[F.col("__mix_number") - 1]
    joined = found.join(taken.hint("merge"), same).withColumn("__mix_times", times).where("__mix_times > 0")
    return joined.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), "__mix_times"))).select(*[found[c] for c in docs.columns])

"""Parts of a table in the order of its integer ids and texts, decided by the data alone.

A part is a pure function of a row and of bounds computed once, so two passes over one table, or a recomputed task,
always put a row into the same part. Parts follow each other in the order of the ids, null last; an id whose rows are
more than a part holds has parts of its own, cut in the order of its texts, and equal texts of one id are spread by
the places of their rows, which are interchangeable.

Bounds are a few sorted arrays in the plan, of bounded size and as many for any number of heavy ids: ids at which parts
begin, heavy ids, and the cuts of all of them end to end. A cut is the shortest beginning that tells a text from the one
before it in the sample, so texts that begin alike are told apart behind what they share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = 4096  # bounds by id at the most; finer parts divide a split's range of ids evenly
SAMPLED = 200_000  # rows, about, that bounds by id are taken from; they only decide how even the parts are
HEAVY = 1 << 15  # heavy ids at the most
CUTS = 1 << 16  # cuts of all of them, about
PER_PART = 32  # rows sampled of a heavy id for each of its parts
PER_ID = 1 << 14  # and of the id at the most
SAMPLE_BYTES = 1 << 26  # bytes of texts sampled of one id
BEGINNING = 1 << 16  # bytes of a text looked at, fewer where many are sampled
CUT_BYTES = 1 << 24  # bytes of all cuts


@dataclass
class Parts:
    """How many parts there are, what the table weighs, and the part of a row."""

    count: int
    total: int
    part: Column


def _array(values: list, kind: str) -> Column:
    """An array as one literal, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _count(array: Column, begin: Column, size: Column, step: Column, below) -> Column:
    """How many of the ``size`` sorted elements behind ``begin`` hold for ``below``, found among every ``step``-th and then between two of these."""
    mine = F.slice(array, begin + 1, size)
    coarse = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.floor(size / step).cast("int") - 1), lambda k: F.get(mine, (k + 1) * step - 1)), below)) * step
    coarse = F.when(size >= step, coarse).otherwise(F.lit(0))
    return coarse + F.size(F.filter(F.slice(mine, coarse + 1, step), below))


def _below(bounds: list[int], x: Column) -> Column:
    """The number of bounds at or below x."""
    if not bounds:
        return F.lit(0)
    step = max(64, int(len(bounds) ** 0.5))
    below = lambda a: F.size(F.filter(a, lambda b: b <= x))
    first = below(_array(bounds[step - 1 :: step], "bigint")) if len(bounds) >= step else F.lit(0)
    return first * step + below(F.slice(_array(bounds, "bigint"), first * step + 1, F.lit(step)))


def _at(values: list[int], place: Column) -> Column:
    return F.get(_array(values, "bigint"), place).cast("int")


def choose_cuts(texts: list[bytes], weights: np.ndarray, n: int, whole: int) -> list[bytes]:
    """Beginnings at which ``n`` parts of sorted texts of like weight start, but for the first part; texts of ``whole`` bytes may go on beyond."""
    running = np.cumsum(weights)
    at = np.searchsorted(running, running[-1] * np.arange(1, n) / n)
    cuts = []
    for k in at:
        text, before = texts[k], texts[k - 1] if k else b""
        if text == before:
            cuts.append(text)
            continue
        a, b = (np.frombuffer(t[: min(len(text), len(before))], np.uint8) for t in (text, before))
        apart = np.flatnonzero(a != b)
        cuts.append(text[: (int(apart[0]) if len(apart) else len(a)) + 1])
    return cuts


def _heavy_cuts(rows: DataFrame, heavy: list[tuple[int | None, int, int]], cut_weight: int) -> dict[int | None, list[str]]:
    """For each heavy id (with its weight and rows) the cuts of its parts, as hexadecimal digits, whose order is that of bytes."""
    names = [i for i, *_ in heavy if i is not None]
    n_parts = {i: -(-w // cut_weight) for i, w, _ in heavy}
    sampled = {i: min(PER_PART * n_parts[i], PER_ID) for i in n_parts}
    rate = {i: min(1 << 30, -(-sampled[i] * (1 << 30) // n)) for i, _, n in heavy}
    bytes_of = {i: int(min(BEGINNING, max(4096, SAMPLE_BYTES // k))) for i, k in sampled.items()}
    place = F.when(F.col("id").isNull(), F.lit(len(names))).otherwise(_below(names, F.col("id")) - 1)
    known = [*names, *([None] if None in n_parts else [])]
    mine = F.when(F.col("id").isNull(), F.lit(None in n_parts)).otherwise((place >= 0) & (_at_long(names, place) == F.col("id")))
    draw = F.pmod(F.xxhash64(F.lit(23), F.monotonically_increasing_id()), F.lit(1 << 30))
    some = rows.withColumn("draw", draw).withColumn("mine", mine).where("mine").withColumn("place", place.cast("int"))
    some = some.where(F.col("draw") < _at([rate[i] for i in known], F.col("place")))
    some = some.select("place", F.substring("text", F.lit(1), _at([bytes_of[i] for i in known], F.col("place"))).alias("b"), "weight")

    def cut(key: tuple, table: pa.Table) -> pa.Table:
        i = known[key[0].as_py()]
        table = table.sort_by("b")
        found = choose_cuts(table["b"].to_pylist(), table["weight"].to_numpy(), n_parts[i], bytes_of[i])
        return pa.table({"place": pa.array([key[0].as_py()] * len(found), pa.int32()), "cut": pa.array([c.hex().upper() for c in found], pa.string())})

    found: dict[int | None, list[str]] = {}
    cuts = some.groupBy("place").applyInArrow(cut, "place int, cut string").toArrow()
    for p, c in zip(cuts["place"].to_pylist(), cuts["cut"].to_pylist(), strict=True):
        found.setdefault(known[p], []).append(c)
    while sum(len(c) for cut in found.values() for c in cut) > 2 * CUT_BYTES:  # half of the cuts makes parts of twice the size
        found = {i: kept for i, cut in found.items() if (kept := sorted(cut)[1::2])}
    return {i: sorted(c) for i, c in found.items()}


def _at_long(values: list[int], place: Column) -> Column:
    return F.get(_array(values, "bigint"), place)


def plan_parts(df: DataFrame, id_col: str, text_col: str, part_weight: int, least_weight: int = 1 << 16, weight: Column | None = None) -> Parts:
    """Parts of about ``part_weight`` bytes of text (or of ``weight``) each.

    A small table is cut finer, to give each shuffle partition a part, but not below ``least_weight``. The driver sees a
    bounded sample of ids, at most 32,768 ids of more weight than a part (in a larger table: of more than its 32,768th
    part) that have several rows, and their cuts. Texts of one id that agree in their first 4,096 bytes or more (65,536
    where the id has few parts) and are not equal share a part.
    """
    spark = df.sparkSession
    weight = F.coalesce(F.octet_length(text_col), F.lit(0)) + 1 if weight is None else weight
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), weight.cast("long").alias("weight"))
    per_id = rows.groupBy("id").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    over = lambda least: (F.col("w") > least) & (F.col("n") > 1)
    total, n_rows, top, n_heavy = per_id.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.max("id"), F.count_if(over(part_weight))).first()
    total = int(total)
    heavy, cuts = [], {}
    if n_heavy:
        heavy = sorted(((r.id, int(r.w), int(r.n)) for r in per_id.where(over(max(part_weight, total // HEAVY))).collect()), key=lambda h: (h[0] is None, h[0] or 0))
        cuts = _heavy_cuts(rows, heavy, max(part_weight, total // CUTS)) if heavy else {}
    named = [i for i, *_ in heavy if i is not None]
    light = total - sum(w for _, w, _ in heavy)
    n = max(1, -(-light // part_weight), min(int(spark.conf.get("spark.sql.shuffle.partitions")), light // least_weight))
    x, bounds, each = F.col(id_col), [], 1
    if n > 1:
        some = rows.where(F.pmod(F.xxhash64(F.lit(17), F.monotonically_increasing_id()), F.lit(max(1, n_rows // SAMPLED))) == 0).where(F.col("id").isNotNull()).select("id", "weight").toArrow()
        ids, weights = some["id"].to_numpy().astype(np.int64), some["weight"].to_numpy()
        kept = ~np.isin(ids, named)
        order = np.argsort(ids[kept], kind="stable")
        ids, running = ids[kept][order], np.cumsum(weights[kept][order])
        if len(ids):
            k = min(n, SPLITS)
            each = -(-n // SPLITS)
            bounds = np.unique(ids[np.searchsorted(running, running[-1] * np.arange(1, k) / k)]).tolist()
    part, count = _below(bounds, x), len(bounds) + 1
    if each > 1 and bounds:
        split = part
        edges = [*bounds, max(top, bounds[-1]) + 1]
        low, high = _at_long(edges, F.greatest(split - 1, F.lit(0))), _at_long(edges, split)
        fine = F.floor((x - low).cast("double") * each / F.greatest(high - low, F.lit(1)).cast("double")).cast("int")
        part = F.when(split > 0, 1 + (split - 1) * each + F.least(fine, F.lit(each - 1))).otherwise(F.lit(0))
        count = 1 + len(bounds) * each
    part = F.when(x.isNull(), F.lit(count - 1)).otherwise(part)
    if heavy:
        per = [len(cuts.get(i, [])) for i, *_ in heavy]
        begins = np.cumsum([0, *per]).tolist()
        shifts = np.cumsum([0, *(k + 2 for k in per)]).tolist()
        place = F.when(x.isNull(), F.lit(len(named))).otherwise(_below(named, x))  # heavy ids at or below
        mine = F.when(x.isNull(), F.lit(len(heavy) > len(named))).otherwise((place > 0) & (_at_long(named, place - 1) == x)) if named else F.when(x.isNull(), F.lit(True)).otherwise(F.lit(False))
        at = F.when(x.isNull(), F.lit(len(named))).otherwise(F.greatest(place - 1, F.lit(0)))
        flat = [c for i, *_ in heavy for c in cuts.get(i, [])]
        longest = max(map(len, flat), default=0) // 2
        key = F.hex(F.substring(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), 1, longest + 1))
        array, size = _array(flat, "string"), _at(per, at)
        step = F.greatest(F.lit(64), F.floor(F.sqrt(size.cast("double"))).cast("int"))
        less = _count(array, _at(begins, at), size, step, lambda c: c < key)
        upto = _count(array, _at(begins, at), size, step, lambda c: c <= key)
        spread = F.pmod(F.xxhash64(F.lit(29), F.monotonically_increasing_id()), F.lit(1 << 30))
        whole = F.coalesce(F.octet_length(text_col), F.lit(0)) <= longest
        own = F.when(whole, less + F.pmod(spread, (upto - less + 1).cast("long")).cast("int")).otherwise(upto)
        part = part + F.when(mine, _at(shifts, at) + 1 + (own if flat else F.lit(0))).otherwise(_at(shifts, place))
        count += shifts[-1]
    return Parts(count, total, part.cast("int"))


def grown(size: int, total: int, most: int, unit: int = 1 << 40) -> int:
    """A size that grows with a table beyond ``unit`` bytes, ``most`` times at most, so that what is sent per pair of parts stays worth sending."""
    return size * max(1, min(most, total // unit))

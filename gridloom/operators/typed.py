"""Channels of every kind on the grid, in one pass over typed samples.

A sample (stim_id, path, start, end, v, vec, code, label) is a point in time, where end is null, or holds over a span. Its
channel's template says what it is (dtype) and how the samples of a bin become one (resample):

mean, any (the largest), count (how many numbers), nearest (to the bin's centre, of equals the earliest), step (the last),
mode (the most frequent, of equals the least), concat (labels in order of time) and vlm (the last to begin). A vector's
components are each a mean.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalars import clean_nan
from gridloom.operators import grid as G
from gridloom.shared import staged

FIELDS = {"start": "double", "end": "double", "v": "double", "vec": "array<double>", "code": "int", "label": "string"}
COLUMNS = ["stim_id", "path", *FIELDS]
MOST_CHANNELS = 20_000
#: Bins that are cut into pieces together; a piece knows the ends of its stretch's samples, so they are few.
STRETCH = 128


def sample(rows: DataFrame, path: str, start: Column | str = "start", **fields: Column) -> DataFrame:
    """Samples of one channel from rows with stim_id and a time; ``fields`` are end, v, vec, code or label."""
    at = F.col(start) if isinstance(start, str) else start
    return rows.select("stim_id", F.lit(path).alias("path"), *(fields.get(c, at if c == "start" else F.lit(None)).cast(kind).alias(c) for c, kind in FIELDS.items()))


def scalars_of(rows: DataFrame, prefix: str, names: dict[str, str] | list[str], start: str = "start", end: str | None = None) -> DataFrame:
    """Samples of several numbers of a row, each a channel ``prefix``/name; ``names`` may say which column is which channel."""
    names = names if isinstance(names, dict) else {c: c for c in names}
    pairs = F.explode(F.array(*(F.struct(F.lit(f"{prefix}/{leaf}" if prefix else leaf).alias("path"), F.col(c).cast("double").alias("v")) for c, leaf in names.items())))
    long = rows.select("stim_id", F.col(start).alias("start"), (F.col(end) if end else F.lit(None)).cast("double").alias("end"), pairs.alias("p"))
    return long.select("stim_id", "p.path", "start", "end", "p.v", *(F.lit(None).cast(FIELDS[c]).alias(c) for c in ("vec", "code", "label")))


def together(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _kinds(template: DataFrame) -> list[tuple[str, str, str]]:
    """Path, dtype and resample of each channel; a template is a short list, of some hundred channels."""
    kinds = [tuple(r) for r in template.select("path", "dtype", "resample").limit(MOST_CHANNELS + 1).collect()]
    if len(kinds) > MOST_CHANNELS:
        raise ValueError(f"a template of more than {MOST_CHANNELS} channels")
    return kinds


def _way(dtype: str, how: str) -> str:
    """How the samples of such a channel become one; empty where nothing is made of them."""
    if dtype in ("vector", "categorical"):
        return dtype
    if dtype in ("scalar", "bool", "event"):
        return how if how in ("nearest", "mode") else "last" if how in ("step", "vlm") else "number"
    if dtype == "label":
        return how if how in ("concat", "mode") else "last"
    return ""


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of which much will come, over as many tasks as a shuffle has; by their own bytes Spark would put them into a few."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _cut(rows: DataFrame) -> DataFrame:
    """Rows (stim_id, channel, low, high, ...) in pieces (bin, till): runs of bins in which the same rows hold, so what is made of a run holds for each of its bins.

    A stretch of STRETCH bins is cut by itself, at the first bins of rows and those behind their last ones, of which it has
    STRETCH + 1 at the most, however many rows; where a row is alone its bins are one piece.
    """
    chunk = F.explode(F.sequence(F.expr(f"low div {STRETCH}"), F.expr(f"high div {STRETCH}")))
    parts = rows.withColumn("chunk", chunk).withColumn("low", F.greatest("low", F.col("chunk") * STRETCH).cast("int")).withColumn("high", F.least("high", F.col("chunk") * STRETCH + (STRETCH - 1)).cast("int"))
    keys = ["stim_id", "channel", "chunk"]
    ends = parts.groupBy(*keys).agg(F.array_sort(F.array_union(F.collect_set("low"), F.collect_set(F.col("high") + 1))).alias("ends"))
    runs = F.transform(F.slice("ends", F.lit(1), F.size("ends") - 1), lambda b, i: F.struct(b.alias("bin"), (F.get("ends", i + 1) - 1).alias("till")))
    held = parts.join(ends.select(*keys, runs.alias("runs")), keys)
    run = F.explode(F.filter("runs", lambda r: (r["bin"] >= F.col("low")) & (r["bin"] <= F.col("high"))))
    return held.withColumn("run", run).select(*[c for c in rows.columns if c not in ("low", "high")], "run.bin", "run.till")


def _reduced(samples: DataFrame, kinds: list[tuple[int, str, str, str]], way: str, stimuli: DataFrame, rate: float, every: DataFrame | None = None) -> DataFrame:
    """(stim_id, channel, bin, num, vec, code, label) of the bins that have samples, of the channels (channel, path, dtype, resample), all of one way.

    The stimuli are the side of the join that may be sent to all, never the samples, which files hold in far fewer bytes
    than memory does. Components of vectors are means before they meet, so a bin with many samples is no heavier than others.
    With ``every`` (stim_id, channel, low, high), the bins there are, samples are not counted out to bins before they are
    one, and what comes of it has a row for each of those bins.
    """
    last = stimuli.select("stim_id", (F.floor(F.col("duration_sec") * rate + 1e-9).cast("int") - 1).alias("last_bin"))
    listed = samples.sparkSession.createDataFrame([k[:2] for k in kinds], "channel int, path string")
    of = lambda at, *names: F.col("channel").isin([k[0] for k in kinds if k[at] in names])
    # MOST_CHANNELS rows at the most; a join by path would put a channel's samples into one task
    rows = samples.where(F.col("path").isin([k[1] for k in kinds]) & F.expr("start is not null and not isnan(start)")).join(F.broadcast(listed), "path").join(last, "stim_id", "left")
    low = F.greatest(G.bin_index(F.col("start"), rate), F.lit(0))
    high = F.least(G.bin_index(F.coalesce("end", "start"), rate), F.coalesce("last_bin", F.lit(-1)))
    rows = rows.where(low <= high).select("stim_id", "channel", *FIELDS, low.alias("low"), high.alias("high"))
    placed = rows.withColumn("bin", F.explode(F.sequence("low", "high"))) if every is None else _cut(rows.unionByName(every, allowMissingColumns=True))
    keys, x = ["stim_id", "channel", "bin", *(["till"] if every is not None else [])], clean_nan(F.col("v"))
    empty = {"num": F.lit(None).cast("double"), "vec": F.lit(None).cast("array<double>"), "code": F.lit(None).cast("int"), "label": F.lit(None).cast("string")}
    scalar, text = of(2, "scalar", "bool", "event"), of(2, "label")
    if way == "vector":
        means = placed.select(*keys, F.posexplode_outer("vec").alias("k", "x")).groupBy(*keys, "k").agg(F.avg(clean_nan(F.col("x"))).alias("x"))
        found = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "x")))).alias("v"))
        made = {"vec": F.when(F.size("v") > 0, F.transform("v", lambda e: e["x"]))}
    elif way == "categorical":
        found, made = placed.groupBy(*keys).agg(F.mode("code", True).alias("top")), {"code": F.col("top")}
    elif way == "number":
        found = placed.groupBy(*keys).agg(F.avg(x).alias("mean"), F.max(x).alias("most"), F.count(x).cast("double").alias("n"))
        made = {"num": F.when(of(3, "any"), F.col("most")).when(of(3, "count"), F.col("n")).otherwise(F.col("mean"))}
    elif way == "nearest":
        away = F.abs(F.col("start") * rate - F.col("bin"))
        found, made = placed.groupBy(*keys).agg(F.min_by(x, F.struct(away, "start")).alias("near")), {"num": F.col("near")}
    elif way == "mode":
        found, made = placed.groupBy(*keys).agg(F.mode(F.when(scalar, x), True).alias("often"), F.mode(F.when(text, F.col("label")), True).alias("said")), {"num": F.col("often"), "label": F.col("said")}
    elif way == "last":
        found = placed.groupBy(*keys).agg(F.max_by(F.struct(x.alias("v"), "code", "label"), F.struct("start", "v", "code", "label")).alias("last"))
        made = {"num": F.when(scalar, F.col("last.v")), "label": F.when(text, F.col("last.label"))}
    else:
        laid = F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("start", "label"))))
        found, made = placed.groupBy(*keys).agg(laid.alias("said")), {"label": F.array_join(F.transform("said", lambda e: e["label"]), " ")}
    whole = found.select(*keys, *(made[c].alias(c) if c in made else empty[c].alias(c) for c in empty))
    return whole if every is None else _dealt(whole).withColumn("bin", F.explode(F.sequence("bin", "till"))).drop("till")


def channels(samples: DataFrame, template: DataFrame, stimuli: DataFrame, rate: float = 1.0) -> DataFrame:
    """(stim_id, path, dtype, bin, num, vec, code, label, applicable): every channel of the template for every bin of every stimulus.

    A channel without a sample does not apply to its stimulus and is null. One that applies counts 0, and joins to an
    empty text, where a bin has nothing; other bins without samples are null, as not measured. The template is a fixed
    short list, so the product with it is a fan-out of each stimulus; bins are counted out where their rows are needed,
    so only those of channels of points are shuffled, and none is sent to all. Channels with a sample that holds over a
    span are made one by runs of bins.
    """
    kinds = [(k, *kind) for k, kind in enumerate(_kinds(template))]
    spark = samples.sparkSession
    listed = F.from_json(F.lit(json.dumps([dict(zip(("path", "dtype", "resample"), k[1:], strict=True)) for k in kinds])), "array<struct<path:string,dtype:string,resample:string>>")
    held = F.max(F.col("end").isNotNull() & (F.col("end") > F.col("start"))).alias("held")
    known = samples.groupBy("stim_id", "path").agg(held).join(F.broadcast(spark.createDataFrame([k[:2] for k in kinds], "channel int, path string")), "path")
    n = F.floor(F.col("duration_sec") * rate + 1e-9).cast("int")
    has = known.groupBy("stim_id").agg(F.collect_list("channel").alias("has"), F.collect_list(F.when(F.col("held"), F.col("channel"))).alias("held"))
    none = F.lit([]).cast("array<int>")
    rows = staged(stimuli.where(n >= 1).select("stim_id", n.alias("n")).join(has, "stim_id", "left").select("stim_id", "n", F.coalesce("has", none).alias("has"), F.coalesce("held", none).alias("held")), "wanted")
    listing = lambda c: {r[0] for r in rows.select(F.explode(c)).distinct().collect()}  # noqa: E731  # channels, MOST_CHANNELS at the most
    found, spans = listing("has"), listing("held")
    ways: dict[tuple[str, bool], list[tuple[int, str, str, str]]] = {}
    for kind in kinds:
        if kind[0] in found:
            way = _way(*kind[2:])
            ways.setdefault((way, kind[0] in spans and way not in ("", "nearest")), []).append(kind)  # what is nearest changes from bin to bin

    def grid(wanted: Column) -> DataFrame:
        """A row for each of the channels in an array and each bin of its stimulus."""
        return _dealt(rows).select("stim_id", "n", F.explode(wanted).alias("channel")).select("stim_id", "channel", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin"))

    def whole(held: DataFrame, applies: bool) -> DataFrame:
        kind = listed[F.col("channel")]
        num, label = F.col("num"), F.col("label")
        if applies:
            num, label = F.when(kind["resample"] == "count", F.coalesce(num, F.lit(0.0))).otherwise(num), F.when(kind["resample"] == "concat", F.coalesce(label, F.lit(""))).otherwise(label)
        return held.select("stim_id", kind["path"].alias("path"), kind["dtype"].alias("dtype"), "bin", num.alias("num"), "vec", "code", label.alias("label"), F.lit(applies).alias("applicable"))

    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("num", "double"), ("vec", "array<double>"), ("code", "int"), ("label", "string"))]
    every = F.lit([k[0] for k in kinds]).cast("array<int>")
    parts = [whole(grid(F.array_except(every, "has")).select("*", *nothing), False)]
    for (way, over), of in ways.items():
        own = F.array_intersect(F.col("has"), F.lit([k[0] for k in of]).cast("array<int>"))
        if over:
            bins = rows.select("stim_id", F.explode(own).alias("channel"), F.lit(0).alias("low"), (F.col("n") - 1).alias("high"))
            made = _reduced(samples, of, way, stimuli, rate, bins)
        else:
            made = grid(own).join(_reduced(samples, of, way, stimuli, rate), ["stim_id", "channel", "bin"], "left") if way else grid(own).select("*", *nothing)
        parts.append(whole(made, True))
    return together(*parts)

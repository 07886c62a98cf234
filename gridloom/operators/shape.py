"""The constant shape of a corpus: every stimulus has every channel, and three states of missing stay apart.

Not applicable: the channel's rows are null and marked. Not measured: an element is null. Measured zero: a zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom import schemas


def level(class_: Column, subclass: Column, leaf: Column) -> Column:
    """low, mid or high: how near to the signal a channel is."""
    # fixed values: which channels are low and which are mid
    low = (
        ((class_ == "visual") & subclass.isin("low_level_static", "dynamic_motion"))
        | ((class_ == "audio") & (subclass == "low_level"))
        | ((class_ == "language") & leaf.isin("freq_zipf", "word_length"))
    )
    mid = (
        ((class_ == "visual") & subclass.isin("saliency_aesthetics_depth", "faces_bodies_gaze"))
        | ((class_ == "audio") & leaf.isin("speech_present", "word_rate"))
        | ((class_ == "language") & ((subclass == "syntax") | leaf.isin("valence", "arousal", "dominance", "concreteness", "aoa")))
        | ((class_ == "social") & leaf.isin("n_agents", "min_pair_distance"))
        | ((class_ == "affect") & leaf.isin("face_emotion", "face_valence", "face_arousal"))
    )
    return F.when(low, "low").when(mid, "mid").otherwise("high")


def n_variables(dtype: Column, dim: Column) -> Column:
    return F.when(dtype == "vector", dim).otherwise(1)


def feature_info(template: DataFrame) -> DataFrame:
    """One row for each variable: var_name, path, class, level, component, comp_index (from 1), numeric, is_embedding."""
    rows = template.withColumn("n", F.coalesce(n_variables(F.col("dtype"), F.col("dim")), F.lit(1)))
    rows = rows.withColumn("comp_index", F.explode(F.sequence(F.lit(1), "n")))
    component = F.when(F.col("dtype") == "vector", F.coalesce(F.try_element_at("components", F.col("comp_index")), F.concat(F.lit("d"), F.col("comp_index") - 1)))
    base = F.replace(F.col("path"), F.lit("/"), F.lit("__"))
    name = F.when(component.isNotNull(), F.concat_ws("__", base, F.regexp_replace(component, "[^A-Za-z0-9]+", "_"))).otherwise(base)
    return rows.select(
        name.alias("var_name"), "path", "class", level(F.col("class"), F.col("subclass"), F.col("leaf")).alias("level"), component.alias("component"), "comp_index",
        F.col("dtype").isin(*schemas.NUMERIC).alias("numeric"), F.col("leaf").isin(*schemas.EMBEDDINGS).alias("is_embedding"),
    )


def template_of(channels: DataFrame) -> DataFrame:
    """Channels (path, dtype, dim, components and any other columns) with class, subclass and leaf."""
    parts = F.split("path", "/")
    return channels.select("*", parts[0].alias("class"), F.when(F.size(parts) > 2, parts[1]).otherwise("(direct)").alias("subclass"), F.element_at(parts, -1).alias("leaf"))


def with_info(values: DataFrame, info: DataFrame) -> DataFrame:
    """Values (path, comp_index, ...) with what ``feature_info`` says of their variable; those of no known variable are left out."""
    return values.join(info, ["path", "comp_index"])


def skeleton_fill(stimuli: DataFrame, template: DataFrame, present: DataFrame, grid: DataFrame) -> DataFrame:
    """(stim_id, path, dtype, bin): null rows for each channel of the template that a stimulus lacks in ``present`` (stim_id, path).

    The template is a fixed short list, so the product with it is a fan-out of each stimulus, not a cross join of data.
    """
    wanted = stimuli.select("stim_id", F.explode(F.lit([r[0] for r in template.select("path").collect()])).alias("path"))
    missing = wanted.join(present.select("stim_id", "path").distinct(), ["stim_id", "path"], "left_anti")
    return missing.join(template.select("path", "dtype"), "path").join(grid, "stim_id").select("stim_id", "path", "dtype", "bin")


def encoded(dtype: Column, num: Column, code: Column, label: Column) -> tuple[Column, Column, Column]:
    """What a store of annotations holds: counts 0 and codes -1 and texts empty where null."""
    return F.when(dtype == "event", F.coalesce(num, F.lit(0.0))).otherwise(num), F.when(dtype.isin("bool", "categorical"), F.coalesce(code, F.lit(-1))), F.when(dtype == "label", F.coalesce(label, F.lit("")))


def renull(value: Column, applicable: Column) -> Column:
    """Fills of a channel that does not apply are no data."""
    return F.when(applicable, value)


def expand_vectors(rows: DataFrame) -> DataFrame:
    """One row for each component (from 1) of vec."""
    return rows.select(*[c for c in rows.columns if c != "vec"], F.posexplode("vec").alias("k", "value")).withColumn("comp_index", F.col("k") + 1).drop("k")


def interpretable(components: Column, most: int = 30) -> Column:
    """Whether a vector's components have names, few and of meaning."""
    return components.isNotNull() & (F.size(components) <= most) & ~F.exists(components, lambda c: c.rlike(r"^d\d+$"))


def shared_paths(channels: DataFrame) -> DataFrame:
    """The paths that every stimulus of channels (stim_id, path) has."""
    n = channels.agg(F.count_distinct("stim_id").alias("n"))
    return channels.groupBy("path").agg(F.count_distinct("stim_id").alias("has")).join(n, F.col("has") == F.col("n"), "left_semi").select("path")


def measured_paths(values: DataFrame, most_missing: float | None = None) -> DataFrame:
    """(path, missing): the paths with a value, and with at most that share of nulls among all their rows."""
    found = values.groupBy("path").agg(F.avg(F.col("num").isNull().cast("double")).alias("missing"), F.count("num").alias("n"))
    return found.where(F.col("n") > 0 if most_missing is None else F.col("missing") <= most_missing).select("path", "missing")


def varying_paths(values: DataFrame, least: float = 0.0) -> DataFrame:
    """(path, sd) of the paths whose standard deviation (of a sample) is above ``least``."""
    return values.groupBy("path").agg(F.stddev("num").alias("sd")).where(F.col("sd") > least)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` and those of ``existing`` whose keys it does not have."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def merge_index(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``upsert`` by id, but a new row that says skipped gives way to an older row."""
    ids = existing.select(key).distinct()
    skipped = new.where("status = 'skipped'").join(ids, key, "left_semi").select(key)
    return upsert(existing, new.join(skipped, key, "left_anti"), [key])


def pending(manifest: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return manifest.join(done.select(key).distinct(), key, "left_anti")


def last_provenance(channel_meta: DataFrame) -> DataFrame:
    """(model, version, tier): the last version and tier of each model, by ``ord``."""
    last = channel_meta.groupBy("model").agg(F.max_by(F.struct("version", "tier"), "ord").alias("p"))
    return last.select("model", "p.version", "p.tier")


def to_wide(values: DataFrame, paths: list[str], keys: tuple[str, ...] = ("stim_id", "bin")) -> DataFrame:
    """Columns a__b__c of the scalar channels named; a fixed list, so that no pass over the data looks for it."""
    wide = values.groupBy(*keys).pivot("path", paths).agg(F.first("num", ignorenulls=True))
    return wide.select(*keys, *[F.col(f"`{p}`").alias(p.replace("/", "__")) for p in paths])


def sidecar(channel_meta: DataFrame) -> DataFrame:
    """(stim_id, manifest): each stimulus's channels, by path, as one JSON object without arrays of data."""
    entry = F.struct("path", F.struct("dtype", "units"))
    return channel_meta.groupBy("stim_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("manifest"))


def has_all(channels: DataFrame, paths: list[str], measured: str | None = None) -> DataFrame:
    """(id) of those that have every one of the paths, of channels (id, path, applicable); the path ``measured`` must be applicable too."""
    wanted = channels.where(F.col("path").isin(*paths)).groupBy("id").agg(F.count_distinct("path").alias("n"), F.max((F.col("path") == measured) & F.col("applicable")).alias("ok"))
    found = wanted.where(F.col("n") == len(set(paths)))
    return (found.where("ok") if measured is not None else found).select("id")


def one_clip(rows: DataFrame, stim_id: object) -> DataFrame:
    """The rows of one stimulus; an error if there are none."""
    found = rows.where(F.col("stim_id") == F.lit(stim_id))
    if not found.limit(1).count():
        raise ValueError(f"no stimulus {stim_id}")
    return found


def factor_variables(info: DataFrame) -> DataFrame:
    """Of ``feature_info``, the numeric variables that are no embedding and no share of a taxonomy."""
    leaf = F.element_at(F.split("path", "/"), -1)
    return info.where(F.col("numeric") & ~F.col("is_embedding") & ~leaf.isin("audioset_tags", "action_posteriors"))


def unique_names(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with later ones of one name marked _1, _2 and so on, in order."""
    again = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    return rows.withColumn("__again", again).withColumn(name, F.when(F.col("__again") > 0, F.concat_ws("_", name, "__again")).otherwise(F.col(name))).drop("__again")


def with_sources(segments: DataFrame, media: DataFrame) -> DataFrame:
    """Segments with the source and the path of their stimulus's media (stim_id, source, path), empty where nothing is known."""
    known = media.groupBy("stim_id").agg(F.min_by(F.struct("source", "path"), F.struct("source", "path")).alias("m"))
    return segments.join(known, "stim_id", "left").select(*[segments[c] for c in segments.columns], F.coalesce("m.source", F.lit("")).alias("source"), F.coalesce("m.path", F.lit("")).alias("media_path"))


def nested_sidecar(channels: DataFrame) -> DataFrame:
    """(stim_id, manifest): channels (path of three parts, dtype, units) as JSON objects by class, subclass and leaf, each with where its data is."""
    parts = F.split("path", "/")
    leaf = channels.select("stim_id", parts[0].alias("a"), parts[1].alias("b"), parts[2].alias("c"), F.struct("dtype", "units", F.concat(F.lit("features/"), "path").alias("data_ref")).alias("d"))

    def fold(rows: DataFrame, keys: tuple[str, ...], k: str, v: str) -> DataFrame:
        """Rows of each key as one map, by name."""
        whole = F.map_from_entries(F.collect_list(F.struct(k, v)))
        return rows.groupBy(*keys).agg(F.transform_values(F.map_from_entries(F.transform(F.array_sort(F.map_keys(whole)), lambda x: F.struct(x, x))), lambda _, x: F.element_at(whole, x)).alias("d"))

    inner = fold(fold(leaf, ("stim_id", "a", "b"), "c", "d"), ("stim_id", "a"), "b", "d")
    return fold(inner, ("stim_id",), "a", "d").select("stim_id", F.to_json("d").alias("manifest"))

"""Queries through files that Spark writes from the tables: annotation profiles, versions, media headers, streams out of order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.registry import ORACLES, query, read
from gridloom.shared import new_path
from gridloom.sources import annotation_source, containers, versions
from gridloom.streaming import live, timed


@query("""SELECT doc_id::VARCHAR AS stim_id, 'language/' || lang || '/' || source AS path, bin::INTEGER AS bin, CASE WHEN n_chars > 500 THEN CASE bin WHEN 0 THEN n_chars::DOUBLE WHEN 2 THEN length(lang)::DOUBLE END END AS num, n_chars > 500 AS applicable FROM documents, range(3) r(bin) WHERE lang <> 'de'""")
def profile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON profile a document, in files, read by the annotation data source."""
    leaf = F.struct(F.array(F.col("n_chars").cast("double"), F.lit(None).cast("double"), F.length("lang").cast("double")).alias("value"), F.lit("scalar").alias("dtype"), (F.col("n_chars") > 500).alias("applicable"))
    whole = F.struct(F.struct(F.col("doc_id").cast("string").alias("id")).alias("stimulus"), F.create_map(F.lit("language"), F.create_map(F.col("lang"), F.create_map(F.col("source"), leaf))).alias("features"))
    folder = new_path(spark, "profiles")
    read(spark, sf_dir, "documents").select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("json")).write.text(folder)
    rows = annotation_source.read_files(spark, folder, suffix=".txt")
    return rows.where("not startswith(path, 'language/de/')").select("stim_id", "path", "bin", "num", "applicable")


@query("""WITH e AS (SELECT (user_id % 20)::VARCHAR AS stim_id, event_type AS path, event_id::INTEGER AS bin, event_id, value FROM events), old AS (SELECT stim_id, path, bin, value AS num FROM e WHERE event_id % 2 = 0), new AS (SELECT stim_id, path, bin, value + 1 AS num FROM e WHERE event_id % 5 = 0 AND path <> 'view')
SELECT stim_id, path, bin, round(num, 6) AS num FROM (SELECT o.* FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.stim_id = o.stim_id AND n.path = o.path) UNION ALL SELECT * FROM new)""")
def versioned_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of even events, patched by those of every fifth, a version each."""
    values = lambda df, more: df.select((F.col("user_id") % 20).cast("string").alias("stim_id"), F.col("event_type").alias("path"), F.col("event_id").cast("int").alias("bin"), F.col("event_id").cast("double").alias("time_sec"), (F.col("value") + more).alias("num"), *(F.lit(None).cast(k).alias(c) for c, k in (("vec", "array<float>"), ("code", "int"), ("label", "string"))))
    events, folder = read(spark, sf_dir, "events"), new_path(spark, "versions")
    versions.patch(spark, folder, values(events.where("event_id % 2 = 0"), 0))
    versions.patch(spark, folder, values(events.where("event_id % 5 = 0 and event_type <> 'view'"), 1))
    return versions.read_current(spark, folder).select("stim_id", "path", "bin", F.round("num", 6).alias("num"))


def _little(n: Column | int) -> Column:
    """An integer as four bytes, the least first."""
    digits = F.lpad(F.hex(n if isinstance(n, Column) else F.lit(n)), 8, "0")
    return F.unhex(F.concat(*(F.substring(digits, k, 2) for k in (7, 5, 3, 1))))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 10 <> 3 THEN p_size / 4.0::DOUBLE END AS duration_sec, CASE WHEN p_partkey % 10 <> 3 THEN true END AS has_audio, CASE WHEN p_partkey % 10 <> 3 THEN false END AS has_video FROM part""")
def container_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound files of 40 bytes a second, one in ten with a broken first word, made of the rows of parts."""
    text = lambda s: F.lit(s).cast("binary")
    size = F.col("p_size") * 10
    form = F.concat(text("fmt "), _little(16), F.unhex(F.lit("01000100")), _little(20), _little(40), F.unhex(F.lit("02001000")))
    whole = F.concat(F.when(F.col("p_partkey") % 10 == 3, text("RIFX")).otherwise(text("RIFF")), _little(size + 36), text("WAVE"), form, text("data"), _little(size), F.repeat(F.lit("x"), size.cast("int")).cast("binary"))
    found = containers.probe_contents(read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), whole.alias("content")))
    return found.select(F.col("path").cast("long").alias("p_partkey"), "duration_sec", "has_audio", "has_video")


@query(ORACLES["cut_detect"])
def stream_cuts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts from a stream whose three batches interleave in time; two rows of a later time move the watermark past all others."""
    folder, key = new_path(spark, "mixed"), "spark.sql.streaming.stateStore.providerClass"
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("stim_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"), (F.col("event_id") % 3).alias("k"))
    for k in range(3):
        rows.where(F.col("k") == k).drop("k").coalesce(1).write.mode("append").parquet(folder)
    for year in (2090, 2099):
        spark.createDataFrame([("(end)", year)], "stim_id string, y int").select("stim_id", F.make_timestamp("y", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("ts"), F.lit(0.0).alias("v")).coalesce(1).write.mode("append").parquet(folder)
    before = spark.conf.get(key)
    timed.configure(spark)
    try:
        stream = spark.readStream.schema("stim_id string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(folder)
        found = live.run_available(spark, timed.cuts_in_order(stream, 49.0, 1800.0, "400 days", 86400 * 500), "append", "ordered")
    finally:
        spark.conf.set(key, before)
    at = (F.col("us") - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / F.lit(3.6e9)
    return found.where("stim_id <> '(end)'").select("stim_id", F.round(at, 6).alias("t"))

"""What is written and read again, streams that go on or come late, frames and shots: queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import schemas
from gridloom.functions import scalars
from gridloom.operators import search, shape
from gridloom.plans import annotate, graph
from gridloom.plans.extractors import NODES
from gridloom.plans.on_catalog import PRESENT, RAN, TEMPLATE, present, ran
from gridloom.plans.on_corpus import SQL_SEGMENTS, segments
from gridloom.plans.on_events import NATIVE, greedy_sql, samples, stimuli
from gridloom.plans.registry import query, read
from gridloom.shared import new_path, staged
from gridloom.sources import annotations
from gridloom.sources import stimuli as sources
from gridloom.streaming import live


@query("""SELECT 'd' || doc_id AS id, 'data/' || source || '/d' || doc_id || '.txt' AS path, source, 'text-only' AS modality, n_chars / 10.0::DOUBLE AS duration_sec, CASE WHEN lang = 'en' THEN 'false' END AS has_video FROM documents""")
def manifest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written as CSV and read by its schema; what was empty is null again."""
    docs = read(spark, sf_dir, "documents")
    known = {"id": F.concat(F.lit("d"), "doc_id"), "path": F.concat(F.lit("data/"), "source", F.lit("/d"), "doc_id", F.lit(".txt")), "source": F.col("source"), "modality": F.lit("text-only"), "duration_sec": F.col("n_chars") / F.lit(10.0), "has_video": F.when(F.col("lang") == "en", "false")}
    rows = docs.select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.MANIFEST.fields))
    path = new_path(spark, "manifest")
    rows.write.csv(path, header=True)
    return sources.read_manifest(spark, path).select("id", "path", "source", "modality", "duration_sec", "has_video")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return events.select(F.concat(F.lit("u"), F.col("user_id") % 30).alias("stim_id"), F.col("event_type").alias("path"), F.col("event_id").cast("int").alias("bin"), F.col("event_id").cast("double").alias("time_sec"), F.col("value").alias("num"), *(F.lit(None).cast(schemas.CHANNEL_VALUES[c].dataType).alias(c) for c in ("vec", "code", "label")))


@query("""WITH e AS (SELECT 'u' || user_id % 30 AS stim_id, event_type AS path, event_id::INTEGER AS bin, value AS num FROM events) SELECT stim_id, path, bin, round(num, 6) AS num FROM e WHERE stim_id NOT IN ('u1', 'u7') UNION ALL SELECT stim_id, path, bin, round(num + 1000, 6) FROM e WHERE stim_id IN ('u1', 'u7') AND path = 'error'""")
def annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of all stimuli, two of which are written again; the others stay as they were."""
    path, values = new_path(spark, "annotations"), _values(spark, sf_dir)
    annotations.write_annotations(values, path)
    annotations.write_annotations(values.where("stim_id in ('u1', 'u7') and path = 'error'").withColumn("num", F.col("num") + 1000), path)
    return annotations.read_annotations(spark, path).select("stim_id", "path", "bin", F.round("num", 6).alias("num"))


@query("""SELECT CASE WHEN event_type IN ('click', 'view') THEN 'visual' ELSE 'audio' END AS category, event_id::INTEGER AS bin, round(value, 6) AS f1, CASE WHEN event_type IN ('click', 'view') THEN round(-value, 6) END AS f2 FROM events WHERE event_type <> 'signup'""")
def score_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor scores of two categories, one of one factor; the second writing of a category counts."""
    path, rows = new_path(spark, "scores"), _values(spark, sf_dir).select("stim_id", "bin", "path", F.round("num", 6).alias("f1"))
    annotations.write_scores(rows.drop("path"), path, "visual")
    annotations.write_scores(rows.where("path in ('click', 'view')").drop("path").withColumn("f2", -F.col("f1")), path, "visual")
    annotations.write_scores(rows.where("path in ('error', 'purchase')").drop("path"), path, "audio")
    return annotations.read_scores(spark, path).select("category", "bin", "f1", "f2")


@query("SELECT doc_id::VARCHAR AS line FROM documents WHERE lang = 'en'")
def first_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first file by name with the suffix, among others."""
    folder = new_path(spark, "found")
    docs = read(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("value"))
    docs.coalesce(1).write.text(folder)
    return spark.read.text(annotations.find_annotation(spark, folder, ".txt")).select(F.col("value").alias("line"))


@query(f"""WITH {SQL_SEGMENTS}, w AS (SELECT stim_id, seg, max(v) FILTER (path = 'count') AS count, max(v) FILTER (path = 'value') AS value FROM segments GROUP BY ALL) SELECT stim_id, seg::INTEGER AS seg, round(count, 4) AS count, round(value, 4) AS value FROM w""")
def search_index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search index as lines of JSON, written, read and taken apart."""
    found = staged(segments(spark, sf_dir), "segments")
    path = new_path(spark, "index")
    annotations.index_json(found, search.channel_stats(found)).write.text(path)
    lines = spark.read.text(path).select(F.from_json("value", "stim_id string, seg int, v array<double>").alias("j"))
    return lines.select("j.stim_id", "j.seg", F.col("j.v")[0].alias("count"), F.col("j.v")[1].alias("value"))


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def clip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.one_clip(samples(spark, sf_dir), "purchase").select("event_id", F.col("v").alias("value"))


@query(f"""WITH {SQL_SEGMENTS}, s AS (SELECT stim_id, seg::INTEGER AS seg, avg(CASE path WHEN 'value' THEN 1 ELSE -1 END * (v - mean) / std) AS score, count(*) AS k FROM segments JOIN stats USING (path) WHERE v IS NOT NULL AND stim_id IN ('click', 'view') GROUP BY ALL)
SELECT row_number() OVER (ORDER BY score DESC, stim_id, seg)::INTEGER AS rank, stim_id, seg, round(score, 6) AS score, k FROM s QUALIFY rank <= 10""")
def segment_search_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten among the segments of some stimuli, by statistics of all."""
    found = staged(segments(spark, sf_dir), "segments")
    best = search.search(found, search.channel_stats(found), {"value": 1, "count": -1}, 10, F.col("stim_id").isin("click", "view"))
    return search.ranked(best).select("rank", "stim_id", "seg", F.round("score", 6).alias("score"), "k")


@query(f"""WITH {RAN} SELECT path, CASE WHEN len(string_split(path, '/')) > 1 THEN string_split(path, '/')[-2] || '/' || leaf ELSE leaf END AS name FROM template""")
def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ran(spark, sf_dir).select("path", scalars.short_name(F.col("path")).alias("name"))


@query(f"""WITH {TEMPLATE}, {PRESENT}, l AS (SELECT stim_id, class, subclass, leaf, '"' || leaf || '":{{"dtype":"' || dtype || '","units":"' || units || '","data_ref":"features/' || path || '"}}' AS x FROM present JOIN template USING (path) WHERE subclass <> '(direct)'),
b AS (SELECT stim_id, class, subclass, '"' || subclass || '":{{' || string_agg(x, ',' ORDER BY leaf) || '}}' AS y FROM l GROUP BY stim_id, class, subclass), a AS (SELECT stim_id, class, '"' || class || '":{{' || string_agg(y, ',' ORDER BY subclass) || '}}' AS z FROM b GROUP BY stim_id, class)
SELECT stim_id, '{{' || string_agg(z, ',' ORDER BY class) || '}}' AS manifest FROM a GROUP BY stim_id""")
def nested_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = present(spark, sf_dir).distinct().join(sources.template(spark).where("subclass <> '(direct)'").select("path", "dtype", "units"), "path")
    return shape.nested_sidecar(rows)


@query("""WITH m AS (SELECT doc_id AS id, lang FROM documents), done AS (SELECT doc_id AS id FROM labels), old AS (SELECT doc_id AS id, 'ok' AS status FROM labels WHERE doc_id % 2 = 0),
new AS (SELECT id, CASE WHEN lang = 'en' THEN 'partial' ELSE 'ok' END AS status FROM m WHERE id NOT IN (SELECT id FROM done) UNION ALL SELECT id, 'skipped' FROM m WHERE id IN (SELECT id FROM done) AND id NOT IN (SELECT id FROM old)) SELECT * FROM new UNION ALL SELECT * FROM old""")
def batch_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest has and no run has done is annotated; what was done is passed over, and an older status of it stays."""
    manifest = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    done = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    index = done.where("id % 2 = 0").withColumn("status", F.lit("ok"))
    return annotate.run_batch(manifest, done, lambda df: df.withColumn("status", F.when(F.col("lang") == "en", "partial").otherwise("ok")), index)


_HOUR = "floor(t + 0.5)"


def _batches(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], str]:
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("stim_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"), (F.col("event_id") % 4).alias("k"))
    return [rows.where(c).drop("k") for c in ("k < 2", "k = 2", "k = 3")], new_path(spark, "batches")


def _grid_of(found: DataFrame) -> DataFrame:
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return live.latest(found, ["stim_id", "time"]).select("stim_id", F.floor((F.unix_micros("time") - start) / F.lit(3.6e9)).alias("bin"), F.round("v", 6).alias("v"), "n")


@query(f"""WITH {NATIVE}, s AS (SELECT *, event_id % 4 AS k, {_HOUR}::BIGINT AS hour FROM native), w AS (SELECT max(t) - 240 AS mark FROM s WHERE k < 2)
SELECT stim_id, hour AS bin, round(avg(v), 6) AS v, count(*)::BIGINT AS n FROM s, w WHERE k < 3 OR hour + 0.5 > mark GROUP BY ALL""")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches; what the third has for hours that ended ten days or more before the newest row of the first comes too late (a batch goes by the watermark of the one before it)."""
    parts, folder = _batches(spark, sf_dir)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return _grid_of(live.run_available(spark, live.grid_means(stream, 3600, "240 hours"), "update", "late"))


@query(f"WITH {NATIVE} SELECT stim_id, {_HOUR}::BIGINT AS bin, round(avg(v), 6) AS v, count(*)::BIGINT AS n FROM native GROUP BY ALL")
def stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that ends, and goes on from its checkpoint when more has come."""
    parts, folder = _batches(spark, sf_dir)
    kept = new_path(spark, "run")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(part.schema).parquet(folder)
        found = live.run_available(spark, live.grid_means(stream, 3600, "100000 hours"), "update", "resumed", kept)
    return _grid_of(found)


@query(greedy_sql("SELECT stim_id, t FROM (SELECT stim_id, t, abs(v - lag(v) OVER (PARTITION BY stim_id ORDER BY t, v)) AS d FROM native) WHERE d > 49", "c.t - k.t >= 0.5").rsplit(" SELECT stim_id, round", 1)[0] + """, c2 AS (SELECT stim_id, round_even(t, 0)::INTEGER AS bin, count(*) AS n FROM kept GROUP BY ALL)
SELECT g.stim_id, g.bin, coalesce(c2.n, 0)::DOUBLE AS cut, (SELECT count(*) FROM kept k WHERE k.stim_id = g.stim_id AND k.t <= g.time_sec)::DOUBLE AS shot_index FROM grid g LEFT JOIN c2 USING (stim_id, bin)""")
def graph_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts and shots of one colour that moves with the value, through the graph of extractors."""
    one = F.array(F.col("v") * F.lit(0.6) / F.lit(49.0))
    colors = samples(spark, sf_dir).select("stim_id", "t", one.alias("h")).groupBy("stim_id", "t").agg(F.min("h").alias("h"))
    done = graph.run([n for n in NODES if n.name == "VisualShots"], stimuli(spark, sf_dir).withColumn("modality", F.lit("video-only")), {"colors": colors}, sources.template(spark))
    return done.values.where("applicable").groupBy("stim_id", "bin").agg(F.max(F.when(F.col("path").endswith("/cut"), F.col("num"))).alias("cut"), F.max(F.when(F.col("path").endswith("/shot_index"), F.col("num"))).alias("shot_index"))


@query("""WITH p AS (SELECT 's' || p_partkey % 5 AS stim_id, round_even(p_partkey / 10.0::DOUBLE, 0)::INTEGER AS bin, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_partkey * 29 % 256 AS b, p_partkey * 11 % 256 AS r2, p_partkey * 3 % 256 AS g2, p_partkey * 5 % 256 AS b2 FROM part),
l AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS y, 0.299::DOUBLE * r2 + 0.587::DOUBLE * g2 + 0.114::DOUBLE * b2 AS y2, greatest(r, g, b) AS hi, least(r, g, b) AS lo, greatest(r2, g2, b2) AS hi2, least(r2, g2, b2) AS lo2 FROM p),
m AS (SELECT stim_id, bin, avg((y + y2) / 510) AS luminance, avg(abs(y - y2) / 510) AS rms_contrast, avg((r + r2) / 510.0::DOUBLE) AS r_mean, avg((g + g2) / 510.0::DOUBLE) AS g_mean, avg((b + b2) / 510.0::DOUBLE) AS b_mean, avg((hi + hi2) / 510.0::DOUBLE) AS val_mean,
avg(((hi - lo) / greatest(hi, 1)::DOUBLE + (hi2 - lo2) / greatest(hi2, 1)::DOUBLE) / 2) AS sat_mean, avg((floor(y) <> floor(y2))::INTEGER)::DOUBLE AS entropy FROM l GROUP BY ALL)
SELECT stim_id, bin, name AS path, round(num, 6) AS num FROM m UNPIVOT (num FOR name IN (luminance, rms_contrast, r_mean, g_mean, b_mean, val_mean, sat_mean, entropy))""")
def frame_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of two halves, each of one colour, through the extractor of pixels and its grid."""
    k = F.col("p_partkey")
    word = lambda *by: F.concat(*(F.lpad(F.hex(k * m % 256), 2, "0") for m in by))
    rgb = F.unhex(F.repeat(F.concat(F.repeat(word(7, 13, 29), 8), F.repeat(word(11, 3, 5), 8)), 16))
    frames = read(spark, sf_dir, "part").select(F.concat(F.lit("s"), k % 5).alias("stim_id"), (k / F.lit(10.0)).alias("t"), F.lit(16).alias("width"), F.lit(16).alias("height"), rgb.alias("rgb"))
    held = frames.groupBy("stim_id").agg((F.max("t") + 2).alias("duration_sec")).withColumn("modality", F.lit("video-only"))
    names = ["luminance", "rms_contrast", "r_mean", "g_mean", "b_mean", "val_mean", "sat_mean", "entropy"]
    wanted = sources.template(spark).where(F.col("path").isin(*(f"visual/low_level_static/{c}" for c in names)))
    values, _ = annotate.annotate(held, {"frames": frames}, wanted)
    return values.where("num is not null").select("stim_id", "bin", F.substring_index("path", "/", -1).alias("path"), F.round("num", 6).alias("num"))

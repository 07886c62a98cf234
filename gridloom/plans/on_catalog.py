"""Catalog, template and channel queries. Documents stand for a manifest, labels for what was done before, conversations for stimuli."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import schemas
from gridloom.operators import grid as G
from gridloom.operators import shape
from gridloom.plans.on_text import TALK, transcripts
from gridloom.plans.registry import query, read
from gridloom.sources import stimuli as sources

RIGHTS = {"src0": "CC0", "src1": "lab-internal"}
EXTENSIONS = {"en": "mp4", "fr": "wav", "de": "txt", "es": "md"}
STATUS = {"en": "ok", "fr": "partial", "de": "error", "es": "skipped"}
# fixed values: extractors and the kinds of stimuli they take
EXTRACTORS = {
    "visual": ["VisualLowLevel", "VisualShots", "VisualSemantic", "VisualMotion", "VisualDepth", "VisualAction", "Faces", "Pose", "VisualSaliency", "VisualEmoNet", "FaceEmotion", "QwenReasoning"],
    "audio": ["AudioLowLevel", "ASR", "AudioEvents", "AudioClap", "VocalAffect"],
    "language": ["LanguageLexical", "LanguageSyntax", "TextEmotion", "TextSentiment", "LanguageSurprisal", "LanguageHL"],
    "all": ["EventSegmentation"],
}
APPLIES = {"visual": ["audiovisual", "video-only"], "audio": ["audiovisual", "audio-only"], "language": ["audiovisual", "audio-only", "text-only"], "all": list(schemas.MODALITIES)}


def of(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def case(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def ran(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template's channels that a run has: those whose number some event above 20 names."""
    named = read(spark, sf_dir, "events").where("value > 20").select((F.col("event_id") % 103).alias("k")).distinct()
    paths = F.lit([r[0] for r in schemas.template_rows()])
    return sources.template(spark).join(named.select(F.element_at(paths, (F.col("k") + 1).cast("int")).alias("path")), "path", "left_semi")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.select(F.col("doc_id").alias("id"), "source", "lang", (F.col("n_chars") / 100).alias("duration_sec"))


def _literal(v) -> str:
    return "NULL" if v is None else "[" + ", ".join(map(_literal, v)) + "]" if isinstance(v, list) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


_ROWS = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in schemas.template_rows())
_LEVELED = """leveled AS (SELECT *, CASE
WHEN (class = 'visual' AND subclass IN ('low_level_static', 'dynamic_motion')) OR (class = 'audio' AND subclass = 'low_level') OR (class = 'language' AND leaf IN ('freq_zipf', 'word_length')) THEN 'low'
WHEN (class = 'visual' AND subclass IN ('saliency_aesthetics_depth', 'faces_bodies_gaze')) OR (class = 'audio' AND leaf IN ('speech_present', 'word_rate')) OR (class = 'language' AND (subclass = 'syntax' OR leaf IN ('valence', 'arousal', 'dominance', 'concreteness', 'aoa'))) OR (class = 'social' AND leaf IN ('n_agents', 'min_pair_distance')) OR (class = 'affect' AND leaf IN ('face_emotion', 'face_valence', 'face_arousal')) THEN 'mid'
ELSE 'high' END AS level, coalesce(CASE WHEN dtype = 'vector' THEN dim ELSE 1 END, 1) AS n FROM template)"""


def _template(rows: str) -> str:
    """CTEs of the template, with class, subclass, leaf and level, from rows of its fixed values."""
    parts = "split_part(path, '/', 1) AS class, CASE WHEN len(string_split(path, '/')) > 2 THEN split_part(path, '/', 2) ELSE '(direct)' END AS subclass, string_split(path, '/')[-1] AS leaf"
    return f"template AS (SELECT path, dtype, dim::INTEGER AS dim, units, resample, native_rate, components, {parts} FROM {rows}),\n{_LEVELED}"


_VALUES = f"(VALUES {_ROWS}) t(path, dtype, dim, units, resample, native_rate, components)"
TEMPLATE = _template(_VALUES)
#: The template's channels that a run has: those whose number some event above 20 names.
RAN = _template(f"(SELECT *, row_number() OVER () - 1 AS k FROM {_VALUES}) WHERE k IN (SELECT event_id % 103 FROM events WHERE value > 20)")
DOCS = "manifest AS (SELECT doc_id AS id, source, lang, n_chars / 100.0::DOUBLE AS duration_sec FROM documents)"


@query(f"""SELECT 'data/' || source || '/d' || doc_id || '.' || {case(EXTENSIONS, 'lang')} AS path, 'd' || doc_id AS id, {case(EXTENSIONS, 'lang')} AS extension, source FROM documents WHERE lang <> 'es'""")
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "documents").select(F.concat(F.lit("data/"), "source", F.lit("/d"), "doc_id", F.lit("."), of(EXTENSIONS, F.col("lang"))).alias("path"))
    return sources.manifest_entries(files, "data")


@query(f"SELECT doc_id AS id, source, coalesce({case(RIGHTS, 'source')}, 'unknown') AS rights FROM documents")
def manifest_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.with_rights(manifest(spark, sf_dir).select("id", "source"), RIGHTS)


@query("SELECT md5(text) AS id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.duplicate_ids(read(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("id")))


@query("SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'audiovisual' WHEN lang = 'fr' THEN 'video-only' WHEN lang = 'de' THEN 'audio-only' ELSE 'text-only' END AS modality FROM documents")
def modality_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.col("lang")
    return manifest(spark, sf_dir).select("id", sources.modality(lang.isin("en", "fr"), lang.isin("en", "de")).alias("modality"))


@query("SELECT doc_id AS id, substr(sha256(text), 1, 16) AS sha FROM documents")
def sha_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), sources.short_hash(F.col("text")).alias("sha"))


@query(f"WITH {DOCS} SELECT id, source, round(duration_sec, 6) AS duration_sec FROM manifest WHERE source IN ('src0', 'src1', 'src2') AND duration_sec <= 30 ORDER BY id LIMIT 50")
def manifest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50, as the manifest's own limit asks."""
    found = sources.filter_manifest(manifest(spark, sf_dir), ["src0", "src1", "src2"], longest=30.0, first=50)
    return found.select("id", "source", F.round("duration_sec", 6).alias("duration_sec"))


_EXTRACTORS = ", ".join(f"('{n}', '{m}')" for k, names in EXTRACTORS.items() for n in names for m in APPLIES[k])


@query(f"""WITH x(extractor, modality) AS (VALUES {_EXTRACTORS}), m AS (SELECT CASE WHEN lang = 'en' THEN 'audiovisual' WHEN lang = 'fr' THEN 'video-only' WHEN lang = 'de' THEN 'audio-only' ELSE 'text-only' END AS modality, count(*) AS n FROM documents GROUP BY 1)
SELECT extractor, sum(n)::BIGINT AS stimuli FROM x JOIN m USING (modality) GROUP BY 1""")
def applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [(n, m) for k, names in EXTRACTORS.items() for n in names for m in APPLIES[k]]
    applies = spark.createDataFrame(pairs, "extractor string, modality string")
    return modality_infer(spark, sf_dir).join(F.broadcast(applies), "modality").groupBy("extractor").agg(F.count("*").alias("stimuli"))  # 24 extractors


@query("SELECT event_type AS model, arg_max(user_id, event_id) AS version, arg_max('t' || event_id % 3, event_id) AS tier FROM events GROUP BY 1")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = read(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("version"), F.concat(F.lit("t"), F.col("event_id") % 3).alias("tier"), F.col("event_id").alias("ord"))
    return shape.last_provenance(meta)


@query(f"""WITH old AS (SELECT doc_id AS id, 'ok' AS status FROM labels), new AS (SELECT doc_id AS id, {case(STATUS, 'lang')} AS status FROM documents),
kept AS (SELECT * FROM new WHERE NOT (status = 'skipped' AND id IN (SELECT id FROM old))) SELECT * FROM kept UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM kept)""")
def corpus_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("ok").alias("status"))
    new = manifest(spark, sf_dir).select("id", of(STATUS, F.col("lang")).alias("status"))
    return shape.merge_index(old, new)


@query("SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.pending(manifest(spark, sf_dir).select("id", "source"), read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("SELECT doc_id, 'quality' AS path, quality::DOUBLE AS num FROM labels UNION ALL SELECT doc_id, 'quality', n_chars::DOUBLE FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def patch_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "documents").select("doc_id", F.lit("quality").alias("path"), F.col("n_chars").cast("double").alias("num"))
    new = read(spark, sf_dir, "labels").select("doc_id", F.lit("quality").alias("path"), F.col("quality").cast("double").alias("num"))
    return shape.upsert(old, new, ["doc_id", "path"])


@query(f"SELECT {case(STATUS, 'lang')} AS status, count(*) AS n FROM documents GROUP BY 1")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).groupBy(of(STATUS, F.col("lang")).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) FILTER (n_chars > 1000) AS n_measured, count(*) FILTER (n_chars <= 1000 AND n_chars > 100) AS n_skeleton, count(*) FILTER (n_chars <= 100) AS n_failed FROM documents GROUP BY 1")
def channel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(n > 1000).alias("n_measured"), F.count_if((n <= 1000) & (n > 100)).alias("n_skeleton"), F.count_if(n <= 100).alias("n_failed"))


@query(f"WITH {RAN} SELECT path, dtype, dim, units, resample, native_rate, class, subclass, leaf FROM template")
def template_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ran(spark, sf_dir).drop("components")


@query("SELECT DISTINCT event_type || '/' || (user_id % 7) AS path, 'scalar' AS dtype, 1 AS dim FROM events")
def template_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = read(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", F.col("user_id") % 7).alias("path"), F.lit("scalar").alias("dtype"), F.lit(1).alias("dim"))
    onsets = read(spark, sf_dir, "events").select(F.concat("event_type", F.lit("__onsets")).alias("path"), F.lit("event").alias("dtype"), F.lit(1).alias("dim"))
    return sources.infer_template(meta.union(onsets))


@query(rf"""WITH {RAN}, x AS (SELECT *, unnest(range(1, n + 1))::INTEGER AS comp_index FROM leveled), c AS (SELECT *, CASE WHEN dtype = 'vector' THEN coalesce(components[comp_index], 'd' || (comp_index - 1)) END AS component FROM x)
SELECT replace(path, '/', '__') || CASE WHEN component IS NOT NULL THEN '__' || regexp_replace(component, '[^A-Za-z0-9]+', '_', 'g') ELSE '' END AS var_name, path, class, level, component, comp_index, dtype IN ('scalar', 'bool', 'event', 'vector') AS "numeric", leaf IN ('siglip_embedding', 'dino_embedding', 'clap_embedding', 'qwen3', 'llama_ar') AS is_embedding FROM c""")
def feature_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.feature_info(ran(spark, sf_dir))


@query(f"WITH {RAN} SELECT path, level FROM leveled")
def feature_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ran(spark, sf_dir).select("path", shape.level(F.col("class"), F.col("subclass"), F.col("leaf")).alias("level"))


@query(f"WITH {RAN} SELECT class, subclass, count(*) AS n, list(leaf ORDER BY path) AS leaves FROM template GROUP BY ALL")
def feature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = ran(spark, sf_dir).groupBy("class", "subclass").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("path", "leaf"))).alias("x"))
    return tree.select("class", "subclass", "n", F.transform("x", lambda e: e["leaf"]).alias("leaves"))


@query(f"WITH {RAN} SELECT path, row_number() OVER (ORDER BY list_position(['visual', 'audio', 'language', 'social', 'situation', 'affect'], class), list_position(['low', 'mid', 'high'], level), path)::INTEGER AS place FROM leveled")
def feature_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = feature_level(spark, sf_dir).withColumn("class", F.substring_index("path", "/", 1))
    rank = lambda values, c: F.array_position(F.lit(list(values)), F.col(c))
    return rows.select("path", F.row_number().over(Window.orderBy(rank(schemas.CLASSES, "class"), rank(schemas.LEVELS, "level"), "path")).alias("place"))  # 103 rows


@query(f"""WITH {RAN} SELECT class, coalesce(sum(n) FILTER (level = 'low'), 0)::BIGINT AS low, coalesce(sum(n) FILTER (level = 'mid'), 0)::BIGINT AS mid, coalesce(sum(n) FILTER (level = 'high'), 0)::BIGINT AS high FROM leveled GROUP BY 1""")
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.coalesce(shape.n_variables(F.col("dtype"), F.col("dim")), F.lit(1))
    rows = ran(spark, sf_dir).select("class", shape.level(F.col("class"), F.col("subclass"), F.col("leaf")).alias("level"), n.alias("n"))
    return rows.groupBy("class").pivot("level", list(schemas.LEVELS)).agg(F.sum("n")).na.fill(0)


def present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stim_id, path): a conversation's turns, in a circle, name the channels that it has."""
    paths = F.lit([r[0] for r in schemas.template_rows()])
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stim_id"), "turn")
    return turns.select("stim_id", F.element_at(paths, (F.pmod(F.col("stim_id") * 7 + F.col("turn") * 13, F.lit(103)) + 1).cast("int")).alias("path"))


PRESENT = f"""numbered AS (SELECT path, dtype, row_number() OVER () - 1 AS k FROM (SELECT path, dtype FROM template)), listed AS (SELECT [{', '.join("'" + r[0] + "'" for r in schemas.template_rows())}] AS paths),
present AS (SELECT DISTINCT conv_id AS stim_id, paths[((conv_id * 7 + turn * 13) % 103 + 1)::INTEGER] AS path FROM conversations, listed)"""


@query(f"""WITH {TALK}, {TEMPLATE}, {PRESENT} SELECT stim_id, path, dtype, n_bins::BIGINT AS n FROM long, template WHERE n_bins > 0 AND NOT EXISTS (SELECT 1 FROM present p WHERE p.stim_id = long.stim_id AND p.path = template.path)""")
def skeleton_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = transcripts(spark, sf_dir)
    filled = shape.skeleton_fill(long, sources.template(spark), present(spark, sf_dir), G.time_grid(long))
    return filled.groupBy("stim_id", "path", "dtype").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN coalesce(CASE WHEN value > 250 THEN value END, 0) ELSE CASE WHEN value > 250 THEN value END END AS num,
CASE WHEN event_type IN ('error', 'view') THEN CASE WHEN value > 250 THEN (user_id % 5)::INTEGER ELSE -1 END END AS code, CASE WHEN event_type = 'signup' THEN CASE WHEN value > 250 THEN props ELSE '' END END AS label FROM events""")
def encode_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"click": "event", "error": "bool", "view": "categorical", "signup": "label", "purchase": "scalar"}
    high = F.col("value") > 250
    num, code, label = shape.encoded(of(kinds, F.col("event_type")), F.when(high, F.col("value")), F.when(high, (F.col("user_id") % 5).cast("int")), F.when(high, F.col("props")))
    return read(spark, sf_dir, "events").select("event_id", num.alias("num"), code.alias("code"), label.alias("label"))


@query("SELECT doc_id, CASE WHEN toxic = 0 THEN quality::DOUBLE END AS quality FROM labels")
def renull_inapplicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select("doc_id", shape.renull(F.col("quality").cast("double"), F.col("toxic") == 0).alias("quality"))


@query(f"WITH {RAN} SELECT path FROM template WHERE dtype IN ('scalar', 'bool', 'event')")
def scalar_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ran(spark, sf_dir).where(F.col("dtype").isin(*schemas.SCALAR_LIKE)).select("path")


@query(f"WITH {RAN} SELECT path FROM template WHERE class = 'audio'")
def class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ran(spark, sf_dir).where("class = 'audio'").select("path")


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def get_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "value")
    if not found.limit(1).count():
        raise KeyError("purchase")
    return found


@query(f"WITH {RAN} SELECT path FROM template WHERE contains(lower(path), 'face')")
def channel_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ran(spark, sf_dir).where(F.contains(F.lower("path"), F.lit("face"))).select("path")


_PREFERRED = "[" + ", ".join(f"'{p}'" for p in schemas.PREFERRED) + "]"


@query(f"""WITH {TEMPLATE}, {PRESENT}, r AS (SELECT stim_id, path, row_number() OVER (PARTITION BY stim_id ORDER BY list_position({_PREFERRED}, path)) AS place FROM present WHERE path IN (SELECT unnest({_PREFERRED}))) SELECT stim_id, path, place::INTEGER AS place FROM r WHERE place <= 6""")
def preferred_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.array_position(F.lit(list(schemas.PREFERRED)), F.col("path"))
    rows = present(spark, sf_dir).distinct().where(rank > 0)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("stim_id").orderBy(rank))).where("place <= 6")


@query("""SELECT doc_id::VARCHAR AS id, 'language/' || lang || '/' || source AS path, 'scalar' AS dtype, (n_chars > 500) AS applicable, bin::INTEGER AS bin, CASE bin WHEN 0 THEN n_chars::VARCHAR WHEN 2 THEN length(lang)::VARCHAR END AS value FROM documents, range(3) r(bin)""")
def json_profile_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = F.struct(F.array(F.col("n_chars").cast("string"), F.lit(None).cast("string"), F.length("lang").cast("string")).alias("value"), F.lit("scalar").alias("dtype"), (F.col("n_chars") > 500).alias("applicable"))
    whole = F.struct(F.struct(F.col("doc_id").cast("string").alias("id")).alias("stimulus"), F.create_map(F.lit("language"), F.create_map(F.col("lang"), F.create_map(F.col("source"), leaf))).alias("features"))
    profiles = read(spark, sf_dir, "documents").select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))
    return sources.profile_channels(profiles)


@query(f"""WITH {TEMPLATE}, {PRESENT} SELECT stim_id, '{{' || string_agg('"' || path || '":{{"dtype":"' || dtype || '","units":"' || units || '"}}', ',' ORDER BY path) || '}}' AS manifest FROM present JOIN template USING (path) GROUP BY 1""")
def sidecar_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.sidecar(present(spark, sf_dir).distinct().join(sources.template(spark).select("path", "dtype", "units"), "path"))


@query("""WITH c AS (SELECT DISTINCT user_id AS stim_id, event_type AS path FROM events), o AS (SELECT user_id AS stim_id, event_type AS path, list(value ORDER BY value) AS onsets FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT stim_id, path, coalesce(onsets, []) AS onsets FROM c LEFT JOIN o USING (stim_id, path)""")
def onset_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("stim_id"), F.col("event_type").alias("path"), F.col("value").alias("t"))
    return sources.attach_onsets(rows.select("stim_id", "path").distinct(), rows.where("path = 'error'"))


@query(rf"""WITH {RAN} SELECT path || '[' || unnest(components) || ']' AS name FROM template WHERE components IS NOT NULL AND len(components) <= 30""")
def interp_vector_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ran(spark, sf_dir).where(shape.interpretable(F.col("components")))
    return rows.select("path", F.explode("components").alias("c")).select(F.concat("path", F.lit("["), "c", F.lit("]")).alias("name"))

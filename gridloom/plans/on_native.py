"""Queries from native rows of models and media to channels. Boxes, flow, logits, parses and replies are made from the columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import grid as G
from gridloom.operators import native, shape
from gridloom.operators import signals as S
from gridloom.plans.on_catalog import RAN, ran
from gridloom.plans.on_events import BINS, NATIVE, grid, rounded, samples, stimuli
from gridloom.plans.on_text import NORMS, STORY, TALK, lexicon, segments, stories, transcripts
from gridloom.plans.registry import query, read
from gridloom.sources import stimuli as sources

BOXES = "boxes AS (SELECT stim_id, event_id, bin::DOUBLE AS t, v - 12 AS x1, v * 0.5::DOUBLE AS y1, v + (user_id % 60) AS x2, v * 0.5::DOUBLE + (event_id % 90) AS y2, (event_id % 100) / 99.0::DOUBLE AS score, 640.0::DOUBLE AS width, 360.0::DOUBLE AS height FROM binned)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    v, e = F.col("v"), F.col("event_id")
    return rows.select(
        "stim_id", "event_id", G.bin_index(F.col("t")).cast("double").alias("t"), (v - 12).alias("x1"), (v * 0.5).alias("y1"), (v + F.col("user_id") % 60).alias("x2"), (v * 0.5 + e % 90).alias("y2"),
        (e % 100 / F.lit(99.0)).alias("score"), F.lit(640.0).alias("width"), F.lit(360.0).alias("height"), (e % 7 / F.lit(7.0)).alias("keypoint_score"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).select("stim_id", F.col("time_sec").alias("t"))


@query(f"""WITH {NATIVE}, {BOXES} SELECT event_id FROM boxes WHERE score >= 0.9 AND least(round_even(x2, 0), 640) - greatest(round_even(x1, 0), 0) >= 24 AND least(round_even(y2, 0), 360) - greatest(round_even(y1, 0), 0) >= 24""")
def face_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.kept_faces(boxes(spark, sf_dir), 0.9, 24).select("event_id")


@query(f"""WITH {NATIVE}, {BOXES}, f AS (SELECT stim_id, t, count(*) AS n, max((x2 - x1) * (y2 - y1) / (width * height)) AS area, avg(score) AS prob FROM boxes WHERE score >= 0.9 GROUP BY ALL),
a AS (SELECT g.stim_id, g.bin, coalesce(f.n, 0)::DOUBLE AS n_faces, coalesce(f.area, 0) AS max_face_area_frac, f.prob AS face_prob FROM grid g LEFT JOIN f ON f.stim_id = g.stim_id AND f.t = g.time_sec)
SELECT stim_id, 'visual/faces_bodies_gaze/' || name AS path, bin, round(num, 6) AS num FROM a UNPIVOT INCLUDE NULLS (num FOR name IN (n_faces, max_face_area_frac, face_prob))""")
def face_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = native.face_samples(frames(spark, sf_dir), boxes(spark, sf_dir))
    return rounded(native.spread(found, "visual/faces_bodies_gaze", grid(spark, sf_dir)), "num")


@query(f"""WITH {NATIVE}, {BOXES}, k AS (SELECT stim_id, t, event_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, (event_id % 7) / 7.0::DOUBLE AS kp FROM boxes WHERE score >= 0.7), n AS (SELECT stim_id, t, count(*) AS n, avg(kp) AS kp FROM k GROUP BY ALL),
d AS (SELECT a.stim_id, a.t, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) / sqrt(640.0::DOUBLE ** 2 + 360.0::DOUBLE ** 2) AS d FROM k a JOIN k b ON a.stim_id = b.stim_id AND a.t = b.t AND a.event_id < b.event_id GROUP BY ALL),
a AS (SELECT g.stim_id, g.bin, coalesce(n.n, 0)::DOUBLE AS n_persons, n.kp AS keypoint_score, d.d AS min_pair_distance FROM grid g LEFT JOIN n ON n.stim_id = g.stim_id AND n.t = g.time_sec LEFT JOIN d ON d.stim_id = g.stim_id AND d.t = g.time_sec)
SELECT stim_id, 'social/' || name AS path, bin, round(num, 6) AS num FROM a UNPIVOT INCLUDE NULLS (num FOR name IN (n_persons, keypoint_score, min_pair_distance))""")
def pose_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = native.pose_samples(frames(spark, sf_dir), boxes(spark, sf_dir))
    return rounded(native.spread(found, "social", grid(spark, sf_dir)), "num")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("stim_id"), "vec_id", scalars.wide(F.col("embedding")).alias("e"))


@query("""WITH f AS (SELECT label AS stim_id, vec_id AS t, embedding[1:32]::DOUBLE[] AS u, embedding[33:64]::DOUBLE[] AS v FROM embeddings), m AS (SELECT *, list_aggregate(u, 'median') AS mu, list_aggregate(v, 'median') AS mv FROM f)
SELECT stim_id, t::DOUBLE AS t, round(list_avg(list_transform(list_zip(u, v), lambda p: sqrt(p[1] ** 2 + p[2] ** 2))), 6) AS magnitude, round(sqrt(mu ** 2 + mv ** 2), 6) AS camera,
round(list_avg(list_transform(list_zip(u, v), lambda p: sqrt((p[1] - mu) ** 2 + (p[2] - mv) ** 2))), 6) AS residual FROM m""")
def motion_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = vectors(spark, sf_dir).select("stim_id", F.col("vec_id").cast("double").alias("t"), F.slice("e", 1, 32).alias("u"), F.slice("e", 33, 32).alias("v"))
    return rounded(native.motion_samples(flow), "magnitude", "camera", "residual")


@query("""WITH d AS (SELECT label AS stim_id, vec_id AS t, embedding::DOUBLE[] AS d FROM embeddings), e AS (SELECT *, list_max(d) - list_min(d) AS r, list_transform(d, lambda x: (x - list_min(d)) / (list_max(d) - list_min(d) + 1e-6::DOUBLE)) AS e FROM d),
h AS (SELECT stim_id, t, least(floor(unnest(e) * 16), 15) AS b FROM e), c AS (SELECT stim_id, t, b, count(*) AS n FROM h GROUP BY ALL), x AS (SELECT stim_id, t, -sum(n / 64.0::DOUBLE * log2(n / 64.0::DOUBLE)) AS entropy FROM c GROUP BY ALL)
SELECT stim_id, t::DOUBLE AS t, round(list_avg(e), 6) AS depth_mean, round(r, 6) AS depth_range, len(list_filter(e, lambda x: x > 0.5)) / 64.0::DOUBLE AS foreground_frac, round(entropy, 6) AS depth_entropy FROM e JOIN x USING (stim_id, t)""")
def depth_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = vectors(spark, sf_dir).select("stim_id", F.col("vec_id").cast("double").alias("t"), F.col("e").alias("d"))
    return rounded(native.depth_samples(maps), "depth_mean", "depth_range", "depth_entropy")


@query("""WITH k AS (SELECT label AS stim_id, vec_id // 40 AS seg, row_number() OVER (PARTITION BY label, vec_id // 40 ORDER BY vec_id) - 1 AS i, list_transform(embedding::DOUBLE[], lambda x: 8 * x) AS z, (vec_id % 64) AS target FROM embeddings),
l AS (SELECT *, list_transform(z, lambda x: x - list_max(z) - ln(list_sum(list_transform(z, lambda y: exp(y - list_max(z)))))) AS lp FROM k), s AS (SELECT DISTINCT stim_id, seg FROM k),
m AS (SELECT stim_id, seg, avg(-lp[target + 1] / ln(2)) AS surprisal, avg(-list_sum(list_transform(lp, lambda x: exp(x) * x)) / ln(2)) AS entropy FROM l WHERE i > 0 GROUP BY ALL)
SELECT stim_id, seg, round(surprisal, 6) AS surprisal, round(entropy, 6) AS entropy FROM s LEFT JOIN m USING (stim_id, seg)""")
def token_surprisal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    seg = F.floor(F.col("vec_id") / 40)
    place = F.row_number().over(Window.partitionBy("stim_id", "seg").orderBy("vec_id")) - 1
    tokens = vectors(spark, sf_dir).withColumn("seg", seg).select("stim_id", "seg", place.alias("i"), F.transform("e", lambda x: 8 * x).alias("logits"), (F.col("vec_id") % 64).cast("int").alias("target"))
    return rounded(native.segment_surprisal(tokens), "surprisal", "entropy")


_POS = ("NOUN", "DET", "VERB", "ADJ", "ADP", "PROPN", "PUNCT")
_HEADS = "greatest(i - 1 - length(w) % 3, 0)"


@query(rf"""WITH RECURSIVE {TALK}, k AS (SELECT stim_id, i AS seg, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM talk), t AS (SELECT stim_id, seg, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM k),
h AS (SELECT stim_id, seg, i, {_HEADS} AS head, {list(_POS)}[1 + length(w) % 7] AS pos FROM t), up AS (SELECT stim_id, seg, i, i AS at, 0 AS d FROM h UNION ALL SELECT up.stim_id, up.seg, up.i, h.head, up.d + 1 FROM up JOIN h ON h.stim_id = up.stim_id AND h.seg = up.seg AND h.i = up.at AND h.head <> h.i WHERE up.d < 200),
x AS (SELECT stim_id, seg, max(d)::DOUBLE AS tree_depth FROM up GROUP BY ALL), m AS (SELECT stim_id, seg, coalesce(avg(abs(head - i)) FILTER (head <> i), 0) AS far, avg((pos IN ('NOUN', 'VERB', 'ADJ', 'ADV', 'PROPN'))::INTEGER) AS content, avg((pos IN ('NOUN', 'PROPN'))::INTEGER) AS noun, avg((pos = 'VERB')::INTEGER) AS verb FROM h GROUP BY ALL)
SELECT k.stim_id, k.seg, tree_depth, round(far, 6) AS mean_dep_distance, round(content, 6) AS content_frac, round(noun, 6) AS noun_frac, round(verb, 6) AS verb_frac FROM k LEFT JOIN x USING (stim_id, seg) LEFT JOIN m USING (stim_id, seg)""")
def syntax_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parses in which a word hangs on one a little before it, by its length."""
    rows = segments(spark, sf_dir).select("stim_id", F.col("i").alias("seg"), scalars.words_of(F.col("text")).alias("ws"))
    heads = F.transform("ws", lambda w, i: F.greatest(i - 1 - F.length(w) % 3, F.lit(0)))
    pos = F.transform("ws", lambda w: F.element_at(F.lit(list(_POS)), F.length(w) % 7 + 1))
    found = native.segment_syntax(rows.select("stim_id", "seg", heads.alias("heads"), pos.alias("pos")))
    return rounded(found, "mean_dep_distance", "content_frac", "noun_frac", "verb_frac")


_HALF = "CASE WHEN stim_id % 5 = 0 THEN ' ' || chr(10) WHEN i % 3 = 0 THEN NULL ELSE text END"


@query(rf"""WITH {TALK} SELECT stim_id, i, said AS text FROM (SELECT stim_id, i, {_HALF} AS said FROM talk) WHERE regexp_replace(coalesce(said, ''), '\s+', '', 'g') <> ''""")
def said_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that say something, where some have lost their texts."""
    return native.with_text(half_said(spark, sf_dir)).select("stim_id", "i", "text")


def half_said(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("stim_id") % 5 == 0, F.lit(" \n")).when(F.col("i") % 3 == 0, F.lit(None)).otherwise(F.col("text"))
    return segments(spark, sf_dir).withColumn("text", text)


@query(rf"""WITH {TALK}, h AS (SELECT stim_id, i, {_HALF} AS said FROM talk WHERE stim_id % 7 <> 0), s AS (SELECT stim_id, bool_or(regexp_replace(coalesce(said, ''), '\s+', '', 'g') <> '') AS said FROM h GROUP BY 1)
SELECT long.stim_id, coalesce(said, false) AS has_speech, CASE WHEN said IS NULL THEN 'no transcript' WHEN NOT said THEN 'no speech found' END AS note FROM long LEFT JOIN s USING (stim_id)""")
def speech_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of which some were never made, and some came out empty."""
    return native.speech_gate(transcripts(spark, sf_dir).select("stim_id"), half_said(spark, sf_dir).where("stim_id % 7 <> 0"))


@query(f"""WITH {TALK}, w AS (SELECT stim_id, unnest(range(n)) AS k, n, "start", "end" FROM segs), c AS (SELECT stim_id, round_even("start" + (k + 0.5::DOUBLE) / n * greatest("end" - "start", 1e-3::DOUBLE), 0)::INTEGER AS bin, count(*) AS n FROM w GROUP BY ALL), p AS (SELECT DISTINCT stim_id, bin FROM covered)
SELECT g.stim_id, 'audio/speech/word_rate' AS path, g.bin, coalesce(c.n, 0)::DOUBLE AS num FROM grid g LEFT JOIN c USING (stim_id, bin) UNION ALL SELECT g.stim_id, 'audio/speech/speech_present', g.bin, (p.bin IS NOT NULL)::INTEGER::DOUBLE FROM grid g LEFT JOIN p USING (stim_id, bin)""")
def speech_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, long = segments(spark, sf_dir), transcripts(spark, sf_dir)
    words = S.token_times(turns.select("stim_id", F.col("i").alias("seg_idx"), "start", "end", F.posexplode(scalars.words_of(F.col("text"))).alias("i", "word")))
    return native.speech(words.select("stim_id", F.col("t").alias("start")), turns, long, G.time_grid(long))


@query(f"""WITH {STORY}, {NORMS}, w AS (SELECT stim_id, round_even(i / 3.0::DOUBLE, 0)::INTEGER AS bin, nullif(regexp_replace(lower(text), '[^a-z'']+', '', 'g'), '') AS word FROM words), m AS (SELECT stim_id, bin, avg(length(word)) AS word_length, avg(value) AS valence FROM w LEFT JOIN norms USING (word) GROUP BY ALL),
a AS (SELECT g.stim_id, g.bin, m.word_length, m.valence FROM grid g LEFT JOIN m USING (stim_id, bin))
SELECT stim_id, 'language/lexical/' || name AS path, bin, round(num, 6) AS num FROM a UNPIVOT INCLUDE NULLS (num FOR name IN (word_length, valence))""")
def lexical_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts' lengths are dealt out by stim_id before their bins are counted out, so a few files' bins are not one task's."""
    docs, tasks = stories(spark, sf_dir), int(spark.conf.get("spark.sql.shuffle.partitions"))
    spoken = sources.text_stimuli(docs).where("n_words > 0").repartition(tasks, "stim_id")
    found = native.lexical(sources.text_timeline(docs), lexicon(spark).withColumnRenamed("value", "valence"), ["valence"], G.time_grid(spoken), every=True)
    return rounded(found, "num")


@query(f"""WITH {TALK}, v AS (SELECT stim_id, i, [(n % 5 + 1) / (n % 5 + n % 3 + n % 7 + 3.0::DOUBLE), (n % 3 + 1) / (n % 5 + n % 3 + n % 7 + 3.0::DOUBLE), (n % 7 + 1) / (n % 5 + n % 3 + n % 7 + 3.0::DOUBLE)] AS p FROM talk),
m AS (SELECT c.stim_id, c.bin, avg(p[1]) AS a, avg(p[2]) AS b, avg(p[3]) AS c FROM covered c JOIN v USING (stim_id, i) GROUP BY ALL)
SELECT g.stim_id, g.bin, round(c - a, 6) AS polarity, (CASE WHEN a IS NULL THEN -1 WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END)::INTEGER AS top FROM grid g LEFT JOIN m USING (stim_id, bin)""")
def sentiment_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    long, n = transcripts(spark, sf_dir), F.col("n")
    total = n % 5 + n % 3 + n % 7 + F.lit(3.0)
    turns = segments(spark, sf_dir).select("stim_id", "start", "end", F.array(*((n % k + 1) / total for k in (5, 3, 7))).alias("vec"))
    return rounded(native.sentiment(turns, long, G.time_grid(long)).drop("vec"), "polarity")


_REPLY = """CASE WHEN event_id % 7 = 0 THEN 'no object here' WHEN event_id % 7 = 1 THEN 'broken {"setting": ' ELSE 'Sure: {"setting": "' || repeat(event_type || ' ', 1 + 40 * (event_id % 2)) || '", "depicted_emotion": "calm", "valence": "' || value || '", "dominance": ' || (event_id % 10) / 10.0::DOUBLE || ', "arousal": "high"} done' END"""


@query(f"""WITH r AS (SELECT event_id, {_REPLY} AS said FROM events), o AS (SELECT event_id, CASE WHEN json_valid(nullif(regexp_extract(said, '(?s)\\{{.*\\}}'), '')) THEN regexp_extract(said, '(?s)\\{{.*\\}}') END AS j FROM r)
SELECT event_id, substr(json_extract_string(j, '$.setting'), 1, 200) AS setting, json_extract_string(j, '$.depicted_emotion') AS depicted_emotion, json_extract_string(j, '$.scene_description') AS scene_description,
try_cast(json_extract_string(j, '$.valence') AS DOUBLE) AS valence, try_cast(json_extract_string(j, '$.dominance') AS DOUBLE) AS dominance, try_cast(json_extract_string(j, '$.arousal') AS DOUBLE) AS arousal FROM o""")
def reply_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    whole = F.concat(F.lit('Sure: {"setting": "'), F.repeat(F.concat("event_type", F.lit(" ")), (1 + 40 * (e % 2)).cast("int")), F.lit('", "depicted_emotion": "calm", "valence": "'), F.col("value").cast("string"), F.lit('", "dominance": '), (e % 10 / F.lit(10.0)).cast("string"), F.lit(', "arousal": "high"} done'))
    said = F.when(e % 7 == 0, "no object here").when(e % 7 == 1, 'broken {"setting": ').otherwise(whole)
    fields = scalars.reply_fields(said)
    rows = read(spark, sf_dir, "events").select("event_id", fields.alias("f"))
    return rows.select("event_id", *(F.col(f"f.{k}").alias(k) for k in ("setting", "depicted_emotion", "scene_description", "valence", "dominance", "arousal")))


@query("""WITH s AS (SELECT l_orderkey AS stim_id, CASE l_linestatus WHEN 'O' THEN 'video' ELSE 'audio' END AS kind, CASE WHEN l_returnflag = 'N' THEN l_quantity END AS duration, l_linenumber * 5.0::DOUBLE AS fps, l_partkey AS width, l_suppkey AS height FROM lineitem),
f AS (SELECT stim_id, bool_or(kind = 'video') AS has_video, bool_or(kind = 'audio') AS has_audio, max(duration) FILTER (kind = 'video') AS v, max(duration) FILTER (kind = 'audio') AS a, max(fps) FILTER (kind = 'video') AS fps, max(width) FILTER (kind = 'video') AS width, max(height) FILTER (kind = 'video') AS height FROM s GROUP BY 1)
SELECT o_orderkey AS stim_id, coalesce(CASE WHEN o_orderstatus = 'F' THEN nullif(o_custkey, 0)::DOUBLE END, nullif(v, 0), nullif(a, 0), 0) AS duration_sec, coalesce(has_video, false) AS has_video, coalesce(has_audio, false) AS has_audio, coalesce(fps, 0) AS fps, coalesce(width, 0)::BIGINT AS width, coalesce(height, 0)::BIGINT AS height FROM orders LEFT JOIN f ON stim_id = o_orderkey""")
def media_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are containers, their lines streams."""
    streams = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("stim_id"), F.when(F.col("l_linestatus") == "O", "video").otherwise("audio").alias("kind"), F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).alias("duration"),
        (F.col("l_linenumber") * F.lit(5.0)).alias("fps"), F.col("l_partkey").alias("width"), F.col("l_suppkey").alias("height"))
    containers = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("stim_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("double")).alias("duration"))
    return native.probe(streams, containers)


@query("""SELECT user_id AS id FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY 1 HAVING count(DISTINCT event_type) = 3 AND max((event_type = 'error' AND value > 400)::INTEGER) = 1""")
def has_all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("path"), (F.col("value") > 400).alias("applicable"))
    return shape.has_all(channels, ["click", "error", "view"], "error")


@query("""WITH s AS (SELECT l_suppkey AS stim_id, l_linenumber AS seg, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT s_suppkey AS stim_id, 'nation ' || s_nationkey AS source, s_name || '.mp4' AS path FROM supplier WHERE s_nationkey < 12)
SELECT s.stim_id, s.seg, s.n, coalesce(m.source, '') AS source, coalesce(m.path, '') AS media_path FROM s LEFT JOIN m USING (stim_id)""")
def segment_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("stim_id"), F.col("l_linenumber").alias("seg")).agg(F.count("*").alias("n"))
    media = read(spark, sf_dir, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("stim_id"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("source"), F.concat("s_name", F.lit(".mp4")).alias("path"))
    return shape.with_sources(found, media)


@query(f"""WITH {RAN} SELECT path, replace(leaf, '_', ' ') || CASE WHEN dtype IN ('vector', 'categorical') AND coalesce(dim, 0) > 0 THEN ' (' || dim || ')' ELSE '' END AS label FROM template""")
def channel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.when(F.col("dtype").isin("vector", "categorical"), F.col("dim"))
    return ran(spark, sf_dir).select("path", scalars.label_text(F.col("path"), levels).alias("label"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events""")
def iso_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", scalars.iso_stamp(F.col("ts").cast("timestamp")).alias("stamp"))


@query("""WITH c AS (SELECT p_partkey, (p_partkey * 7) % 256 AS r, (p_partkey * 13) % 256 AS g, (p_partkey * 29) % 256 AS b FROM part)
SELECT p_partkey, [r, g, b]::INTEGER[] AS color, [round(r + (255 - r) * 0.5), round(g + (255 - g) * 0.5), round(b + (255 - b) * 0.5)]::INTEGER[] AS light FROM c""")
def blended_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda k: F.lpad(F.hex(F.col("p_partkey") * k % 256), 2, "0")
    color = scalars.rgb(F.concat(F.lit("#"), two(7), two(13), two(29)))
    return read(spark, sf_dir, "part").select("p_partkey", color.alias("color"), scalars.blend(color, 255, 0.5).alias("light"))


@query(rf"""WITH {RAN}, x AS (SELECT *, unnest(range(1, CASE WHEN dtype = 'vector' THEN coalesce(dim, 1) ELSE 1 END + 1)) AS k FROM template)
SELECT class, count(*)::BIGINT AS n FROM x WHERE dtype IN ('scalar', 'bool', 'event', 'vector') AND leaf NOT IN ('siglip_embedding', 'dino_embedding', 'clap_embedding', 'qwen3', 'llama_ar', 'audioset_tags', 'action_posteriors') GROUP BY 1""")
def factor_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.factor_variables(shape.feature_info(ran(spark, sf_dir))).groupBy("class").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT p_partkey, replace(p_name, ' ', '_') AS name FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) - 1 AS k FROM n) SELECT p_partkey, name || CASE WHEN k > 0 THEN '_' || k ELSE '' END AS name FROM r""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    return shape.unique_names(rows, "name", "p_partkey")


@query(f"""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(1 / (1 + exp(-(10 * e[1] / sqrt(list_inner_product(e, e)) - 2))), 6) AS p FROM x""")
def prompt_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's sigmoid with scale and bias, of the cosine with the first axis as the prompt."""
    e = F.col("e")
    return vectors(spark, sf_dir).select("vec_id", F.round(scalars.sigmoid(10 * scalars.cosine(e, F.transform(e, lambda x, i: F.when(i == 0, 1.0).otherwise(0.0))) - 2), 6).alias("p"))

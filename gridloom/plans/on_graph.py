"""Channels of every kind by the graph of extractors. Conversations are transcripts; vectors stand for what models give.

A vector channel has a row for each component (comp_index from 1); others have one row, without comp_index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import shape
from gridloom.plans import graph
from gridloom.plans.extractors import NODES
from gridloom.plans.on_catalog import TEMPLATE
from gridloom.plans.on_events import BINS, NATIVE, grid
from gridloom.plans.on_events import stimuli as event_stimuli
from gridloom.plans.on_native import BOXES, boxes
from gridloom.plans.on_text import NORMS, TALK, lexicon, segments, transcripts
from gridloom.plans.registry import query, read
from gridloom.sources import stimuli as sources

Tables = dict[str, DataFrame]


def rounded(x: Column) -> Column:
    """Six places, where a number below zero that rounds to it keeps its sign, as in SQL; what is no more than the noise of a sum has none."""
    near = F.round(x, 6)
    return F.when((near == 0) & (x < -1e-12), F.lit(-0.0)).otherwise(near)


def flat(values: DataFrame) -> DataFrame:
    rows = values.select("stim_id", "path", "bin", "num", "code", "label", F.posexplode_outer("vec").alias("k", "x"))
    return rows.select("stim_id", "path", "bin", (F.col("k") + 1).alias("comp_index"), rounded(F.coalesce("x", "num")).alias("num"), "code", "label")


def channels(spark: SparkSession, stimuli: DataFrame, native: Tables, *names: str, like: str = "%") -> DataFrame:
    """What the named extractors make of their channels whose path is ``like``; of others only the tables that extractors read are made."""
    nodes = [n for n in NODES if n.name in names]
    done = graph.run(nodes, stimuli.withColumn("modality", F.lit("audiovisual")), native, sources.template(spark).where(F.col("path").like(like)))
    if set(done.status.values()) != {"ok"}:
        raise RuntimeError(f"extractors: {done.status}")
    return done.values.where("applicable")


def talk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Tables]:
    turns = segments(spark, sf_dir)
    n, ws = F.col("n"), scalars.words_of(F.col("text"))
    logits = lambda count, k: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), k)
    pos = F.transform("ws", lambda w: F.element_at(F.lit(["NOUN", "DET", "VERB", "ADJ", "ADP", "PROPN", "PUNCT"]), F.length(w) % 7 + 1))
    return transcripts(spark, sf_dir), {
        "segments": turns.select("stim_id", "i", "text", "start", "end"),
        "norms": lexicon(spark).withColumnRenamed("value", "valence"),
        "parses": turns.withColumn("ws", ws).select("stim_id", "i", F.transform("ws", lambda w, i: F.greatest(i - 1 - F.length(w) % 3, F.lit(0))).alias("heads"), pos.alias("pos")),
        "sentiment_logits": turns.select("stim_id", "i", F.array(*(n % k / F.lit(2.0) for k in (5, 3, 7))).alias("logits")),
        "emotion_logits": turns.select("stim_id", "i", logits(28, lambda k: (n * k % 11 - 5) / F.lit(2.0)).alias("logits")),
    }


_WORDS = """spoken AS (SELECT stim_id, i AS seg, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS text, unnest(range(n)) AS k, n, "start", "end" FROM segs),
timed AS (SELECT *, "start" + (k + 0.5::DOUBLE) / n * greatest("end" - "start", 1e-3::DOUBLE) AS t FROM spoken), w AS (SELECT *, round_even(t, 0)::INTEGER AS bin FROM timed)"""


def out(num: str = "NULL::DOUBLE", code: str = "NULL::INTEGER", label: str = "NULL::VARCHAR", comp: str = "NULL::INTEGER") -> str:
    return f"{comp} AS comp_index, {num} AS num, {code} AS code, {label} AS label"


def _vector(path: str, of: str, on: str = "stim_id, bin") -> str:
    """Rows for each component of a CTE of (stim_id, bin, k, x) on the grid; a bin without has one row of nulls."""
    return f"SELECT g.stim_id, '{path}' AS path, g.bin, {out('round(m.x, 6)', comp='m.k::INTEGER')} FROM grid g LEFT JOIN (SELECT stim_id, bin, k, avg(x) AS x FROM {of} GROUP BY ALL) m USING ({on})"


def _scalar(path: str, of: str, value: str = "avg(x)") -> str:
    return f"SELECT g.stim_id, '{path}' AS path, g.bin, {out('round(m.x, 6)')} FROM grid g LEFT JOIN (SELECT stim_id, bin, {value} AS x FROM {of} GROUP BY ALL) m USING (stim_id, bin)"


def _mode(path: str, of: str) -> str:
    return f"SELECT g.stim_id, '{path}' AS path, g.bin, {out(code='m.top::INTEGER')} FROM grid g LEFT JOIN (SELECT stim_id, bin, arg_min(top, (-n, top)) AS top FROM (SELECT stim_id, bin, top, count(*) AS n FROM {of} GROUP BY ALL) GROUP BY ALL) m USING (stim_id, bin)"


@query(f"""WITH {TALK}, {_WORDS}, c AS (SELECT stim_id, bin, count(*) AS n, string_agg(text, ' ' ORDER BY t, text) AS label FROM w GROUP BY ALL), p AS (SELECT DISTINCT stim_id, bin FROM covered)
SELECT g.stim_id, 'audio/speech/word_rate' AS path, g.bin, {out("coalesce(c.n, 0)::DOUBLE")} FROM grid g LEFT JOIN c USING (stim_id, bin) UNION ALL
SELECT g.stim_id, 'audio/speech/asr_text', g.bin, {out(label="coalesce(c.label, '')")} FROM grid g LEFT JOIN c USING (stim_id, bin) UNION ALL
SELECT g.stim_id, 'audio/speech/speech_present', g.bin, {out("(p.bin IS NOT NULL)::INTEGER::DOUBLE")} FROM grid g LEFT JOIN p USING (stim_id, bin)""")
def graph_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(channels(spark, *talk(spark, sf_dir), "ASR"))


@query(f"""WITH {TALK}, {_WORDS}, {NORMS}, c AS (SELECT stim_id, bin, nullif(regexp_replace(lower(text), '[^a-z'']+', '', 'g'), '') AS word FROM w),
f AS (SELECT word, log10(count(*) / (SELECT count(*) FROM c WHERE word IS NOT NULL)::DOUBLE * 1e9) AS zipf FROM c WHERE word IS NOT NULL GROUP BY 1), l AS (SELECT stim_id, bin, length(word)::DOUBLE AS len, zipf, value FROM c LEFT JOIN f USING (word) LEFT JOIN norms USING (word))
{_scalar('language/lexical/word_length', 'l', 'avg(len)')} UNION ALL {_scalar('language/lexical/freq_zipf', 'l', 'avg(zipf)')} UNION ALL {_scalar('language/lexical/valence', 'l', 'avg(value)')}""")
def graph_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths, corpus frequencies and norms of the words that the transcript's extractor made."""
    return flat(channels(spark, *talk(spark, sf_dir), "ASR", "LanguageLexical", like="language/%"))


_POS = ["NOUN", "DET", "VERB", "ADJ", "ADP", "PROPN", "PUNCT"]


@query(rf"""WITH RECURSIVE {TALK}, kk AS (SELECT stim_id, i AS seg, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM talk), tt AS (SELECT stim_id, seg, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM kk),
h AS (SELECT stim_id, seg, i, greatest(i - 1 - length(w) % 3, 0) AS head, {_POS}[1 + length(w) % 7] AS pos FROM tt), up AS (SELECT stim_id, seg, i, i AS at, 0 AS d FROM h UNION ALL SELECT up.stim_id, up.seg, up.i, h.head, up.d + 1 FROM up JOIN h ON h.stim_id = up.stim_id AND h.seg = up.seg AND h.i = up.at AND h.head <> h.i WHERE up.d < 200),
x AS (SELECT stim_id, seg AS i, max(d)::DOUBLE AS tree FROM up GROUP BY ALL), m AS (SELECT stim_id, seg AS i, coalesce(avg(abs(head - i)) FILTER (head <> i), 0) AS far, avg((pos IN ('NOUN', 'VERB', 'ADJ', 'ADV', 'PROPN'))::INTEGER) AS content, avg((pos IN ('NOUN', 'PROPN'))::INTEGER) AS noun, avg((pos = 'VERB')::INTEGER) AS verb FROM h GROUP BY ALL),
a AS (SELECT c.stim_id, c.bin, tree, far, content, noun, verb FROM covered c LEFT JOIN x USING (stim_id, i) LEFT JOIN m USING (stim_id, i))
{' UNION ALL '.join(_scalar(f'language/syntax/{leaf}', 'a', f'avg({c})') for leaf, c in (('tree_depth', 'tree'), ('mean_dep_distance', 'far'), ('content_frac', 'content'), ('noun_frac', 'noun'), ('verb_frac', 'verb')))}""")
def graph_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(channels(spark, *talk(spark, sf_dir), "ASR", "LanguageSyntax", like="language/%"))


@query(f"""WITH {TALK}, e AS (SELECT stim_id, i, [exp(n % 5 / 2.0::DOUBLE), exp(n % 3 / 2.0::DOUBLE), exp(n % 7 / 2.0::DOUBLE)] AS e FROM talk), p AS (SELECT stim_id, i, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e), c AS (SELECT stim_id, bin, p FROM covered JOIN p USING (stim_id, i)),
v AS (SELECT stim_id, bin, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM c), t AS (SELECT stim_id, bin, list_position(p, list_max(p)) - 1 AS top FROM c)
{_vector('affect/depicted/text_sentiment', 'v')} UNION ALL {_scalar('affect/depicted/text_sentiment_polarity', 'c', 'avg(p[3] - p[1])')} UNION ALL {_mode('affect/depicted/text_sentiment_top', 't')}""")
def graph_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(channels(spark, *talk(spark, sf_dir), "ASR", "TextSentiment", like="affect/%"))


@query(f"""WITH {TALK}, p AS (SELECT stim_id, i, list_transform(range(28), lambda k: 1 / (1 + exp(-((n * k % 11 - 5) / 2.0::DOUBLE)))) AS p FROM talk), c AS (SELECT stim_id, bin, p FROM covered JOIN p USING (stim_id, i)),
v AS (SELECT stim_id, bin, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM c), t AS (SELECT stim_id, bin, list_position(p, list_max(p)) - 1 AS top FROM c)
{_vector('affect/depicted/text_emotion', 'v')} UNION ALL {_mode('affect/depicted/text_emotion_top', 't')}""")
def graph_text_emotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(channels(spark, *talk(spark, sf_dir), "ASR", "TextEmotion", like="affect/%"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("stim_id"), F.col("vec_id").alias("i"), scalars.wide(F.col("embedding")).alias("e"), (F.col("vec_id") / F.lit(50.0)).alias("t"))


def vector_stimuli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).groupBy("stim_id").agg((F.max("t") + 6).alias("duration_sec"))


SEEN = """e AS (SELECT label AS stim_id, vec_id AS i, vec_id / 50.0::DOUBLE AS t, embedding::DOUBLE[] AS e FROM embeddings), long AS (SELECT stim_id, floor(max(t) + 6 + 1e-9)::INTEGER AS n_bins FROM e GROUP BY 1),
grid AS (SELECT stim_id, unnest(range(n_bins))::INTEGER AS bin FROM long)"""


def eights(first: int, count: int) -> Column:
    return F.transform(F.slice("e", first, count), lambda x: 8 * x)


@query(f"""WITH {SEEN}, o AS (SELECT *, lag(e) OVER (PARTITION BY stim_id ORDER BY i) AS p FROM e), s AS (SELECT stim_id, i, list_inner_product(e, p) AS c FROM o),
n AS (SELECT a.stim_id, a.i, 1 - max(list_inner_product(a.e, b.e)) AS novelty FROM e a LEFT JOIN e b ON a.stim_id = b.stim_id AND b.i < a.i GROUP BY ALL),
y AS (SELECT stim_id, i, unnest(e) AS v, generate_subscripts(e, 1) AS k FROM e), r AS (SELECT *, sum(v) OVER (PARTITION BY stim_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM y),
d AS (SELECT stim_id, i, sum(v * run) / sqrt(sum(run * run)) + 1e-9::DOUBLE * CASE WHEN count(run) > 0 THEN sum(v) END AS drift FROM r GROUP BY ALL),
a AS (SELECT stim_id, unnest(range(round_even(t, 0)::INTEGER, least(round_even((i + 1) / 50.0::DOUBLE, 0)::INTEGER, n_bins - 1) + 1))::INTEGER AS bin, c, novelty, drift, (i % 10) / 10.0::DOUBLE AS expected FROM e JOIN s USING (stim_id, i) JOIN n USING (stim_id, i) JOIN d USING (stim_id, i) JOIN long USING (stim_id))
{' UNION ALL '.join(_scalar(f'language/hl/{leaf}', 'a', f'avg({c})') for leaf, c in (('semantic_coherence', 'c'), ('semantic_surprise', '1 - c'), ('semantic_novelty', 'novelty'), ('semantic_drift', 'drift'), ('narrative_expectedness', 'expected'), ('narrative_surprise', '1 - expected')))}""")
def graph_language_hl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances fifty a second; a model's answer is a sentence with a number in it."""
    rows = vectors(spark, sf_dir)
    said = rows.select("stim_id", "i", F.concat(F.lit("word "), F.col("i").cast("string")).alias("text"), F.col("t").alias("start"), ((F.col("i") + 1) / F.lit(50.0)).alias("end"))
    guesses = rows.select("stim_id", "i", F.concat(F.lit("I would say 0."), (F.col("i") % 10).cast("string"), F.lit(", as it goes.")).alias("reply"))
    native = {"segments": said, "embeddings": rows.select("stim_id", "i", F.col("e").alias("vec")), "guesses": guesses}
    return flat(channels(spark, vector_stimuli(spark, sf_dir), native, "ASR", "LanguageHL", like="language/%"))


_SOFTMAX = "list_transform({0}, lambda x: exp(8 * x) / list_sum(list_transform({0}, lambda y: exp(8 * y))))"


@query(f"""WITH {SEEN}, f AS (SELECT stim_id, i // 4 / 12.5::DOUBLE AS t, {_SOFTMAX.format('e[1:8]')} AS p, least(greatest(8 * e[9], -1), 1) AS valence, least(greatest(8 * e[10], -1), 1) AS arousal FROM e),
u AS (SELECT stim_id, t, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM f), m AS (SELECT stim_id, t, round_even(t, 0)::INTEGER AS bin, k, avg(x) AS x FROM u GROUP BY ALL), t AS (SELECT stim_id, bin, arg_min(k, (-x, k)) - 1 AS top FROM m GROUP BY stim_id, t, bin),
v AS (SELECT stim_id, round_even(t, 0)::INTEGER AS bin, avg(valence) AS valence, avg(arousal) AS arousal FROM f GROUP BY stim_id, t)
{_vector('affect/depicted/face_emotion', 'm')} UNION ALL {_mode('affect/depicted/face_emotion_top', 't')} UNION ALL {_scalar('affect/depicted/face_valence', 'v', 'avg(valence)')} UNION ALL {_scalar('affect/depicted/face_arousal', 'v', 'avg(arousal)')}""")
def graph_face_emotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four faces a frame."""
    rows = vectors(spark, sf_dir)
    found = rows.select("stim_id", (F.floor(F.col("i") / 4) / F.lit(12.5)).alias("t"), eights(1, 8).alias("logits"), (8 * F.col("e")[8]).alias("valence"), (8 * F.col("e")[9]).alias("arousal"))
    return flat(channels(spark, vector_stimuli(spark, sf_dir), {"face_logits": found}, "FaceEmotion"))


@query(f"""WITH {SEEN}, p AS (SELECT stim_id, round_even(t, 0)::INTEGER AS bin, {_SOFTMAX.format('e[1:20]')} AS p FROM e), v AS (SELECT stim_id, bin, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM p), t AS (SELECT stim_id, bin, list_position(p, list_max(p)) - 1 AS top FROM p)
{_vector('affect/depicted/emonet', 'v')} UNION ALL {_mode('affect/depicted/emonet_top', 't')}""")
def graph_scene_emotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(channels(spark, vector_stimuli(spark, sf_dir), {"scene_logits": vectors(spark, sf_dir).select("stim_id", "t", eights(1, 20).alias("logits"))}, "VisualEmoNet"))


@query(f"""WITH {SEEN}, p AS (SELECT stim_id, round_even(t + 2, 0)::INTEGER AS bin, {_SOFTMAX.format('e[1:16]')} AS p, list_transform(e[17:40], lambda x: 1 / (1 + exp(-8 * x))) AS s FROM e), v AS (SELECT stim_id, bin, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM p), t AS (SELECT stim_id, bin, list_position(p, list_max(p)) - 1 AS top FROM p),
a AS (SELECT stim_id, bin, unnest(s) AS x, generate_subscripts(s, 1) AS k FROM p), b AS (SELECT stim_id, bin, list_position(s, list_max(s)) - 1 AS top FROM p), c AS (SELECT stim_id, round_even(t + 1, 0)::INTEGER AS bin, e FROM e)
{_vector('visual/action/action_posteriors', 'v')} UNION ALL {_mode('visual/action/action_top', 't')} UNION ALL {_vector('audio/high_level/audioset_tags', 'a')} UNION ALL {_mode('audio/high_level/audioset_top', 'b')} UNION ALL
{' UNION ALL '.join(_scalar(f'audio/speech/voice_{leaf}', 'c', f'avg(e[{k}])') for k, leaf in ((41, 'arousal'), (42, 'dominance'), (43, 'valence')))}""")
def graph_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips and stretches of sound of four seconds, and voices of two, each counted where its middle is."""
    rows = vectors(spark, sf_dir)
    four = lambda logits: rows.select("stim_id", F.col("t").alias("start"), (F.col("t") + 4).alias("end"), logits.alias("logits"))
    e = F.col("e")
    voice = rows.select("stim_id", F.col("t").alias("start"), (F.col("t") + 2).alias("end"), e[40].alias("arousal"), e[41].alias("dominance"), e[42].alias("valence"))
    return flat(channels(spark, vector_stimuli(spark, sf_dir), {"clips": four(eights(1, 16)), "sound_windows": four(eights(17, 24)), "voice": voice}, "VisualAction", "AudioEvents", "VocalAffect"))


@query(f"""WITH {SEEN}, f AS (SELECT stim_id, round_even(t, 0)::INTEGER AS bin, e[1:32] AS u, e[33:64] AS v, e FROM e), m AS (SELECT *, list_aggregate(u, 'median') AS mu, list_aggregate(v, 'median') AS mv, list_min(e) AS lo, list_max(e) AS hi FROM f),
d AS (SELECT stim_id, bin, list_avg(list_transform(list_zip(u, v), lambda p: sqrt(p[1] ** 2 + p[2] ** 2))) AS magnitude, sqrt(mu ** 2 + mv ** 2) AS camera, list_avg(list_transform(list_zip(u, v), lambda p: sqrt((p[1] - mu) ** 2 + (p[2] - mv) ** 2))) AS residual,
list_avg(list_transform(e, lambda x: (x - lo) / (hi - lo + 1e-6::DOUBLE))) AS mean, hi - lo AS range, len(list_filter(e, lambda x: (x - lo) / (hi - lo + 1e-6::DOUBLE) > 0.5)) / len(e)::DOUBLE AS front,
-list_sum(list_transform(range(16), lambda b: (len(list_filter(e, lambda x: least(floor((x - lo) / (hi - lo + 1e-6::DOUBLE) * 16), 15) = b)) / len(e)::DOUBLE) * log2(greatest(len(list_filter(e, lambda x: least(floor((x - lo) / (hi - lo + 1e-6::DOUBLE) * 16), 15) = b)) / len(e)::DOUBLE, 1e-300)))) AS entropy FROM m)
{' UNION ALL '.join(_scalar(p, 'd', f'avg({c})') for p, c in (('visual/dynamic_motion/flow_magnitude', 'magnitude'), ('visual/dynamic_motion/camera_motion', 'camera'), ('visual/dynamic_motion/residual_motion', 'residual'), ('visual/saliency_aesthetics_depth/depth_mean', 'mean'), ('visual/saliency_aesthetics_depth/depth_range', 'range'), ('visual/saliency_aesthetics_depth/foreground_frac', 'front'), ('visual/saliency_aesthetics_depth/depth_entropy', 'entropy')))}""")
def graph_motion_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    native = {"flow": rows.select("stim_id", "t", F.slice("e", 1, 32).alias("u"), F.slice("e", 33, 32).alias("v")), "depth_maps": rows.select("stim_id", "t", F.col("e").alias("d"))}
    return flat(channels(spark, vector_stimuli(spark, sf_dir), native, "VisualMotion", "VisualDepth"))


@query(f"""WITH {SEEN}, q AS (SELECT i AS k, e AS v FROM e WHERE i < 16), u AS (SELECT stim_id, i, round_even(t, 0)::INTEGER AS bin, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM e),
v AS (SELECT stim_id, bin, unnest(e) AS x, generate_subscripts(e, 1) AS k FROM u), s AS (SELECT stim_id, bin, q.k + 1 AS k, 1 / (1 + exp(-(10 * list_cosine_similarity(e, v) - 2))) AS x FROM u, q)
{_vector('visual/high_level_static/siglip_embedding', 'v')} UNION ALL {_vector('visual/high_level_static/siglip_probe', 's')}""")
def graph_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen prompts, a fixed vocabulary: the vectors of the least vec_ids."""
    rows = vectors(spark, sf_dir)
    prompts = rows.where("i < 16").select(F.col("i").alias("k"), F.col("e").alias("vec"), F.lit(10.0).alias("scale"), F.lit(-2.0).alias("bias"))
    return flat(channels(spark, vector_stimuli(spark, sf_dir), {"frame_vectors": rows.select("stim_id", "t", F.col("e").alias("vec")), "prompts": prompts}, "VisualSemantic"))


@query(f"""WITH {SEEN}, q AS (SELECT i AS k, e AS v FROM e WHERE i < 12), u AS (SELECT stim_id, i, round_even(t + 2, 0)::INTEGER AS bin, e FROM e), z AS (SELECT stim_id, i, bin, k, exp(10 * list_cosine_similarity(e, v)) AS x FROM u, q), p AS (SELECT stim_id, bin, k + 1 AS k, x / sum(x) OVER (PARTITION BY i) AS x FROM z),
v AS (SELECT stim_id, bin, unnest(e) AS x, generate_subscripts(e, 1) AS k FROM u), f AS (SELECT stim_id, round_even(t, 0)::INTEGER AS bin, unnest(e[1:16]) AS x, generate_subscripts(e[1:16], 1) AS k FROM e)
{_vector('audio/high_level/clap_embedding', 'v')} UNION ALL {_vector('audio/high_level/clap_probe', 'p')} UNION ALL {_vector('visual/high_level_static/dino_embedding', 'f')}""")
def graph_sound_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of four seconds against twelve prompts, a fixed vocabulary; and features of frames."""
    rows = vectors(spark, sf_dir)
    prompts = rows.where("i < 12").select(F.col("i").alias("k"), F.col("e").alias("vec"), F.lit(10.0).alias("scale"))
    sound = rows.select("stim_id", F.col("t").alias("start"), (F.col("t") + 4).alias("end"), F.col("e").alias("vec"))
    native = {"sound_vectors": sound, "sound_prompts": prompts, "frame_features": rows.select("stim_id", "t", F.slice("e", 1, 16).alias("vec"))}
    return flat(channels(spark, vector_stimuli(spark, sf_dir), native, "AudioClap", "VisualDino"))


@query(f"""WITH {NATIVE}, {BOXES}, f AS (SELECT stim_id, t, count(*) AS n, max((x2 - x1) * (y2 - y1) / (width * height)) AS area, avg(score) AS prob FROM boxes WHERE score >= 0.9 GROUP BY ALL),
k AS (SELECT stim_id, t, event_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, (event_id % 7) / 7.0::DOUBLE AS kp FROM boxes WHERE score >= 0.7), n AS (SELECT stim_id, t, count(*) AS n, avg(kp) AS kp FROM k GROUP BY ALL),
d AS (SELECT a.stim_id, a.t, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) / sqrt(640.0::DOUBLE ** 2 + 360.0::DOUBLE ** 2) AS d FROM k a JOIN k b ON a.stim_id = b.stim_id AND a.t = b.t AND a.event_id < b.event_id GROUP BY ALL),
a AS (SELECT g.stim_id, g.bin, coalesce(f.n, 0)::DOUBLE AS n_faces, coalesce(f.n > 0, false)::INTEGER::DOUBLE AS faces_present, coalesce(f.area, 0) AS area, f.prob, coalesce(n.n, 0)::DOUBLE AS n_persons, coalesce(n.n > 0, false)::INTEGER::DOUBLE AS pose_present, n.kp, d.d FROM grid g LEFT JOIN f ON f.stim_id = g.stim_id AND f.t = g.time_sec LEFT JOIN n ON n.stim_id = g.stim_id AND n.t = g.time_sec LEFT JOIN d ON d.stim_id = g.stim_id AND d.t = g.time_sec)
{' UNION ALL '.join(f"SELECT stim_id, '{p}' AS path, bin, {out(f'round({c}, 6)')} FROM a" for p, c in (('visual/faces_bodies_gaze/n_faces', 'n_faces'), ('visual/faces_bodies_gaze/faces_present', 'faces_present'), ('visual/faces_bodies_gaze/max_face_frac', 'area'), ('visual/faces_bodies_gaze/face_det_prob', 'prob'), ('visual/faces_bodies_gaze/n_persons', 'n_persons'), ('visual/faces_bodies_gaze/pose_present', 'pose_present'), ('visual/faces_bodies_gaze/mean_kp_score', 'kp'), ('social/n_agents', 'n_persons'), ('social/min_pair_distance', 'd')))}""")
def graph_faces_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boxes(spark, sf_dir)
    return flat(channels(spark, event_stimuli(spark, sf_dir), {"frames_seen": grid(spark, sf_dir).select("stim_id", F.col("time_sec").alias("t")), "faces": found, "people": found}, "Faces", "Pose"))


_SAID = """CASE WHEN id % 7 = 0 THEN 'no object here' WHEN id % 7 = 1 THEN 'broken {"setting": ' ELSE 'Sure: {"setting": "place ' || id % 5 || '", "depicted_emotion": "calm", "valence": "' || (id % 9) / 8.0::DOUBLE || '", "arousal": "high"} done' END"""


@query(f"""WITH {NATIVE}, w AS (SELECT stim_id, event_id % 140 AS k, min(event_id) AS id FROM native GROUP BY ALL), r AS (SELECT stim_id, k, id % 7 > 1 AS ok, id FROM w), c AS (SELECT *, unnest(range(5 * k, least(5 * k + 5, {BINS} - 1) + 1))::INTEGER AS bin FROM r),
l AS (SELECT stim_id, bin, arg_max(ok, k) AS ok, arg_max(id, k) AS id FROM c GROUP BY ALL), a AS (SELECT g.stim_id, g.bin, ok, id FROM grid g LEFT JOIN l USING (stim_id, bin))
SELECT stim_id, 'situation/setting' AS path, bin, {out(label="CASE WHEN ok THEN 'place ' || id % 5 END")} FROM a UNION ALL SELECT stim_id, 'affect/depicted/vlm_emotion', bin, {out(label="CASE WHEN ok THEN 'calm' END")} FROM a UNION ALL
SELECT stim_id, 'affect/depicted/vlm_valence', bin, {out("CASE WHEN ok THEN round((id % 9) / 8.0::DOUBLE, 6) END")} FROM a UNION ALL
SELECT stim_id, path, bin, {out()} FROM a, (VALUES ('social/interaction_type'), ('social/dominance'), ('situation/scene_description'), ('situation/indoor_outdoor'), ('affect/depicted/vlm_arousal')) x(path)""")
def graph_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply for each window of five seconds; some are no objects, or broken."""
    rows = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stim_id"), (F.col("event_id") % 140).alias("k")).agg(F.min("event_id").alias("id"))
    said = F.concat(F.lit('Sure: {"setting": "place '), (F.col("id") % 5).cast("string"), F.lit('", "depicted_emotion": "calm", "valence": "'), (F.col("id") % 9 / F.lit(8.0)).cast("string"), F.lit('", "arousal": "high"} done'))
    reply = F.when(F.col("id") % 7 == 0, "no object here").when(F.col("id") % 7 == 1, 'broken {"setting": ').otherwise(said)
    replies = rows.select("stim_id", "k", (5 * F.col("k")).cast("double").alias("start"), (5 * F.col("k") + 5).cast("double").alias("end"), reply.alias("reply"))
    return flat(channels(spark, event_stimuli(spark, sf_dir), {"replies": replies}, "Reasoning"))


@query(f"""WITH {TALK}, {TEMPLATE}, made(path) AS (VALUES ('audio/speech/word_rate'), ('audio/speech/speech_present'), ('audio/speech/asr_text'), ('language/lexical/word_length'), ('language/lexical/freq_zipf'), ('language/lexical/valence'), ('affect/depicted/text_sentiment'), ('affect/depicted/text_sentiment_polarity'), ('affect/depicted/text_sentiment_top'))
SELECT path, dtype, (SELECT count(*) FROM grid)::BIGINT AS n_bins, CASE WHEN path IN (SELECT path FROM made) THEN (SELECT count(*) FROM grid) ELSE 0 END::BIGINT AS n_applicable FROM template""")
def graph_constant_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every channel of the template for every bin of every transcript, whatever was extracted."""
    stimuli, native = talk(spark, sf_dir)
    nodes = [n for n in NODES if n.name in ("ASR", "LanguageLexical", "TextSentiment", "VisualMotion")]  # the last has no table to read
    done = graph.run(nodes, stimuli.withColumn("modality", F.lit("audio-only")), native, sources.template(spark))
    return done.values.groupBy("path", "dtype").agg(F.count("*").alias("n_bins"), F.count_if("applicable").alias("n_applicable"))


@query("""WITH x AS (SELECT 'language/embedding/meaning' AS path, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1)::INTEGER AS comp_index FROM embeddings)
SELECT 'language__embedding__meaning__d' || (comp_index - 1) AS var_name, 'language' AS class, 'high' AS level, comp_index, count(*)::BIGINT AS n, round(avg(v), 6) AS mean FROM x GROUP BY comp_index""")
def channel_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a vector channel with the names and levels of their variables."""
    rows = read(spark, sf_dir, "embeddings").select(F.lit("language/embedding/meaning").alias("path"), scalars.wide(F.col("embedding")).alias("vec"))
    kinds = rows.groupBy("path").agg(F.lit("vector").alias("dtype"), F.max(F.size("vec")).alias("dim"), F.lit(None).cast("array<string>").alias("components"))
    named = shape.with_info(shape.expand_vectors(rows), shape.feature_info(shape.template_of(kinds)))
    return named.groupBy("var_name", "class", "level", "comp_index").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))

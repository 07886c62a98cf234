"""Transcript queries: documents are stories read at three words a second, conversations are transcripts with a segment for each turn."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import grid as G
from gridloom.operators import signals as S
from gridloom.operators import spans
from gridloom.plans.registry import query, read
from gridloom.sources import stimuli as sources

LEXICON = [(0, "the", "5.1"), (1, "of", "4.2"), (2, " The ", "5.5"), (3, "and", "x"), (4, "in", "4.0"), (5, "la", "3.3"), (6, "de", "2.2"), (7, "die", "1.5"), (8, "and", "3.9"), (9, "or", None)]


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("stim_id"), "text")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stim_id, i, role, text, n, start, end): turns one after the other, three words a second."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stim_id"), F.col("turn").alias("i"), "role", "text", F.size(scalars.words_of(F.col("text"))).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("stim_id").orderBy("i", "text"))
    return rows.withColumn("start", (so_far - F.col("n")) / F.lit(3.0)).withColumn("end", so_far / F.lit(3.0))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stim_id"), F.size(scalars.words_of(F.col("text"))).alias("n"))
    return words.groupBy("stim_id").agg((F.sum("n") / F.lit(3.0)).alias("duration_sec"))


WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
STORY = rf"""story AS (SELECT doc_id AS stim_id, len({WORDS}) AS n, len({WORDS}) / 3.0::DOUBLE AS duration_sec FROM documents),
sents AS (SELECT doc_id AS stim_id, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', concat('\1', chr(30)), 'g'), chr(30)), lambda t: list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')), lambda ws: len(ws) > 0) AS s FROM documents),
seg AS (SELECT stim_id, unnest(s) AS ws, generate_subscripts(s, 1) - 1 AS seg_idx FROM sents),
flat AS (SELECT stim_id, seg_idx, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS word_idx FROM seg),
words AS (SELECT stim_id, seg_idx::INTEGER AS seg_idx, word_idx::INTEGER AS word_idx, (row_number() OVER (PARTITION BY stim_id ORDER BY seg_idx, word_idx) - 1)::INTEGER AS i, text FROM flat),
grid AS (SELECT stim_id, unnest(range(floor(duration_sec + 1e-9)::INTEGER))::INTEGER AS bin FROM story)"""
TALK = f"""talk AS (SELECT conv_id AS stim_id, turn AS i, role, text, len({WORDS}) AS n FROM conversations),
segs AS (SELECT *, (sum(n) OVER w - n) / 3.0::DOUBLE AS "start", sum(n) OVER w / 3.0::DOUBLE AS "end" FROM talk WINDOW w AS (PARTITION BY stim_id ORDER BY i, text)),
long AS (SELECT stim_id, floor(sum(n) / 3.0::DOUBLE + 1e-9)::INTEGER AS n_bins FROM talk GROUP BY 1),
grid AS (SELECT stim_id, unnest(range(n_bins))::INTEGER AS bin FROM long),
lohi AS (SELECT s.*, greatest(round_even("start", 0)::INTEGER, 0) AS lo, least(round_even("end", 0)::INTEGER, n_bins - 1) AS hi FROM segs s JOIN long USING (stim_id)),
covered AS (SELECT stim_id, i, n, role, unnest(range(lo, hi + 1))::INTEGER AS bin FROM lohi WHERE lo <= hi)"""


@query(f"WITH {STORY} SELECT stim_id, n::INTEGER AS n_words, round(duration_sec, 6) AS duration_sec FROM story")
def text_stimulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.text_stimuli(stories(spark, sf_dir)).withColumn("duration_sec", F.round("duration_sec", 6))


@query(f"""WITH {STORY} SELECT stim_id, seg_idx, word_idx, i, text, round(i / 3.0::DOUBLE, 6) AS "start", round((i + 1) / 3.0::DOUBLE, 6) AS "end" FROM words""")
def text_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.text_timeline(stories(spark, sf_dir)).withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


@query(f"WITH {STORY}, c AS (SELECT stim_id, round_even(i / 3.0::DOUBLE, 0)::INTEGER AS bin, count(*) AS n FROM words GROUP BY ALL) SELECT g.stim_id, g.bin, coalesce(c.n, 0)::DOUBLE AS rate FROM grid g LEFT JOIN c USING (stim_id, bin)")
def word_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.text_rates(stories(spark, sf_dir)).select("stim_id", "bin", F.col("n").cast("double").alias("rate"))


@query(f"WITH {STORY}, c AS (SELECT stim_id, round_even(i / 3.0::DOUBLE, 0)::INTEGER AS bin, string_agg(text, ' ' ORDER BY i) AS label FROM words GROUP BY ALL) SELECT g.stim_id, g.bin, coalesce(c.label, '') AS label FROM grid g LEFT JOIN c USING (stim_id, bin)")
def asr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stories(spark, sf_dir)
    words = sources.text_timeline(docs).withColumn("bin", G.bin_index(F.col("start")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda w: w["text"]), " ")
    labels = words.groupBy("stim_id", "bin").agg(joined.alias("label"))
    return G.time_grid(sources.text_stimuli(docs)).join(labels, ["stim_id", "bin"], "left").select("stim_id", "bin", F.coalesce("label", F.lit("")).alias("label"))


_LINES = ", ".join(f"({n}, '{w}', {'NULL' if v is None else repr(v)})" for n, w, v in LEXICON)
NORMS = f"norms AS (SELECT word, arg_max(value, line) AS value FROM (SELECT line, lower(trim(word)) AS word, try_cast(value AS DOUBLE) AS value FROM (VALUES {_LINES}) t(line, word, value)) WHERE value IS NOT NULL GROUP BY 1)"


def lexicon(spark: SparkSession) -> DataFrame:
    """A table whose size Spark knows, so that words need not be shuffled to meet it; of rows of Python it knows none."""
    return sources.clean_norms(spark.createDataFrame(pa.table(dict(zip(("line", "word", "value"), map(list, zip(*LEXICON, strict=True)), strict=True)))))


@query("""WITH lines AS (SELECT p_partkey AS line, CASE WHEN p_partkey % 3 = 0 THEN ' ' || upper(split_part(p_name, ' ', 1)) || ' ' ELSE split_part(p_name, ' ', 2) END AS word, CASE WHEN p_partkey % 4 = 0 THEN 'n/a' ELSE p_retailprice::VARCHAR END AS value FROM part)
SELECT word, round(arg_max(value, line), 6) AS value FROM (SELECT line, lower(trim(word)) AS word, try_cast(value AS DOUBLE) AS value FROM lines) WHERE value IS NOT NULL GROUP BY 1""")
def norms_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon whose lines are parts: words in any letters, some without a number, most more than once."""
    words = F.split("p_name", " ")
    word = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.upper(words[0]), F.lit(" "))).otherwise(F.get(words, F.lit(1)))
    lines = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), word.alias("word"), F.when(F.col("p_partkey") % 4 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string")).alias("value"))
    return sources.clean_norms(lines).select("word", F.round("value", 6).alias("value"))


@query(f"""WITH {NORMS}, w AS (SELECT doc_id AS stim_id, nullif(regexp_replace(lower(unnest({WORDS})), '[^a-z'']+', '', 'g'), '') AS word FROM documents)
SELECT stim_id, count(*)::BIGINT AS n_words, count(value)::BIGINT AS n_found, round(avg(value), 6) AS value, round(avg(length(word)), 6) AS word_length FROM w LEFT JOIN norms USING (word) GROUP BY 1""")
def norm_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = stories(spark, sf_dir).select("stim_id", F.explode(scalars.words_of(F.col("text"))).alias("w")).select("stim_id", scalars.clean_word(F.col("w")).alias("word"))
    found = sources.lookup_norms(words, lexicon(spark))
    return found.groupBy("stim_id").agg(F.count("*").alias("n_words"), F.count("value").alias("n_found"), F.round(F.avg("value"), 6).alias("value"), F.round(F.avg(F.length("word")), 6).alias("word_length"))


@query(f"WITH {TALK} SELECT stim_id, i, coalesce(string_agg(text, ' ') OVER (PARTITION BY stim_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM talk")
def prior_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.prior_context(segments(spark, sf_dir), 3)


@query(f"WITH {TALK} SELECT stim_id, i, bin FROM covered")
def span_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.span_bins(segments(spark, sf_dir), transcripts(spark, sf_dir)).select("stim_id", "i", "bin")


@query(f"WITH {TALK}, r AS (SELECT stim_id, bin, avg(n) AS v FROM covered GROUP BY ALL) SELECT g.stim_id, g.bin, round(r.v, 6) AS v FROM grid g LEFT JOIN r USING (stim_id, bin)")
def span_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = segments(spark, sf_dir).withColumn("v", F.col("n").cast("double"))
    long = transcripts(spark, sf_dir)
    return spans.span_mean(length, long, G.time_grid(long)).withColumn("v", F.round("v", 6))


@query(f"WITH {TALK}, r AS (SELECT DISTINCT stim_id, bin FROM covered WHERE role = 'user') SELECT g.stim_id, g.bin, (r.bin IS NOT NULL)::INTEGER AS flag FROM grid g LEFT JOIN r USING (stim_id, bin)")
def speech_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = transcripts(spark, sf_dir)
    return spans.any_overlap(segments(spark, sf_dir).where("role = 'user'"), long, G.time_grid(long))


@query(f"""WITH {TALK}, t AS (SELECT stim_id, i AS seg_idx, n, "start", "end", unnest(range(n)) AS i FROM segs)
SELECT stim_id, seg_idx, i::INTEGER AS i, round("start" + (i + 0.5::DOUBLE) / n * greatest("end" - "start", 1e-3::DOUBLE), 6) AS t FROM t""")
def token_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = segments(spark, sf_dir).select("stim_id", F.col("i").alias("seg_idx"), "start", "end", F.posexplode(scalars.words_of(F.col("text"))).alias("i", "word"))
    return S.token_times(tokens).select("stim_id", "seg_idx", "i", F.round("t", 6).alias("t"))


@query(rf"""SELECT conv_id, turn, array_to_string(list_transform({WORDS}, lambda w: CASE WHEN starts_with(w, '@') AND length(w) > 1 THEN '@user' WHEN starts_with(w, 'http') THEN 'http' ELSE w END), ' ') AS said FROM conversations""")
def tweet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", scalars.tweet_text(F.col("text")).alias("said"))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, least(greatest(try_cast(nullif(regexp_extract(props, '[01](?:\\.\\d+)?|\\.\\d+'), '') AS DOUBLE), 0), 1) AS unit FROM events""")
def json_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = read(spark, sf_dir, "events").select("event_id", "props", scalars.first_json(F.col("props")).alias("object"))
    return replies.select("event_id", F.from_json("object", "k string")["k"].try_cast("double").alias("k"), scalars.unit_number(F.col("props")).alias("unit"))

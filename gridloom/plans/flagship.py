"""The flagship query: texts to timed words, words to a rate on the grid, the grid to segments, segments to the fastest ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import search
from gridloom.plans.on_text import STORY, word_rate
from gridloom.plans.registry import query
from gridloom.shared import staged


@query(f"""WITH {STORY}, c AS (SELECT stim_id, round_even(i / 3.0::DOUBLE, 0)::INTEGER AS bin, count(*) AS n FROM words GROUP BY ALL), v AS (SELECT g.stim_id, g.bin, coalesce(c.n, 0)::DOUBLE AS v FROM grid g LEFT JOIN c USING (stim_id, bin)),
s AS (SELECT stim_id, bin // 5 AS seg, round(avg(v), 4) AS v FROM v GROUP BY ALL), m AS (SELECT avg(v) AS mean, stddev_pop(v) AS std FROM s)
SELECT row_number() OVER (ORDER BY (v - mean) / std DESC, stim_id, seg)::INTEGER AS rank, stim_id, seg::INTEGER AS seg, round((v - mean) / std, 6) AS score FROM s, m QUALIFY rank <= 20""")
def fastest_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = word_rate(spark, sf_dir).select("stim_id", "bin", F.lit("audio/speech/word_rate").alias("path"), F.col("rate").alias("num"))
    segments = staged(search.segment_means(values, 5).select("stim_id", "seg", "path", "v"), "segments")
    found = search.search(segments, search.channel_stats(segments), {"audio/speech/word_rate": 1}, 20)
    return search.ranked(found).select("rank", "stim_id", "seg", F.round("score", 6).alias("score"))

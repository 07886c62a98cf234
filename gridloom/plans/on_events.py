"""Grid, span and sequence queries over ``events``: a stimulus is an event type, time is hours since 2024 began."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import grid as G
from gridloom.operators import signals as S
from gridloom.operators import spans
from gridloom.plans.registry import query, read

BINS = 720


def hours() -> Column:
    return (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / F.lit(3.6e9)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("stim_id"), "event_id", "user_id", hours().alias("t"), F.col("value").alias("v"), "props")


def stimuli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("stim_id")).distinct().withColumn("duration_sec", F.lit(float(BINS)))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.time_grid(stimuli(spark, sf_dir))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


NATIVE = f"""native AS (SELECT event_type AS stim_id, event_id, user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3.6e9 AS t, value AS v, props FROM events),
stimuli AS (SELECT DISTINCT event_type AS stim_id FROM events),
grid AS (SELECT stim_id, b::INTEGER AS bin, b::DOUBLE AS time_sec FROM stimuli, range({BINS}) r(b)),
binned AS (SELECT *, round_even(t, 0)::INTEGER AS bin FROM native)"""


@query(f"WITH {NATIVE} SELECT stim_id, bin, time_sec FROM grid")
def time_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir)


@query(f"WITH {NATIVE} SELECT event_id, bin FROM binned")
def bin_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("event_id", G.bin_index(F.col("t")).alias("bin"))


def _reduce(op: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(G.reduce_scalar(samples(spark, sf_dir), grid(spark, sf_dir), op), "v")

    run.__name__ = f"grid_{op}"
    return run


for _op, _agg in (("mean", "avg(v)"), ("max", "max(v)"), ("sum", "coalesce(sum(v), 0)")):
    query(f"WITH {NATIVE}, r AS (SELECT stim_id, bin, {_agg} AS v FROM binned GROUP BY ALL) SELECT g.stim_id, g.bin, round(r.v, 6) AS v FROM grid g LEFT JOIN r USING (stim_id, bin)")(_reduce(_op))
query(f"""WITH {NATIVE}, r AS (SELECT stim_id, bin, v, row_number() OVER (PARTITION BY stim_id, bin ORDER BY abs(t - bin), t, v) AS k FROM binned)
SELECT g.stim_id, g.bin, round(r.v, 6) AS v FROM grid g LEFT JOIN r ON r.stim_id = g.stim_id AND r.bin = g.bin AND k = 1""")(_reduce("nearest"))


@query(f"""WITH {NATIVE}, c AS (SELECT stim_id, bin, user_id::VARCHAR AS label, count(*) AS n FROM binned GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY stim_id, bin ORDER BY n DESC, label) AS k FROM c)
SELECT g.stim_id, g.bin, r.label FROM grid g LEFT JOIN r ON r.stim_id = g.stim_id AND r.bin = g.bin AND k = 1""")
def grid_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mode_label(samples(spark, sf_dir).withColumn("label", F.col("user_id").cast("string")), grid(spark, sf_dir))


@query(f"""WITH {NATIVE}, r AS (SELECT stim_id, bin, count(*) AS n FROM binned GROUP BY ALL)
SELECT g.stim_id, g.bin, coalesce(r.n, 0)::BIGINT AS n FROM grid g LEFT JOIN r USING (stim_id, bin)""")
def grid_event_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.event_count(samples(spark, sf_dir), grid(spark, sf_dir))


@query(f"WITH {NATIVE}, c AS (SELECT stim_id, avg(v) AS v FROM native GROUP BY 1) SELECT g.stim_id, g.bin, round(c.v, 6) AS v FROM grid g LEFT JOIN c USING (stim_id)")
def broadcast_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    constant = samples(spark, sf_dir).groupBy("stim_id").agg(F.avg("v").alias("v"))
    return rounded(G.broadcast_constant(constant, grid(spark, sf_dir)), "v")


@query(f"WITH {NATIVE}, m AS (SELECT stim_id, min(v) AS lo, max(v) AS hi FROM native GROUP BY 1) SELECT event_id, round((v - lo) / (hi - lo + 1e-6::DOUBLE), 6) AS v FROM native JOIN m USING (stim_id)")
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    ends = rows.groupBy("stim_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return rows.join(ends, "stim_id").select("event_id", F.round(G.min_max(F.col("v"), F.col("lo"), F.col("hi")), 6).alias("v"))


@query(f"""WITH {NATIVE}, r AS (SELECT stim_id, bin, count(*) FILTER (v > 400) AS n FROM binned GROUP BY ALL)
SELECT g.stim_id, g.bin, CASE WHEN r.n IS NOT NULL THEN (r.n > 0)::INTEGER END AS present FROM grid g LEFT JOIN r USING (stim_id, bin)""")
def presence_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = samples(spark, sf_dir).withColumn("v", (F.col("v") > 400).cast("double"))
    counted = G.reduce_scalar(seen, grid(spark, sf_dir), "sum")
    return counted.select("stim_id", "bin", G.presence(F.col("v")).alias("present"))


@query(f"""WITH {NATIVE}, s AS (SELECT DISTINCT stim_id FROM native), w AS (SELECT stim_id, k::INTEGER AS k, k::DOUBLE AS "start", k + 4.0::DOUBLE AS "end", k + 2.0::DOUBLE AS centre FROM s, range({BINS} - 4 + 1) r(k)) SELECT * FROM w""")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.window_starts(stimuli(spark, sf_dir), 4.0, 1.0)


@query(f"""WITH {NATIVE} SELECT stim_id, k::INTEGER AS k, (k * 5)::DOUBLE AS "start", least((k + 1) * 5, {BINS})::DOUBLE AS "end" FROM stimuli, range({BINS} // 5) r(k)""")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tumbling(stimuli(spark, sf_dir), 5.0)


@query(f"""WITH {NATIVE}, w AS (SELECT stim_id, k AS "start", k + 2.0 AS centre FROM stimuli, range({BINS} - 4 + 1) r(k)),
m AS (SELECT w.stim_id, w.centre, avg(n.v) AS v FROM w JOIN native n ON n.stim_id = w.stim_id AND n.t >= w."start" AND n.t < w."start" + 4 GROUP BY ALL),
r AS (SELECT stim_id, round_even(centre::DOUBLE, 0)::INTEGER AS bin, avg(v) AS v FROM m GROUP BY ALL)
SELECT g.stim_id, g.bin, round(r.v, 6) AS v FROM grid g LEFT JOIN r USING (stim_id, bin)""")
def window_center_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each sample names the windows it is in, by counting: no range join
    size, hop = 4, 1
    rows = samples(spark, sf_dir)
    first = F.greatest(F.floor((F.col("t") - size) / hop) + 1, F.lit(0))
    last = F.least(F.floor(F.col("t") / hop), F.lit((BINS - size) // hop))
    in_windows = rows.where(first <= last).select("stim_id", "v", F.explode(F.sequence(first, last)).alias("k"))
    means = in_windows.groupBy("stim_id", "k").agg(F.avg("v").alias("v")).select("stim_id", (F.col("k") * hop + size / 2).alias("t"), "v")
    return rounded(G.reduce_scalar(means, grid(spark, sf_dir), "mean"), "v")


@query(f"""WITH {NATIVE}, w AS (SELECT stim_id, event_id, floor(t / 5)::INTEGER AS win, row_number() OVER (PARTITION BY stim_id, floor(t / 5) ORDER BY t, event_id) - 1 AS place, count(*) OVER (PARTITION BY stim_id, floor(t / 5)) AS n FROM native),
p AS (SELECT DISTINCT n, CASE WHEN n = 1 THEN 0 ELSE (j * (n - 1)) // greatest(least(8, n) - 1, 1) END AS place FROM (SELECT DISTINCT n FROM w), range(8) r(j) WHERE j < least(8, n))
SELECT stim_id, win, event_id, place::INTEGER AS place FROM w JOIN p USING (n, place)""")
def window_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select("stim_id", F.floor(F.col("t") / 5).cast("int").alias("win"), "event_id", "t")
    return S.evenly_spaced(rows, ["stim_id", "win"], ["t", "event_id"], 8).select("stim_id", "win", "event_id", "place")


@query(f"""WITH {NATIVE}, f AS (SELECT stim_id, t, row_number() OVER (PARTITION BY stim_id ORDER BY t, v) - 1 AS f FROM native),
c AS (SELECT stim_id, clip, min(t) AS "start", max(t) AS "end" FROM f, range((SELECT max(f) // 8 + 1 FROM f)) r(clip) WHERE f BETWEEN clip * 8 AND clip * 8 + 15 GROUP BY ALL HAVING count(*) = 16)
SELECT stim_id, clip, round("start", 6) AS "start", round("end", 6) AS "end" FROM c""")
def clip_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.clip_windows(samples(spark, sf_dir), 16, 8), "start", "end")


def greedy_sql(candidates: str, gap: str) -> str:
    """Times kept one after the other, each the first that is ``gap`` or more after the last."""
    return f"""WITH RECURSIVE {NATIVE}, c AS ({candidates}), kept AS (SELECT stim_id, min(t) AS t FROM c GROUP BY 1
UNION ALL SELECT k.stim_id, min(c.t) FROM kept k JOIN c ON c.stim_id = k.stim_id AND {gap} GROUP BY k.stim_id, k.t) SELECT stim_id, round(t, 6) AS t FROM kept"""


@query(greedy_sql("SELECT stim_id, t FROM (SELECT stim_id, t, abs(v - lag(v) OVER (PARTITION BY stim_id ORDER BY t, v)) / 490 AS d FROM native) WHERE d > 0.1", "c.t - k.t >= 0.5"))
def cut_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = S.pair_delta(samples(spark, sf_dir)).withColumn("distance", F.col("delta") / 490)
    return rounded(S.detect_cuts(deltas, 0.1, 0.5), "t")


@query(f"WITH {NATIVE} SELECT stim_id, round(t, 6) AS t, round(abs(v - lag(v) OVER (PARTITION BY stim_id ORDER BY t, v)), 6) AS delta FROM native")
def frame_pair_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.pair_delta(samples(spark, sf_dir)), "t", "delta")


@query(greedy_sql("SELECT stim_id, t FROM native", "c.t + 1e-6::DOUBLE >= k.t + 2"))
def frame_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.decimate(samples(spark, sf_dir), 0.5), "t")


@query(f"""WITH {NATIVE}, cuts AS (SELECT stim_id, t FROM native WHERE v > 450)
SELECT g.stim_id, g.bin, count(c.t)::BIGINT AS shot FROM grid g LEFT JOIN cuts c ON c.stim_id = g.stim_id AND c.t <= g.time_sec GROUP BY ALL""")
def shot_index_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shot_index(samples(spark, sf_dir).where("v > 450"), grid(spark, sf_dir))


@query(f"""WITH {NATIVE}, r AS (SELECT stim_id, t, v, row_number() OVER (PARTITION BY stim_id ORDER BY abs(t - 360), t, v) AS k FROM native) SELECT stim_id, round(t, 6) AS t, round(v, 6) AS v FROM r WHERE k = 1""")
def nearest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.nearest_value(samples(spark, sf_dir), F.lit(360.0)), "t", "v")


@query(f"""WITH {NATIVE}, s AS (SELECT stim_id, t, max(v) AS v FROM native GROUP BY ALL), p AS (SELECT stim_id, b * 24.0::DOUBLE + 0.25 AS at FROM stimuli, range(30) r(b)),
b AS (SELECT p.stim_id, p.at, s.t, s.v FROM p ASOF LEFT JOIN s ON s.stim_id = p.stim_id AND s.t <= p.at), a AS (SELECT p.stim_id, p.at, s.t, s.v FROM p ASOF LEFT JOIN s ON s.stim_id = p.stim_id AND s.t >= p.at)
SELECT b.stim_id, b.at, round(CASE WHEN b.t IS NULL THEN a.v WHEN a.t IS NULL OR b.t = b.at THEN b.v ELSE b.v + (b.at - b.t) / (a.t - b.t) * (a.v - b.v) END, 6) AS v FROM b JOIN a ON a.stim_id = b.stim_id AND a.at = b.at""")
def interp_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = stimuli(spark, sf_dir).select("stim_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("d")).select("stim_id", (F.col("d") * 24.0 + 0.25).alias("at"))
    return rounded(S.interpolate(samples(spark, sf_dir), points), "v")


@query(f"""WITH {NATIVE}, c AS (SELECT stim_id, least(floor(v / 500 * 16), 15)::INTEGER AS b, count(*) AS n FROM native GROUP BY ALL), t AS (SELECT stim_id, sum(n) AS total FROM c GROUP BY 1)
SELECT stim_id, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM c JOIN t USING (stim_id) GROUP BY 1""")
def hist_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = samples(spark, sf_dir).withColumn("b", scalars.histogram_bin(F.col("v") / 500, 16))
    counts = bins.groupBy("stim_id").agg(F.array(*[F.count(F.when(F.col("b") == k, 1)).cast("double") for k in range(16)]).alias("n"))
    return counts.select("stim_id", F.round(scalars.entropy(F.col("n")), 6).alias("entropy"))


@query(f"""WITH {NATIVE} SELECT event_id, round(least(x2, 480) - greatest(x1, 0), 6) AS side, p AS score FROM (SELECT event_id, v - 12 AS x1, v + (user_id % 30) AS x2, (event_id % 100) / 100.0::DOUBLE AS p FROM native)
WHERE p >= 0.9 AND least(x2, 480) - greatest(x1, 0) >= 24""")
def detection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = samples(spark, sf_dir).select("event_id", (F.col("v") - 12).alias("x1"), (F.col("v") + F.col("user_id") % 30).alias("x2"), (F.col("event_id") % 100 / F.lit(100.0)).alias("score"))
    side = F.least("x2", F.lit(480.0)) - F.greatest("x1", F.lit(0.0))
    return boxes.where((F.col("score") >= 0.9) & (side >= 24)).select("event_id", F.round(side, 6).alias("side"), "score")


@query(f"""WITH {NATIVE}, r AS (SELECT stim_id, bin, count(*) AS n, avg(v) AS v FROM binned WHERE v > 100 GROUP BY ALL)
SELECT g.stim_id, g.bin::DOUBLE AS t, coalesce(r.n, 0)::BIGINT AS n, round(r.v, 6) AS v FROM grid g LEFT JOIN r USING (stim_id, bin)""")
def face_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = grid(spark, sf_dir).select("stim_id", F.col("time_sec").alias("t"))
    faces = samples(spark, sf_dir).where("v > 100").select("stim_id", G.bin_index(F.col("t")).cast("double").alias("t"), "v")
    return rounded(S.frame_means(frames, faces), "v")


@query(f"""WITH {NATIVE}, p AS (SELECT stim_id, v / 500 AS r, (user_id % 100) / 100.0::DOUBLE AS g, (event_id % 50) / 50.0::DOUBLE AS b FROM native)
SELECT stim_id, round(sqrt(var_pop(r - g) + var_pop((r + g) / 2 - b)) + 0.3 * sqrt(avg(r - g) ** 2 + avg((r + g) / 2 - b) ** 2), 6) AS colorfulness FROM p GROUP BY 1""")
def colorfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = samples(spark, sf_dir).select("stim_id", (F.col("v") / 500).alias("r"), (F.col("user_id") % 100 / F.lit(100.0)).alias("g"), (F.col("event_id") % 50 / F.lit(50.0)).alias("b"))
    return pixels.groupBy("stim_id").agg(F.round(S.colorfulness(F.col("r"), F.col("g"), F.col("b")), 6).alias("colorfulness"))


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a span of up to five hours."""
    return samples(spark, sf_dir).select("stim_id", F.col("t").alias("start"), (F.col("t") + F.col("v") / 100).alias("end"), "v", "event_id")


@query(f"""WITH {NATIVE}, s AS (SELECT stim_id, greatest(round_even(t, 0)::INTEGER, 0) AS lo, least(round_even(t + v / 100, 0)::INTEGER, {BINS - 1}) AS hi, event_id, v FROM native)
SELECT stim_id, bin, max_v FROM (SELECT g.stim_id, g.bin, r.v AS max_v FROM grid g LEFT JOIN (SELECT stim_id, b::INTEGER AS bin, v, row_number() OVER (PARTITION BY stim_id, b ORDER BY event_id DESC) AS k FROM (SELECT stim_id, event_id, v, unnest(range(lo, hi + 1)) AS b FROM s WHERE lo <= hi)) r ON r.stim_id = g.stim_id AND r.bin = g.bin AND r.k = 1)""")
def span_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.last_wins(event_spans(spark, sf_dir), stimuli(spark, sf_dir), grid(spark, sf_dir), F.col("v"), F.col("event_id"))
    return found.withColumnRenamed("value", "max_v")

"""Corpus queries: the numeric columns of ``lineitem`` are channels of suppliers, event means by user and day are channels with gaps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import corpus as C
from gridloom.operators import design, eigen, factors, layout, search, shape
from gridloom.operators import events as segmentation
from gridloom.plans.on_events import BINS, NATIVE, grid, samples
from gridloom.operators import grid as G
from gridloom.plans.registry import query, read
from gridloom.shared import staged

ITEMS = ["quantity", "extendedprice", "discount", "tax"]
ITEM_CLASS = {"quantity": "visual", "extendedprice": "visual", "discount": "audio", "tax": "affect"}
KINDS = ["click", "error", "purchase", "signup", "view"]
KIND_CLASS = {"click": "visual", "view": "visual", "error": "audio", "purchase": "affect", "signup": "affect"}


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stim_id, bin, channels): a supplier's line items in the order of order and line."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stim_id"), "l_orderkey", "l_linenumber", *[F.col(f"l_{c}").cast("double").alias(c) for c in ITEMS])
    return rows.withColumn("bin", F.row_number().over(Window.partitionBy("stim_id").orderBy("l_orderkey", "l_linenumber", *ITEMS)) - 1).drop("l_orderkey", "l_linenumber")


def gaps_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stim_id, bin, path, num): users' mean event values by day and type, null where a user has none on a day on which there are others."""
    rows = samples(spark, sf_dir).select(F.col("user_id").alias("stim_id"), F.floor(F.col("t") / 24).cast("int").alias("bin"), F.col("stim_id").alias("path"), "v")
    wide = rows.groupBy("stim_id", "bin").pivot("path", KINDS).agg(F.avg("v"))
    return wide.unpivot(["stim_id", "bin"], KINDS, "path", "num")


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.to_wide(gaps_long(spark, sf_dir), KINDS)


SQL_ITEMS = "items AS (SELECT l_suppkey AS stim_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS bin, l_quantity::DOUBLE AS quantity, l_extendedprice::DOUBLE AS extendedprice, l_discount::DOUBLE AS discount, l_tax::DOUBLE AS tax FROM lineitem), items_long AS (SELECT stim_id, bin, path, num FROM items UNPIVOT INCLUDE NULLS (num FOR path IN (quantity, extendedprice, discount, tax)))"
SQL_GAPS = f"""{NATIVE}, days AS (SELECT user_id AS stim_id, floor(t / 24)::INTEGER AS bin, stim_id AS path, avg(v) AS v FROM native GROUP BY ALL),
gaps AS (SELECT stim_id, bin, {', '.join(f"max(v) FILTER (path = '{k}') AS {k}" for k in KINDS)} FROM days GROUP BY ALL),
gaps_long AS (SELECT stim_id, bin, path, num FROM gaps UNPIVOT INCLUDE NULLS (num FOR path IN ({', '.join(KINDS)})))"""


def sql_corr(table: str, columns: list[str], group: str = "", null_to_zero: bool = True) -> str:
    g = f"{group}, " if group else ""
    by = f" GROUP BY {group}" if group else ""
    one = "SELECT {g}'{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)::BIGINT AS n, {r} AS r FROM {t}{by}"
    return " UNION ALL ".join(one.format(g=g, a=a, b=b, t=table, by=by, r="1.0::DOUBLE" if a == b else f"coalesce(corr({a}, {b}), 0)") for a in columns for b in columns)


def class_sql(classes: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in classes.items()) + " END"


@query(f"WITH {SQL_GAPS}, n AS (SELECT count(DISTINCT stim_id) AS n FROM gaps_long) SELECT path FROM gaps_long, n WHERE num IS NOT NULL GROUP BY path, n HAVING count(DISTINCT stim_id) = n")
def align_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.shared_paths(gaps_long(spark, sf_dir).where("num is not null"))


@query(f"WITH {SQL_GAPS} SELECT stim_id, bin, {', '.join(f'round({k}, 6) AS {k}' for k in KINDS)} FROM gaps")
def align_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps(spark, sf_dir).withColumns({k: F.round(k, 6) for k in KINDS})


@query(f"WITH {SQL_GAPS}, x AS (SELECT * FROM gaps_long UNION ALL SELECT stim_id, bin, 'never', NULL FROM gaps) SELECT path FROM x GROUP BY 1 HAVING count(num) > 0")
def drop_all_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gaps_long(spark, sf_dir)
    never = rows.where("path = 'click'").withColumns({"path": F.lit("never"), "num": F.lit(None).cast("double")})
    return shape.measured_paths(rows.union(never)).select("path")


@query(f"WITH {SQL_GAPS} SELECT path, round(avg((num IS NULL)::INTEGER), 6) AS missing FROM gaps_long GROUP BY 1 HAVING avg((num IS NULL)::INTEGER) <= 0.64")
def nan_frac_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.measured_paths(gaps_long(spark, sf_dir), 0.64).withColumn("missing", F.round("missing", 6))


@query(f"WITH {SQL_ITEMS} SELECT path, round(stddev_samp(num), 4) AS sd FROM items_long GROUP BY 1 HAVING stddev_samp(num) > 0")
def zero_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("constant", F.lit(1.0)).unpivot(["stim_id", "bin"], [*ITEMS, "constant"], "path", "num")
    return shape.varying_paths(rows).withColumn("sd", F.round("sd", 4))


@query(f"WITH {SQL_GAPS}, m AS (SELECT path, avg(num) AS mean, stddev_samp(num) AS sd FROM gaps_long GROUP BY 1) SELECT stim_id, bin, path, round(coalesce((num - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 0), 6) AS z FROM gaps_long JOIN m USING (path)")
def zscore_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against each channel's moments, which are few rows sent to the data rather than the data sorted by channel."""
    rows = gaps_long(spark, sf_dir)
    stats = rows.groupBy("path").agg(F.avg("num").alias("mean"), F.stddev("num").alias("sd"))
    z = F.coalesce((F.col("num") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0), F.lit(0.0))
    return rows.join(stats, "path").select("stim_id", "bin", "path", F.round(z, 6).alias("z"))


@query(f"WITH {SQL_GAPS}, m AS (SELECT *, avg(num) OVER w AS mean, stddev_samp(num) OVER w AS sd FROM gaps_long WINDOW w AS (PARTITION BY stim_id, path)) SELECT stim_id, bin, path, round(coalesce((num - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 0), 6) AS z FROM m")
def zscore_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps_long(spark, sf_dir).select("stim_id", "bin", "path", F.round(C.zscore(F.col("num"), Window.partitionBy("stim_id", "path")), 6).alias("z"))


@query(f"WITH {SQL_GAPS} SELECT stim_id, bin, {', '.join(f'round({k}, 6) AS e__{k}' for k in KINDS)} FROM gaps")
def scalars_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gaps_long(spark, sf_dir).withColumn("path", F.concat(F.lit("e/"), "path"))
    wide = shape.to_wide(rows, [f"e/{k}" for k in KINDS])
    return wide.withColumns({f"e__{k}": F.round(f"e__{k}", 6) for k in KINDS})


@query(f"WITH {SQL_GAPS} SELECT a, b, n, round(r, 6) AS r FROM ({sql_corr('gaps', KINDS)})")
def pairwise_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.moments(gaps(spark, sf_dir), KINDS).withColumn("r", F.round("r", 6))


@query(f"WITH {SQL_ITEMS} SELECT a, b, n, round(r, 6) AS r FROM ({sql_corr('items', ITEMS)})")
def complete_row_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.complete_rows(items(spark, sf_dir), ITEMS)
    return C.moments(rows, ITEMS).withColumn("r", F.round("r", 6))


@query(f"""WITH {SQL_GAPS}, e AS ({sql_corr('gaps', KINDS)}), b AS (SELECT a, b, r FROM e WHERE a <> b AND r IS NOT NULL UNION SELECT b, a, r FROM e WHERE a <> b AND r IS NOT NULL), k AS (SELECT DISTINCT ON (a, b) a, b, r FROM b)
SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY abs(r) DESC, b)::INTEGER AS rank, round(r, 6) AS r FROM k QUALIFY rank <= 2""")
def variable_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest variables of each by correlation."""
    return layout.neighbours(C.moments(gaps(spark, sf_dir), KINDS), 2).withColumn("r", F.round("r", 6))


@query(f"WITH {SQL_GAPS}, e AS ({sql_corr('gaps', KINDS)}) SELECT {class_sql(KIND_CLASS, 'a')} AS class_a, {class_sql(KIND_CLASS, 'b')} AS class_b, round(avg(abs(r)), 6) AS coupling FROM e WHERE a <> b GROUP BY ALL")
def class_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coupling(C.moments(gaps(spark, sf_dir), KINDS), KIND_CLASS).withColumn("coupling", F.round("coupling", 6))


@query(f"WITH {SQL_ITEMS}, e AS ({sql_corr('items', ITEMS)}) SELECT a, b, round(r, 6) AS r FROM e WHERE a < b AND abs(r) >= 0.001")
def corr_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.network(C.moments(items(spark, sf_dir), ITEMS), 0.001).select("a", "b", F.round("r", 6).alias("r"))


@query(f"WITH {SQL_ITEMS}, e AS ({sql_corr('items', ITEMS)}), c AS (SELECT {class_sql(ITEM_CLASS, 'a')} AS class_a, {class_sql(ITEM_CLASS, 'b')} AS class_b, avg(abs(r)) AS coupling FROM e WHERE a <> b GROUP BY ALL) SELECT class_a, class_b, round(coupling, 6) AS coupling FROM c WHERE class_a < class_b")
def class_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.coupling(C.moments(items(spark, sf_dir), ITEMS), ITEM_CLASS).where("class_a < class_b")
    return found.withColumn("coupling", F.round("coupling", 6))


def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = gaps(spark, sf_dir).groupBy("stim_id").agg(F.avg(F.coalesce("click", F.lit(0.0))).alias("v"))
    return C.median_split(means, F.col("v"))


SQL_DENSITY = "density AS (SELECT stim_id, avg(coalesce(click, 0)) AS v FROM gaps GROUP BY 1), rich AS (SELECT stim_id, v, v > (SELECT quantile_cont(v, 0.5) FROM density) AS rich FROM density)"


@query(f"WITH {SQL_GAPS}, {SQL_DENSITY} SELECT stim_id, round(v, 6) AS v, rich FROM rich")
def speech_density_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density(spark, sf_dir).withColumn("v", F.round("v", 6))


@query(f"""WITH {SQL_GAPS}, {SQL_DENSITY}, g AS (SELECT gaps.*, rich FROM gaps JOIN rich USING (stim_id)), e AS ({sql_corr('g', KINDS, 'rich')})
SELECT rich, {class_sql(KIND_CLASS, 'a')} AS class_a, {class_sql(KIND_CLASS, 'b')} AS class_b, round(avg(abs(r)), 6) AS coupling FROM e WHERE a <> b GROUP BY ALL""")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gaps(spark, sf_dir).join(density(spark, sf_dir).select("stim_id", "rich"), "stim_id")
    return C.coupling(C.moments(rows, KINDS, ["rich"]), KIND_CLASS, ["rich"]).withColumn("coupling", F.round("coupling", 6))


@query(f"WITH {SQL_GAPS}, av AS (SELECT DISTINCT user_id AS stim_id FROM native WHERE stim_id = 'error' AND v > 300) SELECT stim_id, bin, {', '.join(f'round({k}, 6) AS {k}' for k in KINDS)} FROM gaps WHERE stim_id IN (SELECT stim_id FROM av)")
def av_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = samples(spark, sf_dir).where("stim_id = 'error' and v > 300").select(F.col("user_id").alias("stim_id"))
    return gaps(spark, sf_dir).join(chosen, "stim_id", "left_semi").withColumns({k: F.round(k, 6) for k in KINDS})


@query(f"""WITH {SQL_GAPS}, m AS (SELECT path, avg(num) AS mean, stddev_samp(num) AS sd FROM gaps_long GROUP BY 1), z AS (SELECT stim_id, bin, {class_sql(KIND_CLASS, 'path')} AS class, coalesce((num - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 0) AS z FROM gaps_long JOIN m USING (path))
SELECT stim_id, bin, class, round(avg(z), 5) AS z FROM z GROUP BY ALL""")
def class_mean_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gaps_long(spark, sf_dir)
    stats = rows.groupBy("path").agg(F.avg("num").alias("mean"), F.stddev("num").alias("sd"))
    z = F.coalesce((F.col("num") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0), F.lit(0.0))
    of = F.create_map(*[F.lit(x) for kv in KIND_CLASS.items() for x in kv])
    named = rows.join(stats, "path").select("stim_id", "bin", of[F.col("path")].alias("class"), z.alias("z"))
    return named.groupBy("stim_id", "bin", "class").agg(F.round(F.avg("z"), 5).alias("z"))


@query("""SELECT count(*)::BIGINT AS n_stimuli, round(sum(n_chars) / 6000.0::DOUBLE, 4) AS minutes, count(DISTINCT source)::BIGINT AS n_sources, count(DISTINCT lang)::BIGINT AS n_modalities, max(n)::BIGINT AS largest_source FROM documents JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) USING (source)""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    by_source = by.groupBy("source").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.collect_set("lang").alias("langs"))
    return by_source.agg(F.sum("n").alias("n_stimuli"), F.round(F.sum("c") / 6000.0, 4).alias("minutes"), F.count("*").alias("n_sources"), F.size(F.array_distinct(F.flatten(F.collect_set("langs")))).cast("long").alias("n_modalities"), F.max("n").alias("largest_source"))


def grid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stim_id, bin, path, num): means and counts of events on the grid."""
    rows, g = samples(spark, sf_dir), grid(spark, sf_dir)
    mean = G.reduce_scalar(rows, g, "mean").select("stim_id", "bin", F.lit("value").alias("path"), F.col("v").alias("num"))
    count = G.event_count(rows, g).select("stim_id", "bin", F.lit("count").alias("path"), F.col("n").cast("double").alias("num"))
    return mean.union(count)


SQL_SEGMENTS = f"""{NATIVE}, b AS (SELECT stim_id, bin, avg(v) AS v, count(*) AS n FROM binned GROUP BY ALL), vals AS (SELECT g.stim_id, g.bin, b.v, coalesce(b.n, 0) AS n FROM grid g LEFT JOIN b USING (stim_id, bin)),
segments AS (SELECT stim_id, bin // 7 AS seg, 'value' AS path, round(avg(v), 4) AS v FROM vals GROUP BY ALL UNION ALL SELECT stim_id, bin // 7, 'count', round(avg(n), 4) FROM vals GROUP BY ALL),
stats AS (SELECT path, avg(v) AS mean, stddev_pop(v) AS std FROM segments GROUP BY 1 HAVING round(stddev_pop(v), 4) > 0)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.segment_means(grid_values(spark, sf_dir), 7)


@query(f"WITH {SQL_SEGMENTS} SELECT stim_id, seg::INTEGER AS seg, path, (seg * 7)::DOUBLE AS t0, least((seg + 1) * 7, {BINS})::DOUBLE AS t1, round(v, 6) AS v FROM segments")
def segment_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).withColumn("v", F.round("v", 6))


@query(f"WITH {SQL_SEGMENTS} SELECT path, round(mean, 6) AS mean, round(std, 6) AS std FROM stats")
def segment_channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.channel_stats(segments(spark, sf_dir)).select("path", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""WITH {SQL_SEGMENTS}, s AS (SELECT stim_id, seg::INTEGER AS seg, avg(CASE path WHEN 'value' THEN 1 ELSE -1 END * (v - mean) / std) AS score, count(*) AS k FROM segments JOIN stats USING (path) WHERE v IS NOT NULL GROUP BY ALL)
SELECT row_number() OVER (ORDER BY score DESC, stim_id, seg)::INTEGER AS rank, stim_id, seg, round(score, 6) AS score, k FROM s QUALIFY rank <= 20""")
def segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = staged(segments(spark, sf_dir), "segments")
    return search.ranked(search.search(found, search.channel_stats(found), {"value": 1, "count": -1}, 20)).select("rank", "stim_id", "seg", F.round("score", 6).alias("score"), "k")


@query(f"WITH {SQL_SEGMENTS} SELECT stim_id, seg::INTEGER AS seg, (seg * 7)::DOUBLE AS t0, path, round((v - mean) / std, 6) AS z FROM segments JOIN stats USING (path)")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments(spark, sf_dir)
    return search.timeline(found, search.channel_stats(found)).withColumn("z", F.round("z", 6))


@query(f"WITH {SQL_ITEMS}, s AS (SELECT *, bin // 10 AS seg FROM items) SELECT stim_id, seg::INTEGER AS seg, count(*)::BIGINT AS n, max(bin) - min(bin) AS dur FROM s GROUP BY ALL HAVING count(*) = 10")
def design_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = design.design_segments(items(spark, sf_dir), 10)
    return rows.groupBy("stim_id", "seg").agg(F.count("*").alias("n"), (F.max("bin") - F.min("bin")).cast("long").alias("dur"))


_PAIRS = [(a, b) for i, a in enumerate(ITEMS) for b in ITEMS[i:]]


@query(f"""WITH {SQL_ITEMS}, s AS (SELECT stim_id, bin // 10 AS seg, {', '.join(f'round({c} * 100)::BIGINT AS {c}' for c in ITEMS)} FROM items)
SELECT stim_id, seg::INTEGER AS seg, count(*)::BIGINT AS n, {', '.join(f'sum({c})::DOUBLE / 1e2::DOUBLE AS s_{c}' for c in ITEMS)}, {', '.join(f'sum({a} * {b})::DOUBLE / 1e8::DOUBLE AS p_{a}_{b}' for a, b in _PAIRS)} FROM s GROUP BY ALL HAVING count(*) = 10""")
def segment_suffstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of hundredths, whose sums are exact in any order; each is divided once."""
    whole = items(spark, sf_dir).withColumns({c: F.round(F.col(c) * 100) for c in ITEMS})
    stats = design.sufficient_stats(design.design_segments(whole, 10), ITEMS)
    sums = [(F.col("s")[k] / 1e2).alias(f"s_{c}") for k, c in enumerate(ITEMS)]
    return stats.select("stim_id", "seg", "n", *sums, *[(F.col("ss")[k] / 1e8).alias(f"p_{a}_{b}") for k, (a, b) in enumerate(_PAIRS)])


_THREE = ["quantity", "discount", "tax"]


@query(f"""WITH {SQL_ITEMS}, c AS (SELECT stim_id, bin // 10 AS seg, count(*) AS n, {', '.join(f'var_samp({c}) + 1e-3::DOUBLE AS v_{c}' for c in _THREE)}, covar_samp(quantity, discount) AS d, covar_samp(quantity, tax) AS e, covar_samp(discount, tax) AS f FROM items GROUP BY ALL HAVING count(*) = 10)
SELECT stim_id, seg::INTEGER AS seg, n::BIGINT AS n, round(ln(v_quantity * (v_discount * v_tax - f * f) - d * (d * v_tax - e * f) + e * (d * f - e * v_discount)), 6) AS log_det FROM c""")
def segment_log_det(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How varied each segment's quantities, discounts and taxes are together."""
    stats = design.sufficient_stats(design.design_segments(items(spark, sf_dir), 10), _THREE)
    return design.segment_log_dets(stats, len(_THREE)).withColumn("log_det", F.round("log_det", 6))


def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as z-scores of the whole table."""
    rows = items(spark, sf_dir)
    m = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in ITEMS], *[F.stddev(c).alias(f"d_{c}") for c in ITEMS]).first()
    return rows.select("stim_id", "bin", *[((F.col(c) - F.lit(m[f"m_{c}"])) / F.lit(m[f"d_{c}"] or 1.0)).alias(c) for c in ITEMS])


SQL_Z = f"""{SQL_ITEMS}, size AS MATERIALIZED (SELECT {', '.join(f'avg({c}) AS m_{c}, CASE WHEN stddev_samp({c}) > 0 THEN stddev_samp({c}) ELSE 1 END AS d_{c}' for c in ITEMS)} FROM items),
z AS (SELECT stim_id, bin, {', '.join(f'({c} - m_{c}) / d_{c} AS {c}' for c in ITEMS)} FROM items, size)"""
_SUMS = ["n", *(f"s_{c}" for c in ITEMS), *(f"p_{a}_{b}" for a, b in _PAIRS)]


def _chosen(steps: int, ridge: float = 1e-3) -> str:
    """The greedy choice in SQL, a table a step: of the segments not yet taken, the one with which the covariance's pivots have the largest product."""
    out = f"stats AS MATERIALIZED (SELECT stim_id, bin // 10 AS seg, count(*)::DOUBLE AS n, {', '.join(f'sum({c}) AS s_{c}' for c in ITEMS)}, {', '.join(f'sum({a} * {b}) AS p_{a}_{b}' for a, b in _PAIRS)} FROM z GROUP BY ALL HAVING count(*) = 10)"
    out += f", t0 AS (SELECT NULL::BIGINT AS stim_id, NULL::BIGINT AS seg, {', '.join(f'0.0::DOUBLE AS {c}' for c in _SUMS)})"
    for k in range(1, steps + 1):
        taken = " UNION ALL ".join(f"SELECT stim_id, seg FROM t{i}" for i in range(k))
        rows = f"SELECT s.stim_id, s.seg, {', '.join(f's.{c} + t.{c} AS {c}' for c in _SUMS)} FROM (SELECT * FROM stats ANTI JOIN ({taken}) USING (stim_id, seg)) s, t{k - 1} t"
        of = lambda i, j: f"(p_{ITEMS[i]}_{ITEMS[j]} - s_{ITEMS[i]} * s_{ITEMS[j]} / n) / (n - 1){f' + {ridge}::DOUBLE' if i == j else ''} AS c0_{i}_{j}"
        rows = f"SELECT *, {', '.join(of(i, j) for i in range(4) for j in range(i, 4))} FROM ({rows})"
        for q in range(3):  # what a pivot leaves of the rows below it
            rows = f"SELECT *, {', '.join(f'c{q}_{i}_{j} - c{q}_{q}_{i} * c{q}_{q}_{j} / c{q}_{q}_{q} AS c{q + 1}_{i}_{j}' for i in range(q + 1, 4) for j in range(i, 4))} FROM ({rows})"
        out += f", t{k} AS MATERIALIZED (SELECT stim_id, seg, {', '.join(_SUMS)}, {' + '.join(f'ln(c{q}_{q}_{q})' for q in range(4))} AS objective FROM ({rows}) ORDER BY objective DESC, stim_id, seg LIMIT 1)"
    return out + " " + " UNION ALL ".join(f"SELECT {k} AS step, stim_id, seg::INTEGER AS seg, round(objective, 6) AS objective FROM t{k}" for k in range(1, steps + 1))


@query(f"WITH {SQL_Z}, {_chosen(20)}")
def d_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = design.segment_stats(standardized(spark, sf_dir), 10, ITEMS)
    return spark.createDataFrame(design.greedy(stats, len(ITEMS), 20), "step int, stim_id long, seg int, objective double").withColumn("objective", F.round("objective", 6))


@query()
def random_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = design.sufficient_stats(design.design_segments(standardized(spark, sf_dir), 10), ITEMS).persist()
    trace = design.random_trace(stats, len(ITEMS), 20, 20)
    stats.unpersist()
    return spark.createDataFrame(trace, "step int, objective double")


def vector_components(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, np.ndarray]:
    rows = read(spark, sf_dir, "embeddings")
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    _, _, cov = factors.vector_moments(rows, "embedding", dim)
    return factors.principal(cov)


@query()
def pca_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, _ = vector_components(spark, sf_dir)
    eigen = spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(values)], "k int, value double")
    return C.explained(eigen).withColumns({c: F.round(c, 6) for c in ("percent", "cumulative")})


@query(f"""WITH {SQL_ITEMS}, e AS (SELECT row_number() OVER (ORDER BY value DESC, path) AS k, value FROM (SELECT path, var_samp(num) / avg(abs(num)) AS value FROM items_long GROUP BY path)), c AS (SELECT k, sum(100 * value / (SELECT sum(value) FROM e)) OVER (ORDER BY k) AS cumulative FROM e)
SELECT p.percent::DOUBLE AS percent, min(k)::INTEGER AS k FROM c, (VALUES (80.0), (90.0)) p(percent) WHERE cumulative >= percent - 1e-9 GROUP BY 1""")
def pcs_to_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the line items' channels, by variance over mean size, make up 80 and 90 percent of it all."""
    rows = items(spark, sf_dir)
    found = rows.agg(*[(F.var_samp(c) / F.avg(F.abs(c))).alias(c) for c in ITEMS]).unpivot([], ITEMS, "path", "value")
    return C.components_to(C.explained(found.select(F.row_number().over(Window.orderBy(F.col("value").desc(), "path")).alias("k"), "value")))


def item_factors(spark: SparkSession, sf_dir: str, m: int = 1) -> tuple[np.ndarray, np.ndarray]:
    matrix = factors.correlation_matrix(C.moments(items(spark, sf_dir), ITEMS), ITEMS)
    return matrix, factors.factor_analysis(matrix, m)


def _power(name: str, matrix: str) -> str:
    """The leading pair of a matrix of four in SQL: the matrix, squared forty times over, is the product of the vector with itself; the largest entry is positive."""
    square = "[" + ", ".join("[" + ", ".join("(" + " + ".join(f"m[{i}][{h}] * m[{h}][{j}]" for h in range(1, 5)) + ") / f" for j in range(1, 5)) + "]" for i in range(1, 5)) + "]"
    size = " + ".join(f"list_dot_product(m[{i}], m[{i}])" for i in range(1, 5))
    value = " + ".join(f"v[{i}] * list_dot_product(s[{i}], v)" for i in range(1, 5))
    return f"""{name}_steps AS (SELECT 0 AS k, s AS m FROM {matrix} UNION ALL SELECT k + 1, {square} FROM (SELECT k, m, {size} AS f FROM {name}_steps WHERE k < 40)),
{name}_row AS (SELECT m[list_position(d, list_max(d))] AS r FROM (SELECT m, [{', '.join(f'm[{i}][{i}]' for i in range(1, 5))}] AS d FROM {name}_steps WHERE k = 40)),
{name} AS MATERIALIZED (SELECT v, {value} AS value FROM (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r)) * CASE WHEN list_max(r) >= -list_min(r) THEN 1 ELSE -1 END) AS v FROM {name}_row), {matrix})"""


_AT = range(1, len(ITEMS) + 1)
_STEP = f"""SELECT k + 1 AS k, load, noise_now AS noise, list_max(list_transform(list_zip(noise_now, noise), lambda x: abs(x[1] - x[2]))) AS moved FROM (SELECT *, [{', '.join(f'greatest(1 - load[{i}] * through[{i}], 0.005::DOUBLE)' for i in _AT)}] AS noise_now FROM (
SELECT k, noise, through, list_transform(through, lambda x: x / (1 - list_dot_product(beta, l) + list_dot_product(beta, through))) AS load FROM (SELECT *, [{', '.join('list_dot_product(s[%d], beta)' % i for i in _AT)}] AS through FROM (
SELECT k, s, load AS l, noise, list_transform(list_zip(load, noise), lambda x: x[1] / x[2] / (1 + {' + '.join(f'load[{i}] ** 2 / noise[{i}]' for i in _AT)})) AS beta FROM em, whole WHERE k < 5000 AND moved > 1e-10))))"""
SQL_LOADINGS = f"""{SQL_Z}, whole AS MATERIALIZED (SELECT [{', '.join('[' + ', '.join('1' if a == b else f'corr({a}, {b})' for b in ITEMS) + ']' for a in ITEMS)}]::DOUBLE[][] AS s FROM items), {_power("top", "whole")},
em AS (SELECT 0 AS k, list_transform(v, lambda x: x * sqrt(value)) AS load, list_transform(v, lambda x: 0.5::DOUBLE) AS noise, 1.0::DOUBLE AS moved FROM top UNION ALL {_STEP}),
loadings AS MATERIALIZED (SELECT list_transform(load, lambda x: x * CASE WHEN list_max(load) >= -list_min(load) THEN 1 ELSE -1 END) AS load FROM em ORDER BY k DESC LIMIT 1)"""


def _solved(n: int) -> str:
    """The weights of scores in SQL: the correlations' equations for the loadings, an unknown after the other eliminated."""
    out = f"g0 AS (SELECT {', '.join(f'list_append(s[{i}], load[{i}]) AS r{i}' for i in range(1, n + 1))} FROM whole, loadings)"
    for j in range(1, n + 1):
        rows = [f"[{', '.join(f'r{i}[{c}] / r{i}[{i}]' if i == j else f'r{i}[{c}] - r{i}[{j}] / r{j}[{j}] * r{j}[{c}]' for c in range(1, n + 2))}] AS r{i}" for i in range(1, n + 1)]
        out += f", g{j} AS MATERIALIZED (SELECT {', '.join(rows)} FROM g{j - 1})"
    return out


@query(f"WITH RECURSIVE {SQL_LOADINGS} SELECT unnest({ITEMS}) AS variable, 1 AS factor, round(unnest(load), 6) AS loading FROM loadings")
def factor_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, loadings = item_factors(spark, sf_dir)
    return spark.createDataFrame([(v, f + 1, round(float(loadings[i, f]), 6)) for i, v in enumerate(ITEMS) for f in range(loadings.shape[1])], "variable string, factor int, loading double")


@query(f"WITH RECURSIVE {SQL_LOADINGS}, {_solved(len(ITEMS))} SELECT stim_id, bin, round({' + '.join(f'{c} * r{i}[{len(ITEMS) + 1}]' for i, c in zip(_AT, ITEMS, strict=True))}, 6) AS f1 FROM z, g{len(ITEMS)}")
def factor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix, loadings = item_factors(spark, sf_dir)
    scored = factors.scores([F.col(c) for c in ITEMS], factors.score_weights(matrix, loadings))
    return standardized(spark, sf_dir).select("stim_id", "bin", F.round(scored[0], 6).alias("f1"))


@query("""WITH b AS (SELECT user_id, count(*)::INTEGER AS d FROM events GROUP BY 1), r AS (SELECT d, max(k)::INTEGER AS most_factors FROM (SELECT DISTINCT d FROM b), range((SELECT max(d) + 1 FROM b)) r(k) WHERE k <= d AND (d - k) * (d - k) >= d + k GROUP BY d), m AS (SELECT *, least(10, greatest(1, d - 1))::INTEGER AS m FROM b JOIN r USING (d))
SELECT user_id, d, most_factors, m, d < 3 OR m > most_factors OR d > 120 AS components FROM m""")
def block_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as wide as users have events: how many numbers each would be reduced to, and whether by components or factors."""
    blocks = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("int").alias("d"))
    return blocks.select("user_id", "d", factors.block_rule(F.col("d")).alias("r")).select("user_id", "d", "r.*")


def _merged(n: int) -> str:
    """Average linkage in SQL: step by step the nearest two clusters, whose variables get the next number."""
    out = f"c0 AS MATERIALIZED (SELECT i AS v, i AS c FROM range({n}) r(i))"
    for k in range(n - 1):
        out += f", p{k} AS MATERIALIZED (SELECT x.c AS a, y.c AS b, avg(d) AS distance FROM c{k} x JOIN c{k} y ON x.c < y.c JOIN apart ON i = x.v AND j = y.v GROUP BY ALL ORDER BY distance, a, b LIMIT 1)"
        out += f", c{k + 1} AS MATERIALIZED (SELECT v, CASE WHEN c IN (a, b) THEN {n + k} ELSE c END AS c FROM c{k}, p{k})"
    return out + " " + " UNION ALL ".join(f"SELECT {k + 1} AS step, a::INTEGER AS a, b::INTEGER AS b, round(distance, 6) AS distance FROM p{k}" for k in range(n - 1))


@query(f"""WITH {SQL_GAPS}, e AS ({sql_corr('gaps', KINDS)}), apart AS MATERIALIZED (SELECT list_position({KINDS}, a) - 1 AS i, list_position({KINDS}, b) - 1 AS j, 1 - abs(r) AS d FROM e), {_merged(len(KINDS))}""")
def variable_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of the variables by average linkage: which clusters merge at each step, and how far they are apart."""
    merges = factors.average_linkage(factors.correlation_matrix(C.moments(gaps(spark, sf_dir), KINDS), KINDS))
    return spark.createDataFrame([(k + 1, a, b, round(d, 6)) for k, (a, b, d) in enumerate(merges)], "step int, a int, b int, distance double")


_WIDE = ["quantity", "extendedprice / 1000", "discount", "tax"]


@query(f"""WITH RECURSIVE {SQL_ITEMS}, whole AS MATERIALIZED (SELECT [{', '.join('[' + ', '.join(f'covar_samp({a}, {b})' for b in _WIDE) + ']' for a in _WIDE)}] AS s FROM items), {_power("first", "whole")},
rest AS MATERIALIZED (SELECT [{', '.join('[' + ', '.join(f's[{i}][{j}] - value * v[{i}] * v[{j}]' for j in range(1, 5)) + ']' for i in range(1, 5))}] AS s FROM whole, first), {_power("second", "rest")}
SELECT k, i::INTEGER AS i, round(value, 6) AS value, round(x, 6) + 0 AS x FROM (SELECT 1 AS k, value, unnest(v) AS x, unnest(range(1, 5)) AS i FROM first UNION ALL SELECT 2, value, unnest(v), unnest(range(1, 5)) FROM second)""")
def leading_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two leading eigenpairs of the covariance of line items (prices in thousands), without that matrix; a row an entry of the vector."""
    rows = items(spark, sf_dir).select(F.array(*(F.expr(c) for c in _WIDE)).alias("vec"))
    values, vectors = eigen.top_eigenpairs(rows, "vec", len(_WIDE), 2)
    found = [(k + 1, i + 1, round(float(values[k]), 6), round(float(vectors[i, k]), 6) + 0.0) for k in range(2) for i in range(len(_WIDE))]
    return spark.createDataFrame(found, "k int, i int, value double, x double")


@query()
def category_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class of line-item channels, and the embedding, reduced to a few numbers: category, method, d, m and percent explained."""
    out = []
    matrix = factors.correlation_matrix(C.moments(items(spark, sf_dir), ITEMS), ITEMS)
    for name in dict.fromkeys(ITEM_CLASS.values()):
        own = [i for i, c in enumerate(ITEMS) if ITEM_CLASS[c] == name]
        out.append((name, len(own), *factors.reduce_block(matrix[np.ix_(own, own)])[:3]))
    parts = {"embedding": range(64), "embedding, 24 of it": range(24)}  # too many variables for factors among ten, and few enough
    rows = read(spark, sf_dir, "embeddings")
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    _, _, cov = factors.vector_moments(rows, "embedding", dim)
    size = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    for name, part in parts.items():
        own = [i for i in part if i < dim]
        if own:
            out.append((name, len(own), *factors.reduce_block((cov / np.outer(size, size))[np.ix_(own, own)])[:3]))
    return spark.createDataFrame([(n, method, d, m, round(p, 6)) for n, d, method, m, p in out], "category string, method string, d int, m int, percent double")


_MORE = [*ITEMS, "twice", "less_tax"]


_KEPT = "".join(f", k{j} AS (SELECT *, {' AND '.join(['true', *(f'NOT (kept_{i} AND r_{i}_{j} > 0.999)' for i in range(j))])} AS kept_{j} FROM {f'k{j - 1}' if j else 'c'})" for j in range(len(_MORE)))


@query(f"""WITH {SQL_ITEMS}, r AS (SELECT *, quantity * 2 AS twice, 1 - tax AS less_tax FROM items), c AS (SELECT {', '.join(f'abs(corr({a}, {b})) AS r_{i}_{j}' for j, b in enumerate(_MORE) for i, a in enumerate(_MORE[:j]))} FROM r){_KEPT}
{' UNION ALL '.join(f"SELECT '{b}' AS variable FROM k{len(_MORE) - 1} WHERE kept_{j}" for j, b in enumerate(_MORE))}""")
def drop_collinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("twice", F.col("quantity") * 2).withColumn("less_tax", 1 - F.col("tax"))
    names = [*ITEMS, "twice", "less_tax"]
    kept = factors.kept_columns(factors.correlation_matrix(C.moments(rows, names), names), names)
    return spark.createDataFrame([(c,) for c in kept], "variable string")


@query("""WITH c AS (SELECT category, pc1 FROM (SELECT 'label ' || label AS category, 100 * max(v) / sum(v) AS pc1 FROM (SELECT label, k, sum(x * x) AS v FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY ALL) GROUP BY label))
(SELECT category, round(pc1, 6) AS pc1, 'least' AS side FROM c ORDER BY pc1, category LIMIT 5) UNION ALL (SELECT category, round(pc1, 6), 'most' FROM c ORDER BY pc1 DESC, category LIMIT 2)""")
def reducibility_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels whose vectors have the least and the most of their power in one component."""
    power = read(spark, sf_dir, "embeddings").select("label", F.posexplode(scalars.wide(F.col("embedding"))).alias("k", "x")).groupBy("label", "k").agg(F.sum(F.col("x") * F.col("x")).alias("v"))
    rows = power.groupBy("label").agg((100 * F.max("v") / F.sum("v")).alias("pc1")).select(F.concat(F.lit("label "), F.col("label").cast("string")).alias("category"), "pc1")
    least = rows.orderBy("pc1", "category").limit(5).withColumn("side", F.lit("least"))
    return least.union(rows.orderBy(F.col("pc1").desc(), "category").limit(2).withColumn("side", F.lit("most"))).withColumn("pc1", F.round("pc1", 6))


@query()
def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of each user's days."""
    return segmentation.event_segments(gaps(spark, sf_dir), KINDS)

"""Pixels and sound through ``annotate``: pictures that Spark paints from vectors, sound whose samples are quantities of line items."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.plans.annotate import annotate
from gridloom.plans.registry import query, read
from gridloom.sources import stimuli as sources

SIDE, SECONDS = 16, 20
PLANES = (0, 5, 11)  # where in the vector each colour begins
RATE, ORDERS = 4096, 4096  # samples a second, orders a stretch of sound

_PLANE = "greatest(0, least(255, floor(256::DOUBLE * (8::DOUBLE * e[(y + {s}) % 64 + 1] * e[(16 + x + {s}) % 64 + 1] + e[(32 + (y + x) % 32 + {s}) % 64 + 1])) + 128))::INTEGER"
_PIXELS = f"""v AS (SELECT vec_id, label::VARCHAR AS stim_id, round_even((vec_id % {2 * SECONDS}) * 0.5::DOUBLE, 0)::INTEGER AS bin, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) >= 64),
ky AS (SELECT *, unnest(range({SIDE})) AS y FROM v), kx AS (SELECT *, unnest(range({SIDE})) AS x FROM ky), px AS (SELECT vec_id, y, x, {', '.join(f'{_PLANE.format(s=s)} AS {c}' for c, s in zip('rgb', PLANES, strict=True))} FROM kx)"""
_TURN = f"{2 * math.pi!r}::DOUBLE / {SIDE}"


def _fourier(source: str, value: str) -> str:
    """The spectrum ``spec`` (vec_id, u, v, re, im) of a plane of pixels, rows first."""
    return f"""rowwise AS (SELECT vec_id, y, v, sum({value} * cos(v * x * {_TURN})) AS re, -sum({value} * sin(v * x * {_TURN})) AS im FROM {source}, range({SIDE}) r(v) GROUP BY ALL),
spec AS (SELECT vec_id, u, v, sum(re * cos(u * y * {_TURN}) + im * sin(u * y * {_TURN})) AS re, sum(im * cos(u * y * {_TURN}) - re * sin(u * y * {_TURN})) AS im FROM rowwise, range({SIDE}) r(u) GROUP BY ALL)"""


def _means(prefix: str, table: str, names: list[str]) -> str:
    pairs = ", ".join(names)
    return f"SELECT stim_id, '{prefix}/' || name AS path, bin, round(avg(num), 6) AS num FROM (SELECT vec_id, {pairs} FROM {table}) UNPIVOT (num FOR name IN ({pairs})) JOIN v USING (vec_id) WHERE bin < {SECONDS} GROUP BY ALL"


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stim_id, t, width, height, rgb): a small picture a vector, two a second of its label's film."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("stim_id"), (F.col("vec_id") % (2 * SECONDS) * 0.5).alias("t"), scalars.wide(F.col("embedding")).alias("e"))

    def pixel(k: Column, s: int) -> Column:
        y, x = F.floor(k / SIDE).cast("int"), k % SIDE
        e = lambda i: F.element_at("e", (i + s) % 64 + 1)
        value = F.floor(256.0 * (8.0 * e(y) * e(16 + x) + e(32 + (y + x) % 32))) + 128
        return F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), value))), 2, "0")

    pixels = F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda k: F.concat(*(pixel(k, s) for s in PLANES)))
    whole = rows.where((F.size("e") >= 64) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x)))
    return whole.select("stim_id", "t", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.unhex(F.array_join(pixels, "")).alias("rgb"))


def of_pictures(spark: SparkSession, sf_dir: str, prefix: str, *groups: str) -> DataFrame:
    frames = pictures(spark, sf_dir)
    films = frames.select("stim_id").distinct().select("stim_id", F.lit("video-only").alias("modality"), F.lit(float(SECONDS)).alias("duration_sec"))
    values, _ = annotate(films, {"frames": frames}, sources.template(spark).where(F.col("path").startswith(prefix)), ("core", *groups))
    return values.where("num is not null").select("stim_id", "path", "bin", F.round("num", 6).alias("num"))


@query(f"""WITH {_PIXELS}, c AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS gray, r - g AS rg, (r + g) / 2::DOUBLE - b AS yb, greatest(r, g, b) AS most, most - least(r, g, b) AS spread FROM px),
d AS (SELECT *, CASE WHEN spread = 0 THEN 0 WHEN most = r THEN ((g - b) / spread::DOUBLE + 6) % 6 WHEN most = g THEN (b - r) / spread::DOUBLE + 2 ELSE (r - g) / spread::DOUBLE + 4 END AS hue FROM c),
plain AS (SELECT vec_id, avg(gray) / 255 AS luminance, stddev_pop(gray) / 255 AS rms_contrast, sqrt(var_pop(rg) + var_pop(yb)) + 0.3::DOUBLE * sqrt(avg(rg) * avg(rg) + avg(yb) * avg(yb)) AS colorfulness, avg(r) / 255 AS r_mean, avg(g) / 255 AS g_mean, avg(b) / 255 AS b_mean,
avg(hue) / 6 AS hue_mean, avg(CASE WHEN most > 0 THEN spread / most::DOUBLE ELSE 0 END) AS sat_mean, avg(most) / 255 AS val_mean FROM d GROUP BY vec_id),
levels AS (SELECT vec_id, count(*) / {SIDE * SIDE}::DOUBLE AS p FROM c GROUP BY vec_id, floor(gray)), ent AS (SELECT vec_id, -sum(p * log2(p)) AS entropy FROM levels GROUP BY vec_id),
{_fourier("c", "gray")}, ring AS (SELECT vec_id, floor(sqrt((CASE WHEN u >= 8 THEN u - 16 ELSE u END) ** 2 + (CASE WHEN v >= 8 THEN v - 16 ELSE v END) ** 2)) AS f, avg(re * re + im * im) AS p FROM spec GROUP BY ALL),
slope AS (SELECT vec_id, regr_slope(ln(p), ln(f)) AS fft_slope FROM ring WHERE f BETWEEN 1 AND 7 GROUP BY vec_id), lows AS (SELECT * FROM plain JOIN ent USING (vec_id) JOIN slope USING (vec_id))
{_means("visual/low_level_static", "lows", ["luminance", "rms_contrast", "colorfulness", "entropy", "r_mean", "g_mean", "b_mean", "hue_mean", "sat_mean", "val_mean", "fft_slope"])}""")
def graph_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static low-level channels of pictures, all but the density of edges."""
    return of_pictures(spark, sf_dir, "visual/low_level_static").where("not endswith(path, 'edge_density')")


@query(f"""WITH {_PIXELS}, {_fourier("px", "((r + g + b) / 3::DOUBLE)")}, logs AS (SELECT *, ln(sqrt(re * re + im * im) + 1e-8::DOUBLE) AS l FROM spec),
around AS (SELECT vec_id, (u + du + {SIDE}) % {SIDE} AS u, (v + dv + {SIDE}) % {SIDE} AS v, avg(l) AS local FROM logs, range(-1, 2) a(du), range(-1, 2) b(dv) GROUP BY ALL),
residual AS (SELECT vec_id, u, v, re / exp(local) AS re, im / exp(local) AS im FROM spec JOIN around USING (vec_id, u, v)),
back AS (SELECT vec_id, u, x, sum(re * cos(v * x * {_TURN}) - im * sin(v * x * {_TURN})) AS re, sum(re * sin(v * x * {_TURN}) + im * cos(v * x * {_TURN})) AS im FROM residual, range({SIDE}) r(x) GROUP BY ALL),
energy AS (SELECT vec_id, y, x, (sum(re * cos(u * y * {_TURN}) - im * sin(u * y * {_TURN})) ** 2 + sum(re * sin(u * y * {_TURN}) + im * cos(u * y * {_TURN})) ** 2) / {SIDE**4}::DOUBLE AS e FROM back, range({SIDE}) r(y) GROUP BY ALL),
bell AS (SELECT d, sum(exp(-18 * {math.pi**2!r}::DOUBLE * f * f / {SIDE * SIDE}) * cos(f * d * {_TURN})) / {SIDE} AS w FROM range({SIDE}) r(d), range(-8, 8) s(f) GROUP BY d),
across AS (SELECT vec_id, y, (x + d) % {SIDE} AS x, sum(e * w) AS e FROM energy, bell GROUP BY ALL), heat AS (SELECT vec_id, (y + d) % {SIDE} AS y, x, sum(e * w) AS h FROM across, bell GROUP BY ALL),
span AS (SELECT vec_id, min(h) AS low, max(h) - min(h) AS width FROM heat GROUP BY vec_id), scaled AS (SELECT vec_id, (h - low) / (width + 1e-8::DOUBLE) AS h FROM heat JOIN span USING (vec_id)),
mean AS (SELECT vec_id, avg(h) AS saliency_mean, max(h) AS saliency_peak FROM scaled GROUP BY vec_id), area AS (SELECT vec_id, avg((h > 3 * saliency_mean)::INTEGER) AS salient_area_frac FROM scaled JOIN mean USING (vec_id) GROUP BY vec_id),
cells AS (SELECT vec_id, count(*) / {SIDE * SIDE}::DOUBLE AS p FROM scaled GROUP BY vec_id, least(floor(h * 16), 15)), ent AS (SELECT vec_id, -sum(p * log2(p)) AS saliency_entropy FROM cells GROUP BY vec_id),
all_of AS (SELECT * FROM mean JOIN area USING (vec_id) JOIN ent USING (vec_id)) {_means("visual/saliency_aesthetics_depth", "all_of", ["saliency_mean", "saliency_peak", "saliency_entropy", "salient_area_frac"])}""")
def graph_saliency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands out in pictures, by the spectral residual."""
    return of_pictures(spark, sf_dir, "visual/saliency_aesthetics_depth/sal", "vision")


def sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stim_id, samples, rate, start): the quantities of a flag's line items of one number, a stretch of orders a second; a stretch has a sample an order."""
    rows = read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("stim_id"), F.floor(F.col("l_orderkey") / ORDERS).cast("double").alias("start"), "l_orderkey", ((F.col("l_quantity").cast("double") - 25) / 25).alias("y"))
    stretches = rows.groupBy("stim_id", "start").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "y"))).alias("s"))
    return stretches.select("stim_id", F.col("s.y").alias("samples"), F.lit(RATE).alias("rate"), "start")


@query(f"""WITH y AS (SELECT l_returnflag || l_linenumber AS stim_id, l_orderkey // {ORDERS} AS s, (l_quantity::DOUBLE - 25) / 25 AS y, l_orderkey FROM lineitem), n AS (SELECT stim_id, s, count(*) AS n FROM y GROUP BY ALL),
i AS (SELECT stim_id, s, row_number() OVER (PARTITION BY stim_id, s ORDER BY l_orderkey, y) - 1 AS i, y FROM y UNION ALL SELECT stim_id, s, n, 0 FROM n),
z AS (SELECT *, ((y < 0) <> (coalesce(lag(y) OVER (PARTITION BY stim_id, s ORDER BY i), 0) < 0))::INTEGER AS turned FROM i), f AS (SELECT stim_id, s, unnest(range(1 + n // 512)) AS k FROM n),
framed AS (SELECT stim_id, s, k, i - 512 * k + 1024 AS j, y, turned FROM z JOIN f USING (stim_id, s) WHERE i - 512 * k + 1024 BETWEEN 0 AND 2047),
numbers AS (SELECT stim_id, s, k, sqrt(sum((y * (0.5::DOUBLE - 0.5::DOUBLE * cos({2 * math.pi!r}::DOUBLE * j / 2048))) ** 2) / 2048) AS rms, coalesce(sum(turned) FILTER (j > 0), 0) / 2047::DOUBLE AS zcr FROM framed GROUP BY ALL),
l AS (SELECT stim_id, max(s) AS last FROM n GROUP BY 1), b AS (SELECT stim_id, round_even(s + k / 8::DOUBLE, 0)::INTEGER AS bin, rms, zcr FROM numbers)
SELECT stim_id, 'audio/low_level/' || name AS path, bin, round(avg(num), 6) AS num FROM b UNPIVOT (num FOR name IN (rms, zcr)) JOIN l USING (stim_id) WHERE bin <= last GROUP BY ALL""")
def graph_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loudness, which the extractor takes from spectra and the SQL from the samples, and changes of sign."""
    heard = sound(spark, sf_dir)
    films = heard.groupBy("stim_id").agg((F.max("start") + 1).alias("duration_sec")).withColumn("modality", F.lit("audio-only"))
    values, _ = annotate(films, {"sound": heard}, sources.template(spark).where(F.col("path").startswith("audio/low_level")))
    return values.where("num is not null and path in ('audio/low_level/rms', 'audio/low_level/zcr')").select("stim_id", "path", "bin", F.round("num", 6).alias("num"))

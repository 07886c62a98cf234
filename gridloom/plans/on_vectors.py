"""Vector queries over ``embeddings``: a stimulus is a label, its utterances are in the order of vec_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import grid as G
from gridloom.operators import products, shape
from gridloom.operators import signals as S
from gridloom.plans.registry import query, read

PACE = 50.0  # utterances for each bin of the grid


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("stim_id"), F.col("vec_id").alias("i"), F.col("embedding").alias("vec"))


E = "e AS (SELECT label AS stim_id, vec_id AS i, embedding::DOUBLE[] AS e FROM embeddings), o AS (SELECT *, lag(e) OVER (PARTITION BY stim_id ORDER BY i) AS p FROM e)"


@query(f"WITH {E} SELECT stim_id, i, round(list_inner_product(e, p), 6) AS coherence FROM o")
def semantic_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coherence(utterances(spark, sf_dir)).withColumn("coherence", F.round("coherence", 6))


@query(f"WITH {E} SELECT stim_id, i, round(1 - list_inner_product(e, p), 6) AS surprise FROM o")
def semantic_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coherence(utterances(spark, sf_dir)).select("stim_id", "i", F.round(1 - F.col("coherence"), 6).alias("surprise"))


@query(f"WITH {E} SELECT a.stim_id, a.i, round(1 - max(list_inner_product(a.e, b.e)), 6) AS novelty FROM e a LEFT JOIN e b ON a.stim_id = b.stim_id AND b.i < a.i GROUP BY ALL")
def semantic_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.novelty(utterances(spark, sf_dir)).withColumn("novelty", F.round("novelty", 6))


@query(f"""WITH {E}, x AS (SELECT stim_id, i, unnest(e) AS v, generate_subscripts(e, 1) AS k FROM e), r AS (SELECT *, sum(v) OVER (PARTITION BY stim_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM x)
SELECT stim_id, i, round(sum(v * run) / sqrt(sum(run * run)) + 1e-9::DOUBLE * CASE WHEN count(run) > 0 THEN sum(v) END, 6) AS drift FROM r GROUP BY ALL""")
def semantic_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drift(utterances(spark, sf_dir)).withColumn("drift", F.round("drift", 6))


@query(f"""WITH x AS (SELECT label AS stim_id, round_even(vec_id / {PACE}::DOUBLE, 0)::INTEGER AS bin, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
n AS (SELECT label AS stim_id, floor(max(vec_id) / {PACE}::DOUBLE + 1)::INTEGER AS n FROM embeddings GROUP BY 1)
SELECT stim_id, bin, k::INTEGER AS k, round(avg(v), 6) AS v FROM x JOIN n USING (stim_id) WHERE bin < n GROUP BY ALL""")
def grid_mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = utterances(spark, sf_dir).select("stim_id", (F.col("i") / F.lit(PACE)).alias("t"), "vec")
    grid = G.time_grid(rows.groupBy("stim_id").agg((F.max("t") + 1).alias("duration_sec")))
    return G.reduce_vector(rows, grid).select("stim_id", "bin", F.posexplode("vec").alias("k", "v")).withColumn("v", F.round("v", 6))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS top FROM embeddings")
def argmax_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", scalars.argmax(F.col("embedding")).alias("top"))


@query("SELECT vec_id, round(embedding[3]::DOUBLE - embedding[1]::DOUBLE, 6) AS polarity FROM embeddings")
def polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = scalars.wide(F.col("embedding"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(v[2] - v[0], 6).alias("polarity"))


@query("""WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT label, k, avg(v) AS v FROM x GROUP BY ALL),
p AS (SELECT label, list(v ORDER BY k) AS prompt FROM m GROUP BY 1),
c AS (SELECT vec_id, p.label AS prompt, 10 * list_cosine_similarity(embedding::DOUBLE[], p.prompt) AS z FROM embeddings, p), d AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS w FROM c)
SELECT vec_id, prompt, round(w / sum(w) OVER (PARTITION BY vec_id), 6) AS p FROM d""")
def prompt_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax over ten times the cosine with each prompt; prompts are the labels' mean vectors, a fixed vocabulary."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", scalars.wide(F.col("embedding")).alias("e"))
    parts = rows.select("label", F.posexplode("e").alias("k", "v")).groupBy("label", "k").agg(F.avg("v").alias("v"))
    means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda p: p["v"]).alias("vec"))
    prompts = means.select(F.col("label").cast("long").alias("k"), F.col("label").alias("prompt"), "vec")
    probed = products.prompt_cosines(rows.select("vec_id", "e"), "e", prompts).withColumn("p", scalars.softmax(F.transform("cosines", lambda c: 10 * c["cosine"])))
    return probed.select("vec_id", F.explode(F.arrays_zip(F.transform("cosines", lambda c: c["prompt"]).alias("prompt"), "p")).alias("x")).select("vec_id", "x.prompt", F.round("x.p", 6).alias("p"))


@query("SELECT vec_id, generate_subscripts(embedding, 1)::INTEGER AS comp_index, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings")
def vector_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", scalars.wide(F.col("embedding")).alias("vec"))
    return shape.expand_vectors(rows).select("vec_id", "comp_index", F.round("value", 6).alias("value"))


@query("""WITH d AS (SELECT label, vec_id // 10 AS frame, vec_id AS i, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT a.label AS stim_id, a.frame AS t, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS d FROM d a JOIN d b ON a.label = b.label AND a.frame = b.frame AND a.i < b.i GROUP BY ALL""")
def min_pair_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = scalars.wide(F.col("vec"))
    people = utterances(spark, sf_dir).select("stim_id", F.floor(F.col("i") / 10).alias("t"), "i", v[0].alias("x"), v[1].alias("y"))
    return S.min_pair_distance(people).withColumn("d", F.round("d", 6))

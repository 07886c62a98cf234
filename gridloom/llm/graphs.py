"""Connected components of an edge table, by rounds of large-star and small-star contraction.

No link, component or node leaves the cluster. Each round is a minimum over neighbours, which is summed up before it is
shuffled, and a join of edges with those minima, whose hot keys Spark's adaptive join splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.storage import discard, new_path, stage


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Of edges (a, b), the nodes with a smaller node in their component: node, root (the component's smallest node).

    Loops, repeated and reversed edges change nothing; a null end drops its edge. Roots have no row of their own.
    """
    spark = edges.sparkSession
    pairs = edges.where("a is not null and b is not null and a <> b")
    path = new_path(spark, name)
    now = stage(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name, path)
    state = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        after_path = new_path(spark, name)
        after = stage(small, name, after_path)
        discard(spark, path)
        now, path = after, after_path
        was, state = state, after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def join_to_one(many: DataFrame, one: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``many`` (``n_rows`` rows, staged) joined to ``one``, which has a row for each key.

    A key of more rows than a fourth of a task's share is dealt over as many tasks as it fills; there are four such keys
    for each shuffle partition at the most, so their list is bounded.
    """
    share = max(1, n_rows // (4 * int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = many.groupBy(key).count().where(F.col("count") > share).select(key, F.ceil(F.col("count") / share).alias("__copies"))
    copies = F.coalesce("__copies", F.lit(1))
    left = many.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), copies)).drop("__copies")
    right = one.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("__copies")
    return left.join(right, [key, "__salt"]).drop("__salt")

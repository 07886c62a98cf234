"""Statistics of a corpus matrix, long (row keys, var, v) or wide."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIRS = 8  # of columns, whose sums are 11 columns each
PASSES = 8


def zscore(v: Column, over: Window) -> Column:
    """Against the mean and the standard deviation of a sample; a deviation of zero or null counts as 1, a null value as 0."""
    sd = F.stddev(v).over(over)
    return F.coalesce((v - F.avg(v).over(over)) / F.when(sd > 0, sd).otherwise(1.0), F.lit(0.0))


def moments(wide: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """(group, a, b, n, r): correlations of all pairs of columns over the rows that have both, from sums.

    Null results (a constant column) become 0; a column with itself has 1. No pair of rows is ever joined, and only
    P x P sums for each partition are shuffled. Sums of more pairs than PAIRS at once are more columns than Spark compiles,
    so they take a pass each, PASSES at the most.
    """
    group = group or []
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
        sums.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(x).alias("n"), (F.lit(1.0) if a == b else F.coalesce(F.nanvl(r, F.lit(None).cast("double")), F.lit(0.0))).alias("r")))
    parts = [sums[k : k + PAIRS] for k in range(0, len(sums), PAIRS)]
    parts = parts if len(parts) <= PASSES else [sums]
    both_ways = lambda e: F.when(e["a"] == e["b"], F.array(e)).otherwise(F.array(e, F.struct(e["b"].alias("a"), e["a"].alias("b"), e["n"].alias("n"), e["r"].alias("r"))))
    found = [wide.groupBy(*group).agg(F.array(*part).alias("s")).select(*group, F.inline(F.flatten(F.transform("s", both_ways)))) for part in parts]
    return functools.reduce(DataFrame.unionByName, found)


def complete_rows(wide: DataFrame, columns: list[str]) -> DataFrame:
    """The rows without a null, if they are as many as 3 columns each and 100; else all rows."""
    whole = wide.dropna(subset=columns)
    return whole if whole.limit(max(3 * len(columns), 100)).count() >= max(3 * len(columns), 100) else wide


def coupling(edges: DataFrame, classes: dict[str, str], group: list[str] | None = None) -> DataFrame:
    """(group, class_a, class_b, coupling): mean absolute correlation between classes; a variable with itself does not count."""
    of = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    named = edges.where("a <> b").withColumn("class_a", of[F.col("a")]).withColumn("class_b", of[F.col("b")])
    return named.groupBy(*(group or []), "class_a", "class_b").agg(F.avg(F.abs("r")).alias("coupling"))


def network(edges: DataFrame, least: float = 0.3) -> DataFrame:
    return edges.where((F.col("a") < F.col("b")) & (F.abs("r") >= least))


def median_split(stimuli: DataFrame, value: Column) -> DataFrame:
    """Adds rich: whether a stimulus's value is above the median of all."""
    middle = stimuli.agg(F.percentile(value, F.lit(0.5)).alias("median"))
    return stimuli.join(F.broadcast(middle)).withColumn("rich", value > F.col("median")).drop("median")  # one row


def explained(eigenvalues: DataFrame) -> DataFrame:
    """(k, percent, cumulative) of eigenvalues (k, value), largest first."""
    order = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as variables
    total = Window.partitionBy()
    share = 100 * F.col("value") / F.sum("value").over(total)
    return eigenvalues.withColumn("percent", share).withColumn("cumulative", F.sum("percent").over(order)).select("k", "percent", "cumulative")


def components_to(explained_rows: DataFrame, percents: tuple[float, ...] = (80.0, 90.0)) -> DataFrame:
    """(percent, k): how many components reach each share."""
    wanted = explained_rows.select("k", "cumulative", F.explode(F.array(*map(F.lit, percents))).alias("percent"))
    return wanted.where(F.col("cumulative") >= F.col("percent") - 1e-9).groupBy("percent").agg(F.min("k").alias("k"))

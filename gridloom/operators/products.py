"""Products of many vectors with many others, in blocks that tasks multiply as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.scalars import wide

BLOCK = 8192  # vectors of a block
PACK = 1024  # prompts of a pack


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _width(*columns: pa.ChunkedArray) -> int:
    return max((len(c[0]) for c in columns if len(c)), default=0)


def prompt_cosines(vectors: DataFrame, vec: str, prompts: DataFrame) -> DataFrame:
    """``vectors`` with cosines: an array, in the order of k, of each prompt's (k, vec and any other columns) other columns and its cosine, null with a vector of no length.

    Vectors without nulls, all as wide as the prompts. Both are tables: vectors are dealt into blocks, prompts into packs
    of k, and a task multiplies a block with a pack. The prompts are copied to every block, the vectors to every pack.
    """
    extra = [T.StructField(f.name, f.dataType) for f in prompts.schema.fields if f.name not in ("k", "vec")]
    n, packs = vectors.count(), prompts.agg(F.coalesce(F.max(F.floor(F.col("k") / PACK)) + 1, F.lit(0))).first()[0]
    blocks = max(1, -(-n // BLOCK))
    keyed = vectors.withColumn("__row", F.monotonically_increasing_id())
    left = keyed.withColumn("__block", F.pmod("__row", F.lit(blocks))).withColumn("__pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(packs - 1, 0)).cast("long"))))
    right = prompts.select("k", wide(F.col("vec")).alias("vec"), *(f.name for f in extra)).withColumn("__pack", F.floor(F.col("k") / PACK)).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    element = T.StructType([T.StructField("k", T.LongType()), *extra, T.StructField("cosine", T.DoubleType())])
    given, extra_names = vectors.columns, [f.name for f in extra]
    schema = T.StructType([*vectors.schema.fields, T.StructField("__row", T.LongType()), T.StructField("__pack", T.LongType()), T.StructField("cosines", T.ArrayType(element))])

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("k")
        width = _width(a[vec], b["vec"])
        x, y = _matrix(a[vec], width), _matrix(b["vec"], width)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = (x @ y.T) / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1)))
        m = len(b)
        flat = pa.array(cosine.ravel(), mask=np.isnan(cosine.ravel()))
        again = pa.array(np.tile(np.arange(m), len(a)))
        entries = pa.StructArray.from_arrays([b["k"].combine_chunks().cast(pa.int64()).take(again), *(b[c].combine_chunks().take(again) for c in extra_names), flat], names=["k", *extra_names, "cosine"])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * m, pa.int32()), entries)
        return pa.table([*(a[c] for c in given), a["__row"], a["__pack"], lists], names=[*given, "__row", "__pack", "cosines"])

    made = left.groupBy("__block", "__pack").cogroup(right.groupBy("__block", "__pack")).applyInArrow(multiply, schema)
    if packs <= 1:
        return made.drop("__row", "__pack")
    whole = made.groupBy("__row").agg(*(F.first(c).alias(c) for c in given), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__pack", "cosines"))), lambda p: p["cosines"])).alias("cosines"))
    return whole.select(*given, "cosines")


def most_alike_before(vectors: DataFrame, block: int = 4096, most_blocks: int = 64) -> DataFrame:
    """(stim_id, i, alike): the largest product of each vector (stim_id, i, e) with an earlier one of its stimulus, null for the first. Rows of one i come in the order of their vectors.

    A stimulus is cut into blocks in order; every pair of blocks is a task's work, and only the largest product of each
    vector leaves it. Blocks grow where a stimulus has more than ``block`` times ``most_blocks`` vectors, so a vector is
    sent ``most_blocks`` + 1 times at the most.
    """
    own = Window.partitionBy("stim_id")
    placed = vectors.withColumn("__place", F.row_number().over(own.orderBy("i", "e")) - 1).withColumn("__n", F.count("*").over(own))
    size = F.greatest(F.lit(block), F.ceil(F.col("__n") / most_blocks))
    blocked = placed.withColumns({"__block": F.floor(F.col("__place") / size).cast("int"), "__blocks": F.ceil(F.col("__n") / size).cast("int")})
    later = blocked.select("stim_id", "i", "e", "__place", "__block", F.explode(F.sequence(F.lit(0), F.col("__block"))).alias("__other"))
    upto = F.explode(F.sequence(F.col("__block"), F.col("__blocks") - 1)).alias("block_after")
    earlier = blocked.select(F.col("stim_id").alias("stim_before"), F.col("e").alias("e_before"), F.col("__place").alias("place_before"), F.col("__block").alias("block_before"), upto)
    kinds = T.StructType([vectors.schema["stim_id"], vectors.schema["i"], T.StructField("__place", T.IntegerType()), T.StructField("alike", T.DoubleType())])

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        width = _width(a["e"], b["e_before"])
        x, y = _matrix(a["e"], width), _matrix(b["e_before"], width)
        p, q = a["__place"].to_numpy(), b["place_before"].to_numpy()
        best = np.full(len(x), -np.inf)
        for k in range(0, len(y), 1024):
            found = np.where(q[None, k : k + 1024] < p[:, None], x @ y[k : k + 1024].T, -np.inf)
            best = np.maximum(best, found.max(1)) if len(x) else best
        return pa.table([a["stim_id"], a["i"], a["__place"].cast(pa.int32()), pa.array(best, mask=~np.isfinite(best))], names=["stim_id", "i", "__place", "alike"])

    made = later.groupBy("stim_id", "__block", "__other").cogroup(earlier.groupBy("stim_before", "block_after", "block_before")).applyInArrow(multiply, kinds)
    return made.groupBy("stim_id", "i", "__place").agg(F.max("alike").alias("alike")).select("stim_id", "i", "alike")


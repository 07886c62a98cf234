"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into buckets by a seeded hash of their content; the number of buckets follows the
bytes, so that a bucket fits in memory. Pass two puts each bucket in an order of its own, shuffles it by Fisher-Yates
with a seed of the bucket, and writes it. Buckets laid end to end are one random order of all records, which is cut
into shards whose numbers of records differ by one at most (the law ``rows``).

Texts move once. What is counted over all records, for the places of buckets, is one row for each bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.storage import new_path, set_aside, stage

LAW = "rows"


def shard_documents(docs: DataFrame, n_shards: int = 8, out: str | None = None, bucket_bytes: int = 16 << 20, seed: int = 7) -> DataFrame:
    """Write ``docs`` (doc_id, text and any other columns) as shuffled shards and return a reader of them.

    ``out`` becomes a Parquet folder with one subfolder for each shard, its rows sorted by slot within each file; unset,
    it is a folder among the session's shared ones. Columns: those of ``docs``, slot (long, gapless from 0 in each
    shard) and shard (int). Input columns of these two names are written as shard_in and slot_in (or with more of _in, where that is taken). Null or empty texts
    and null doc_ids are records like others. Records spread by doc_id and text together, so neither a common text nor
    a common doc_id fills a bucket; only records equal in both share one. An empty table writes empty shards. The same
    records, however stored, always come to the same places, but for the order of equal ones.
    """
    spark = docs.sparkSession
    docs = set_aside(docs, "shard", "slot")
    text = F.coalesce("text", F.lit(""))
    draw = F.xxhash64(F.lit(seed), "doc_id", F.crc32(text.cast("binary")), F.octet_length(text))
    drawn = stage(docs.select(draw.alias("draw"), (F.octet_length(text) + 1).alias("size")), "draws")
    total, n_bytes = drawn.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_buckets = max(1, -(-n_bytes // bucket_bytes))
    counts = drawn.groupBy(F.pmod("draw", F.lit(n_buckets)).alias("__shard_bucket")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__shard_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("__shard_bucket", before.alias("__shard_from"))
    scattered = docs.withColumn("__shard_draw", draw).withColumn("__shard_bucket", F.pmod("__shard_draw", F.lit(n_buckets))).join(places, "__shard_bucket")
    schema = T.StructType([*docs.schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])

    def shuffle(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table["__shard_draw"].to_numpy(), kind="stable")
        np.random.default_rng([seed, key[0].as_py()]).shuffle(order)  # Fisher-Yates
        place = table["__shard_from"][0].as_py() + np.arange(len(order))
        shard = place * n_shards // total
        slot = place - -(-shard * total // n_shards)
        mixed = table.drop_columns(["__shard_draw", "__shard_bucket", "__shard_from"]).take(pa.array(order))
        return mixed.append_column("slot", pa.array(slot, pa.int64())).append_column("shard", pa.array(shard, pa.int32()))

    mixed = scattered.groupBy("__shard_bucket").applyInArrow(shuffle, schema)
    out = out or new_path(spark, "shards")
    mixed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(out)
    return spark.read.schema(schema).parquet(out)

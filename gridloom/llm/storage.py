"""Tables written between the steps of one operator, in the folder that the whole cluster shares.

``spark.checkpoint.dir`` names that folder. Where it is unset, which is accepted in local mode only, a folder of this
session's own is used. A staged table cuts lineage: what was written survives the loss of executors, and both readers
of a staged table see the same rows, whatever order a recomputed shuffle would have given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.shared import new_path, shared_dir  # noqa: F401


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a reader of what was written."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later step reads."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def set_aside(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the columns of these names, in any case of letters, renamed by as many of _in as make them new."""
    taken = {c.lower() for c in df.columns} | {n.lower() for n in names}
    out = []
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            while c.lower() in taken:
                c += "_in"
            taken.add(c.lower())
        out.append(c)
    return df.toDF(*out)

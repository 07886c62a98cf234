"""Annotations in versions: a patch that is cut short leaves the version before it as it was.

A folder holds ``data/version=<name>/stim_id=...`` with the rows of the stimuli that a version wrote, ``index/<name>``, a
table that says which version has each stimulus, and ``current``, whose one file name is the version in force. A patch
writes its data, then its index, and last renames a file, which a file system does at once or not at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import schemas
from gridloom.operators.shape import upsert

_INDEX = "stim_id string, version string"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, folder: str) -> str | None:
    """The name of the version in force; the last by number, should a crash have left two."""
    where, files = _files(spark, f"{folder}/current")
    if not files.exists(where):
        return None
    names = [f.getPath().getName() for f in files.listStatus(where)]
    return max((n for n in names if not n.startswith(("_", "."))), default=None)


def _index(spark: SparkSession, folder: str, version: str | None) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{folder}/index/{version}") if version else spark.createDataFrame([], _INDEX)


def read_current(spark: SparkSession, folder: str) -> DataFrame:
    """Channel values of every stimulus, each from the version that wrote it last."""
    version = current(spark, folder)
    if version is None:
        return spark.createDataFrame([], schemas.CHANNEL_VALUES)
    kinds = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in schemas.CHANNEL_VALUES.fields] + ["version string"])
    rows = spark.read.schema(kinds).parquet(f"{folder}/data")
    return rows.join(_index(spark, folder, version), ["stim_id", "version"], "left_semi").select(*schemas.CHANNEL_VALUES.names)


def put_in_force(spark: SparkSession, folder: str, version: str) -> None:
    """Make a version the current one by one rename, then drop the marks of those before."""
    mark, files = _files(spark, f"{folder}/current/{version}")
    waiting, _ = _files(spark, f"{folder}/current/.{version}")
    files.create(waiting, True).close()
    if not files.rename(waiting, mark):
        raise OSError(f"{folder}/current/{version} could not be made")
    for old in files.listStatus(mark.getParent()):
        if old.getPath().getName() < version:
            files.delete(old.getPath(), False)


def patch(spark: SparkSession, folder: str, new: DataFrame, steps: Callable[[str], None] = lambda done: None) -> str:
    """Put rows (those of ``schemas.CHANNEL_VALUES``) in place of the channels (stim_id, path) that they have; others of the same stimuli stay, other stimuli are not written.

    Returns the version. ``steps`` is told after the data, after the index and after the switch. What a patch that was
    cut short has written is never read, and ``clean`` removes it; the patch is simply run again.
    """
    before = current(spark, folder)
    version = f"{int(before.split('-')[0]) + 1 if before else 0:09d}-{uuid.uuid4().hex[:8]}"
    new = new.select(*schemas.CHANNEL_VALUES.names)
    touched = new.select("stim_id").distinct()
    old = read_current(spark, folder).join(touched, "stim_id", "left_semi")
    keys = new.select("stim_id", "path").distinct()
    whole = old.join(keys, ["stim_id", "path"], "left_anti").unionByName(new)
    spread = whole.repartition("stim_id", F.pmod(F.xxhash64("path"), F.lit(8))).sortWithinPartitions("stim_id", "path", "bin")
    spread.write.partitionBy("stim_id").parquet(f"{folder}/data/version={version}")
    steps("data")
    upsert(_index(spark, folder, before), touched.withColumn("version", F.lit(version)), ["stim_id"]).write.parquet(f"{folder}/index/{version}")
    steps("index")
    put_in_force(spark, folder, version)
    steps("switch")
    return version


def clean(spark: SparkSession, folder: str) -> list[str]:
    """Remove data of versions that no stimulus of the current one has, and indexes that are not in force; returns the versions whose data went. For when no patch and no reader of an older version runs."""
    version = current(spark, folder)
    kept = {r.version for r in _index(spark, folder, version).select("version").distinct().collect()}  # a name for each patch still in use
    gone = []
    for part, keep in (("data", {f"version={v}" for v in kept}), ("index", {version})):
        where, files = _files(spark, f"{folder}/{part}")
        for f in files.listStatus(where) if files.exists(where) else []:
            name = f.getPath().getName()
            if name not in keep and not name.startswith(("_", ".")):
                files.delete(f.getPath(), True)
                gone += [name.removeprefix("version=")] if part == "data" else []
    return sorted(gone)

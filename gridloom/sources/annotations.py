"""Where annotations are kept: Parquet by stimulus, transcripts and search indexes in JSON, HDF5 where its library is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import schemas

TRANSCRIPT = "language string, segments array<struct<text:string,start:double,end:double>>, words array<struct<text:string,start:double,end:double,prob:double>>"


def write_annotations(values: DataFrame, path: str) -> None:
    """One folder for each stimulus; those in ``values`` are replaced, others stay. Human annotations are other tables and are never touched."""
    spread = values.repartition("stim_id", F.pmod(F.xxhash64("path"), F.lit(8)))  # a long stimulus is written by several tasks
    spread.sortWithinPartitions("stim_id", "path", "bin").write.partitionBy("stim_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_annotations(spark: SparkSession, path: str, skip_corrupt: bool = True) -> DataFrame:
    """All stimuli of a folder; what cannot be read is passed over with a warning in the log."""
    return spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).schema(schemas.CHANNEL_VALUES).parquet(path)


def find_annotation(spark: SparkSession, folder: str, suffix: str = ".h5") -> str:
    """The first file of a folder with the suffix, by name; an error if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(f.getPath().toString() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if f.getPath().getName().endswith(suffix))
    if not names:
        raise FileNotFoundError(f"no {suffix} in {folder}")
    return names[0]


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(stim_id, i, text, start, end, prob): the words of transcript files named by stimulus and model."""
    files = spark.read.schema(TRANSCRIPT).option("multiLine", "true").json(path).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    words = files.select(F.regexp_extract("file", r"^(.*?)(?:\.[^.]*)?\.json$", 1).alias("stim_id"), F.posexplode("words").alias("i", "w"))
    return words.select("stim_id", "i", "w.text", "w.start", "w.end", "w.prob")


def transcripts_json(segments: DataFrame, words: DataFrame, language: str = "en") -> DataFrame:
    """(stim_id, json): segments (stim_id, i, text, start, end) and words (..., prob) as one object a stimulus."""
    pack = lambda df, *c: df.groupBy("stim_id").agg(F.array_sort(F.collect_list(F.struct("i", *c))).alias("x")).select("stim_id", F.transform("x", lambda e: F.struct(*[e[k].alias(k) for k in c])).alias("x"))
    s, w = pack(segments, "text", "start", "end").withColumnRenamed("x", "segments"), pack(words, "text", "start", "end", "prob").withColumnRenamed("x", "words")
    whole = s.join(w, "stim_id", "full").select("stim_id", F.struct(F.lit(language).alias("language"), "segments", "words").alias("j"))
    return whole.select("stim_id", F.to_json("j").alias("json"))


def index_json(segments: DataFrame, stats: DataFrame) -> DataFrame:
    """One line for each segment (stim_id, seg, t0, t1, v by path, rounded to four places, null where there is none)."""
    paths = [r.path for r in stats.select("path").orderBy("path").collect()]  # channels, of which there are a few hundred
    wide = segments.groupBy("stim_id", "seg", "t0", "t1").pivot("path", paths).agg(F.round(F.first("v"), 4))
    return wide.select(F.to_json(F.struct("stim_id", "seg", "t0", "t1", F.array(*[F.col(f"`{p}`") for p in paths]).alias("v")), {"ignoreNullFields": "false"}).alias("json"))


def read_hdf5(spark: SparkSession, path: str) -> DataFrame:
    """Channels of every kind in HDF5 annotations, with their onsets, and a row for each file that cannot be read; needs h5py on the workers."""
    import importlib.util

    from gridloom.sources import annotation_source

    if importlib.util.find_spec("h5py") is None:
        raise ImportError("h5py is not installed")
    return annotation_source.read_files(spark, path, suffix=".h5", decoder=f"{annotation_source.__name__}:hdf5")


def write_human(spark: SparkSession, path: str, classes: list[str]) -> None:
    """Empty tables for what people annotate, one for each class and one for what is in none; those that exist are left alone."""
    empty = spark.createDataFrame([], schemas.CHANNEL_VALUES)
    for name in [*classes, "_free"]:
        empty.write.mode("ignore").parquet(f"{path}/human/{name}")


def write_scores(scores: DataFrame, path: str, category: str) -> None:
    """The factor scores of one category (stim_id, bin, f1, ...), in place of those that were there."""
    scores.write.mode("overwrite").parquet(f"{path}/category={category}")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)

"""What a corpus is made of: manifests, text stories, lexicons, transcripts and annotations in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import schemas
from gridloom.functions.scalars import sentences_of, word_count, words_of

READING_RATE = 3.0


def scan_media(spark: SparkSession, folder: str) -> DataFrame:
    """(id, path, source, extension, length) of the media and story files under a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return manifest_entries(files, folder)


def manifest_entries(files: DataFrame, root: str = "") -> DataFrame:
    """Of files (path, ...), those that are media or stories, with id (the name's stem), source (the first folder) and extension."""
    rest = F.regexp_replace("path", "^.*?" + root.rstrip("/") + "/", "") if root else F.col("path")
    parts = F.split(rest, "/")
    name = F.element_at(parts, -1)
    found = files.withColumn("id", F.regexp_replace(name, r"\.[^.]*$", "")).withColumn("extension", F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))).withColumn("source", F.element_at(parts, 1))
    skipped = F.arrays_overlap(parts, F.array(*map(F.lit, schemas.SKIPPED_FOLDERS)))
    return found.where(F.col("extension").isin(*schemas.MEDIA_EXTENSIONS, *schemas.TEXT_EXTENSIONS) & ~F.lower("id").isin(*schemas.SKIPPED_STEMS) & ~skipped)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).csv(path, header=True)


def with_rights(manifest: DataFrame, rights: dict[str, str] | None = None) -> DataFrame:
    pairs = [x for kv in (rights or schemas.RIGHTS).items() for x in kv]
    return manifest.withColumn("rights", F.coalesce(F.create_map(*map(F.lit, pairs))[F.col("source")], F.lit("unknown")))


def duplicate_ids(manifest: DataFrame, key: str = "id") -> DataFrame:
    """(id, n) of the ids that stand more than once."""
    return manifest.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(manifest: DataFrame, key: str = "id") -> DataFrame:
    """The manifest as it is, if no id repeats; else an error that names some of them."""
    if found := duplicate_ids(manifest, key).limit(5).collect():
        raise ValueError(f"repeated ids: {[r[0] for r in found]}")
    return manifest


def modality(has_video: Column, has_audio: Column) -> Column:
    return F.when(has_video & has_audio, "audiovisual").when(has_video, "video-only").when(has_audio, "audio-only").otherwise("text-only")


def short_hash(content: Column, first_bytes: int = 1 << 20, digits: int = 16) -> Column:
    """The first digits of the SHA-256 of the first bytes."""
    return F.substring(F.sha2(F.substring(content.cast("binary"), 1, first_bytes), 256), 1, digits)


def text_stimuli(documents: DataFrame, rate: float = READING_RATE) -> DataFrame:
    """(stim_id, n_words, duration_sec) of texts (stim_id, text) read at ``rate`` words a second."""
    n = word_count(F.col("text"))
    return documents.select("stim_id", n.alias("n_words"), (n / F.lit(rate)).alias("duration_sec"))


def text_timeline(documents: DataFrame, rate: float = READING_RATE) -> DataFrame:
    """(stim_id, seg_idx, word_idx, i, text, start, end): words on an even clock; sentences are segments.

    All of a text's words are numbered where they are, inside its arrays, so nothing is sorted or shuffled.
    """
    sentences = F.filter(F.transform(sentences_of(F.col("text")), words_of), lambda w: F.size(w) > 0)
    numbered = F.transform(F.col("s"), lambda ws, k: F.transform(ws, lambda w, j: F.struct(k.alias("seg_idx"), j.alias("word_idx"), w.alias("text"))))
    rows = documents.select("stim_id", sentences.alias("s")).select("stim_id", F.posexplode(F.flatten(numbered)).alias("i", "w"))
    return rows.select("stim_id", "w.seg_idx", "w.word_idx", "i", "w.text", (F.col("i") / F.lit(rate)).alias("start"), ((F.col("i") + 1) / F.lit(rate)).alias("end"))


def text_rates(documents: DataFrame, rate: float = READING_RATE, grid_rate: float = 1.0) -> DataFrame:
    """(stim_id, bin, n): how many words of a text read at ``rate`` begin in each bin of its grid.

    Word i begins at i / rate, so a bin's words follow from its number: one scan, and no row for a word. Texts' lengths are
    dealt out by stim_id before their bins are counted out, so a file's bins are not one task's, and what groups by stim_id
    next has them in place.
    """
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_bins = F.floor(F.col("duration_sec") * grid_rate + 1e-9).cast("int")
    dealt = text_stimuli(documents, rate).where(n_bins >= 1).repartition(tasks, "stim_id")
    rows = dealt.select("stim_id", "n_words", F.explode(F.sequence(F.lit(0), n_bins - 1)).alias("bin"))
    clock = lambda i: F.rint(i / F.lit(rate) * F.lit(float(grid_rate)))

    def first(b: Column) -> Column:
        """The first word at or after the bin's beginning; where it must be, but for a tie of rounding."""
        near = F.ceil((b - 0.5) / grid_rate * rate).cast("int")
        return F.when(clock(near - 1) >= b, near - 1).when(clock(near) >= b, near).otherwise(near + 1)

    upto = lambda b: F.least(F.greatest(first(b), F.lit(0)), F.col("n_words"))
    return rows.select("stim_id", "bin", (upto(F.col("bin") + 1) - upto(F.col("bin"))).cast("long").alias("n"))


def clean_norms(rows: DataFrame) -> DataFrame:
    """(word, value) of a lexicon (line, word, value): small trimmed words, numbers only, the last line of a word counts."""
    parsed = rows.select("line", F.lower(F.trim("word")).alias("word"), F.col("value").try_cast("double").alias("value")).where("value is not null")
    return parsed.groupBy("word").agg(F.max_by("value", "line").alias("value"))


def read_norms(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon file with columns word and value; others are passed over."""
    rows = spark.read.csv(path, header=True).select("word", "value")
    return clean_norms(rows.withColumn("line", F.monotonically_increasing_id()))


def lookup_norms(words: DataFrame, norms: DataFrame) -> DataFrame:
    """Adds the norm (word, value) of each cleaned word; null where there is none. Spark sends the lexicon to all where it is small enough."""
    return words.join(norms, "word", "left")


def template(spark: SparkSession) -> DataFrame:
    """The channel template with class, subclass and leaf."""
    schema = "path string, dtype string, dim int, units string, resample string, native_rate string, components array<string>"
    rows = spark.createDataFrame(schemas.template_rows(), schema)
    parts = F.split("path", "/")
    return rows.select("*", parts[0].alias("class"), F.when(F.size(parts) > 2, parts[1]).otherwise("(direct)").alias("subclass"), F.element_at(parts, -1).alias("leaf"))


def infer_template(channel_meta: DataFrame) -> DataFrame:
    """The channels of a run, each once, by path; the time axis and onset lists are none."""
    return channel_meta.where("path not like '%\\_\\_onsets' and path <> 'time_sec'").select("path", "dtype", "dim").distinct()


def profile_channels(profiles: DataFrame) -> DataFrame:
    """(id, path, dtype, applicable, bin, value) of annotations in JSON (column ``json``), three levels deep; a null stays null."""
    leaf = "struct<value:array<string>,dtype:string,applicable:boolean>"
    shape = f"struct<stimulus:struct<id:string>,features:map<string,map<string,map<string,{leaf}>>>>"
    top = profiles.select(F.from_json("json", shape).alias("j")).select("j.stimulus.id", F.explode("j.features").alias("class", "a"))
    mid = top.select("id", "class", F.explode("a").alias("sub", "b"))
    low = mid.select("id", "class", "sub", F.explode("b").alias("leaf", "c"))
    return low.select("id", F.concat_ws("/", "class", "sub", "leaf").alias("path"), "c.dtype", "c.applicable", F.posexplode("c.value").alias("bin", "value"))


def attach_onsets(channels: DataFrame, onsets: DataFrame) -> DataFrame:
    """Adds the sorted onset times (stim_id, path, t) to channels (stim_id, path); none: an empty list."""
    lists = onsets.groupBy("stim_id", "path").agg(F.array_sort(F.collect_list("t")).alias("onsets"))
    return channels.join(lists, ["stim_id", "path"], "left").withColumn("onsets", F.coalesce("onsets", F.array().cast("array<double>")))


def filter_manifest(manifest: DataFrame, sources: list[str] | None = None, ids: list[str] | None = None, longest: float | None = None, first: int | None = None) -> DataFrame:
    """Filters in this order; what is empty or zero is off. ``first`` goes by id."""
    for column, allowed in (("source", sources), ("id", ids)):
        manifest = manifest.where(F.col(column).isin(*allowed)) if allowed else manifest
    manifest = manifest.where(F.col("duration_sec") <= longest) if longest else manifest
    return manifest.orderBy("id").limit(first) if first else manifest


def read_template(spark: SparkSession, path: str) -> DataFrame | None:
    """A template kept as a JSON array of channels (path, dtype, dim, units, resample, native_rate); None where there is no file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    schema = "path string, dtype string, dim int, units string, resample string, native_rate string, components array<string>"
    parts = F.split("path", "/")
    return spark.read.schema(schema).option("multiLine", "true").json(path).select("*", parts[0].alias("class"), F.when(F.size(parts) > 2, parts[1]).otherwise("(direct)").alias("subclass"), F.element_at(parts, -1).alias("leaf"))

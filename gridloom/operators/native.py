"""From what models and media give (detections, flow, logits, parses, words) to samples in time and channels on the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import grid as G
from gridloom.operators import spans

CONTENT = ("NOUN", "VERB", "ADJ", "ADV", "PROPN")  # fixed values: parts of speech that carry content


def kept_faces(detections: DataFrame, least: float = 0.9, side: float | None = None) -> DataFrame:
    """Detections (x1, y1, x2, y2, score, width, height) sure enough; with ``side``, also as large as that on either side within the frame."""
    kept = detections.where(F.col("score") >= least)
    if side is None:
        return kept
    extent = lambda a, b, most: F.least(F.bround(b), F.col(most)) - F.greatest(F.bround(a), F.lit(0))
    return kept.where((extent("x1", "x2", "width") >= side) & (extent("y1", "y2", "height") >= side))


def kept_poses(detections: DataFrame, least: float = 0.7) -> DataFrame:
    return detections.where(F.col("score") >= least)


def box_share(width: Column, height: Column) -> Column:
    """The share of a frame that a box (x1, y1, x2, y2) fills."""
    return (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / (width * height)


def box_centre() -> Column:
    return F.struct(((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))


def face_samples(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """(stim_id, t, n_faces, max_face_area_frac, face_prob) of every frame (stim_id, t): 0 faces of no area where none is sure, whose mean score is null."""
    found = kept_faces(detections).groupBy("stim_id", "t").agg(F.count("*").alias("n"), F.max(box_share(F.col("width"), F.col("height"))).alias("area"), F.avg("score").alias("face_prob"))
    rows = frames.join(found, ["stim_id", "t"], "left")
    return rows.select("stim_id", "t", F.coalesce("n", F.lit(0)).cast("double").alias("n_faces"), F.coalesce("area", F.lit(0.0)).alias("max_face_area_frac"), "face_prob")


def pose_samples(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """(stim_id, t, n_persons, keypoint_score, min_pair_distance): the least distance between centres, as a share of the diagonal; null for fewer than two."""
    held = kept_poses(detections).groupBy("stim_id", "t").agg(F.collect_list(box_centre()).alias("c"), F.avg("keypoint_score").alias("keypoint_score"), F.hypot(F.max("width"), F.max("height")).alias("diagonal"))
    apart = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])
    near = F.array_min(F.flatten(F.transform("c", lambda a, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda b: apart(a, b)))))
    found = held.select("stim_id", "t", F.size("c").alias("n"), "keypoint_score", (near / F.col("diagonal")).alias("min_pair_distance"))
    return frames.join(found, ["stim_id", "t"], "left").select("stim_id", "t", F.coalesce("n", F.lit(0)).cast("double").alias("n_persons"), "keypoint_score", "min_pair_distance")


def motion_samples(flow: DataFrame) -> DataFrame:
    """(stim_id, t, magnitude, camera, residual) of flow arrays (stim_id, t, u, v): the mean speed, the size of the median motion, and the mean speed that is left without it."""
    size = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.hypot(x, y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    rows = flow.withColumns({"mu": scalars.median(F.col("u")), "mv": scalars.median(F.col("v"))})
    moved = lambda a, m: F.transform(a, lambda x: x - F.col(m))
    return rows.select("stim_id", "t", size(F.col("u"), F.col("v")).alias("magnitude"), F.hypot("mu", "mv").alias("camera"), size(moved(F.col("u"), "mu"), moved(F.col("v"), "mv")).alias("residual"))


def depth_samples(maps: DataFrame, bins: int = 16) -> DataFrame:
    """(stim_id, t, depth_mean, depth_range, foreground_frac, depth_entropy) of depth maps (stim_id, t, d): brought to 0 to 1, near is above a half."""
    spread = maps.withColumn("low", F.array_min("d")).withColumn("high", F.array_max("d"))
    even = spread.withColumn("e", F.transform("d", lambda x: (x - F.col("low")) / (F.col("high") - F.col("low") + F.lit(1e-6))))
    place = F.transform("e", lambda x: scalars.histogram_bin(x, bins))
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter("places", lambda p: p == b)).cast("double"))
    return even.withColumn("places", place).select("stim_id", "t", (F.aggregate("e", F.lit(0.0), lambda s, x: s + x) / F.size("e")).alias("depth_mean"), (F.col("high") - F.col("low")).alias("depth_range"), (F.size(F.filter("e", lambda x: x > 0.5)) / F.size("e")).alias("foreground_frac"), scalars.entropy(counts).alias("depth_entropy"))


def segment_surprisal(tokens: DataFrame) -> DataFrame:
    """(stim_id, seg, surprisal, entropy): means, in bits, over the tokens (stim_id, seg, i, logits, target) of a segment but its first, which nothing predicts; null for a segment of one."""
    found = tokens.where("i > 0").withColumn("log_p", scalars.log_softmax(F.col("logits")))
    means = found.groupBy("stim_id", "seg").agg(F.avg(scalars.surprisal_bits(F.col("log_p"), F.col("target"))).alias("surprisal"), F.avg(scalars.entropy_bits(F.col("log_p"))).alias("entropy"))
    return tokens.select("stim_id", "seg").distinct().join(means, ["stim_id", "seg"], "left")


def depths(heads: Column, most: int = 200) -> Column:
    """How many steps each token is from its root, of an array of heads (places from 0; a root is its own), ``most`` at most.

    Each round every token jumps to where the one it stands on stands, so rounds grow with the logarithm of the depth.
    """
    start = F.struct(heads.alias("at"), F.transform(heads, lambda h, i: (h != i).cast("int")).alias("d"))
    rounds = max(1, (most - 1).bit_length())

    def jump(state: Column) -> Column:
        further = F.transform(state["at"], lambda h, i: F.get(state["d"], i) + F.get(state["d"], h))
        return F.struct(F.transform(state["at"], lambda h: F.get(state["at"], h)).alias("at"), further.alias("d"))

    whole = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: jump(s))
    return F.transform(whole["d"], lambda d: F.least(d, F.lit(most)))


def segment_syntax(parses: DataFrame) -> DataFrame:
    """(stim_id, seg, tree_depth, mean_dep_distance, content_frac, noun_frac, verb_frac) of parses (stim_id, seg, heads, pos), arrays with an entry for each token; null for no token."""
    n = F.size("heads")
    away = F.filter(F.transform("heads", lambda h, i: F.abs(h - i)), lambda x: x > 0)
    share = lambda kinds: F.when(n > 0, F.size(F.filter("pos", lambda p: p.isin(*kinds))) / n)
    far = F.when(n > 0, F.when(F.size(away) > 0, F.aggregate(away, F.lit(0.0), lambda s, x: s + x) / F.size(away)).otherwise(0.0))
    return parses.select(
        "stim_id", "seg", F.when(n > 0, F.array_max(depths(F.col("heads"))).cast("double")).alias("tree_depth"), far.alias("mean_dep_distance"),
        share(CONTENT).alias("content_frac"), share(("NOUN", "PROPN")).alias("noun_frac"), share(("VERB",)).alias("verb_frac"),
    )


def sentiment(segments: DataFrame, stimuli: DataFrame, bins: DataFrame) -> DataFrame:
    """(stim_id, bin, vec, polarity, top) of segments (stim_id, start, end, vec: chances of negative, neutral, positive): means over the segments of a bin, the last less the first, and the place of the largest."""
    parts = spans.span_bins(segments.select("stim_id", "start", "end", F.posexplode("vec").alias("k", "x")), stimuli).groupBy("stim_id", "bin", "k").agg(F.avg("x").alias("x"))
    whole = parts.groupBy("stim_id", "bin").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("p")).select("stim_id", "bin", F.transform("p", lambda e: e["x"]).alias("vec"))
    rows = bins.join(whole, ["stim_id", "bin"], "left")
    return rows.select("stim_id", "bin", "vec", (F.element_at("vec", -1) - F.element_at("vec", 1)).alias("polarity"), scalars.argmax(F.col("vec")).alias("top"))


def spread(samples: DataFrame, prefix: str, bins: DataFrame, rate: float = 1.0, every: bool = False) -> DataFrame:
    """(stim_id, path, bin, num): every number of samples (stim_id, t, ...) as a channel under ``prefix``, by means on the grid.

    ``every``: the bins are of stimuli with samples only, so the samples need not be made once more to find those.
    """
    names = [c for c in samples.columns if c not in ("stim_id", "t")]
    long = samples.withColumn("bin", G.bin_index(F.col("t"), rate)).groupBy("stim_id", "bin").agg(*(F.avg(scalars.clean_nan(F.col(c))).alias(c) for c in names))
    bins = bins if every else bins.join(samples.select("stim_id").distinct(), "stim_id", "left_semi")
    return bins.join(long, ["stim_id", "bin"], "left").unpivot(["stim_id", "bin"], names, "name", "num").select("stim_id", F.concat(F.lit(f"{prefix}/"), "name").alias("path"), "bin", "num")


def spread_spans(rows: DataFrame, prefix: str, stimuli: DataFrame, bins: DataFrame, rate: float = 1.0) -> DataFrame:
    """``spread`` of numbers that hold from start to end: means over all rows (stim_id, start, end, ...) that cover a bin."""
    names = [c for c in rows.columns if c not in ("stim_id", "start", "end")]
    means = spans.span_bins(rows, stimuli, rate).groupBy("stim_id", "bin").agg(*(F.avg(c).alias(c) for c in names))
    return bins.join(rows.select("stim_id").distinct(), "stim_id", "left_semi").join(means, ["stim_id", "bin"], "left").unpivot(["stim_id", "bin"], names, "name", "num").select("stim_id", F.concat(F.lit(f"{prefix}/"), "name").alias("path"), "bin", "num")


def with_text(segments: DataFrame, text: str = "text") -> DataFrame:
    """Segments that say something: those whose text is null or white space alone are left out."""
    return segments.where(F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("")) != "")


def speech_gate(stimuli: DataFrame, segments: DataFrame) -> DataFrame:
    """Stimuli with has_speech, whether any segment says something, and note: why language channels have nothing, where it is so."""
    spoken = with_text(segments).select("stim_id").distinct().withColumn("said", F.lit(True))
    tried = segments.select("stim_id").distinct().withColumn("tried", F.lit(True))
    rows = stimuli.join(spoken, "stim_id", "left").join(tried, "stim_id", "left")
    note = F.when(F.col("said").isNull(), F.when(F.col("tried").isNull(), "no transcript").otherwise("no speech found"))
    return rows.select(*stimuli.columns, F.coalesce("said", F.lit(False)).alias("has_speech"), note.alias("note"))


def speech(words: DataFrame, segments: DataFrame, stimuli: DataFrame, bins: DataFrame) -> DataFrame:
    """(stim_id, path, bin, num): whether anyone speaks, and how many words begin, in each bin of a stimulus that has a transcript. The words are those that the language channels read."""
    rates = G.event_count(words.select("stim_id", F.col("start").alias("t")), bins).select("stim_id", F.lit("audio/speech/word_rate").alias("path"), "bin", F.col("n").cast("double").alias("num"))
    heard = spans.any_overlap(segments, stimuli, bins).select("stim_id", F.lit("audio/speech/speech_present").alias("path"), "bin", F.col("flag").cast("double").alias("num"))
    return rates.union(heard).join(segments.select("stim_id").distinct(), "stim_id", "left_semi")


def lexical(words: DataFrame, norms: DataFrame, names: list[str], bins: DataFrame, every: bool = False) -> DataFrame:
    """(stim_id, path, bin, num): means of word length and of each norm of the words (stim_id, start, text) that begin in a bin. ``every`` as in ``spread``."""
    rows = words.withColumn("word", scalars.clean_word(F.col("text"))).join(norms, "word", "left").select("stim_id", F.col("start").alias("t"), F.length("word").cast("double").alias("word_length"), *names)
    return spread(rows, "language/lexical", bins, every=every)


def probe(streams: DataFrame, containers: DataFrame) -> DataFrame:
    """(stim_id, duration_sec, has_video, has_audio, fps, width, height) of a container (stim_id, duration) and its streams (stim_id, kind, duration, fps, width, height): the container's duration, else the video's, else the sound's, else 0."""
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    found = streams.groupBy("stim_id").agg(
        F.max(F.col("kind") == "video").alias("has_video"), F.max(F.col("kind") == "audio").alias("has_audio"), of("video", "duration").alias("video"), of("audio", "duration").alias("audio"),
        *(of("video", c).alias(c) for c in ("fps", "width", "height")))
    known = lambda c: F.when(F.col(c) > 0, F.col(c))
    duration = F.coalesce(known("duration"), known("video"), known("audio"), F.lit(0.0))
    rows = containers.join(found, "stim_id", "left")
    return rows.select("stim_id", duration.alias("duration_sec"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("has_video", "has_audio")), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("fps", "width", "height")))

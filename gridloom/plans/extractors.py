"""The extractors over native outputs of models: transcripts and what reads them, detections, windows, replies.

Native tables: segments (stim_id, i, text, start, end), norms (word and a column a norm), parses (stim_id, i, heads, pos),
tokens (stim_id, i, k, logits, target), sentiment_logits and emotion_logits (stim_id, i, logits), embeddings (stim_id, i,
vec), guesses (stim_id, i, reply), frames_seen (stim_id, t), faces and people (stim_id, t and boxes), face_logits (stim_id,
t, logits, valence, arousal), scene_logits (stim_id, t, logits), frame_vectors (stim_id, t, vec), flow (stim_id, t, u, v),
depth_maps (stim_id, t, d), clips, sound_windows (stim_id, start, end, logits), voice (stim_id, start, end, arousal,
dominance, valence), replies (stim_id, k, start, end, reply), colors (stim_id, t, h), frame_features (stim_id, t, vec),
sound_vectors (stim_id, start, end, vec); vocabularies prompts (k, vec, scale, bias) and sound_prompts (k, vec, scale).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import events, native, products, shape, signals
from gridloom.operators.typed import sample, scalars_of, together
from gridloom.plans.graph import Made, Node
from gridloom.schemas import MODALITIES
from gridloom.shared import staged

Tables = dict[str, DataFrame]
SEEN = ("audiovisual", "video-only")
HEARD = ("audiovisual", "audio-only")
SPOKEN = ("audiovisual", "audio-only", "text-only")


def _timed(t: Tables, name: str) -> DataFrame:
    """Rows of a segment with when it is said."""
    return t[name].join(t["segments"].select("stim_id", "i", "start", "end"), ["stim_id", "i"])


def _classes(rows: DataFrame, vec: str, top: str | None, chances: Column, **when: Column) -> DataFrame:
    """A vector of chances, and the place of the largest as a category."""
    held = rows.withColumn("chances", chances)
    parts = [sample(held, vec, vec=F.col("chances"), **when)]
    return together(*parts, *([sample(held, top, code=F.nullif(scalars.argmax(F.col("chances")), F.lit(-1)), **when)] if top else []))


def transcript(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    """The hub of all language: the words of the segments, each at the middle of its share of its segment's time.

    A segment's words are numbered and timed where they are, so none is shuffled; where nobody speaks is said once for a stimulus.
    """
    spelled = t["segments"].select("stim_id", F.col("i").alias("seg"), "start", "end", scalars.words_of(F.col("text")).alias("ws"))
    spread = spelled.select("stim_id", "seg", "start", F.greatest(F.col("end") - F.col("start"), F.lit(1e-3)).alias("long"), F.size("ws").alias("n"), F.posexplode("ws").alias("i", "text"))
    words = spread.select("stim_id", "seg", "i", "text", (F.col("start") + (F.col("i") + 0.5) / F.col("n") * F.col("long")).alias("start"))
    known = stimuli.join(t["segments"].select("stim_id"), "stim_id", "left_semi")
    silent = sample(known, "audio/speech/speech_present", F.lit(0.0), end=F.col("duration_sec"), v=F.lit(0.0))
    speaking = sample(t["segments"], "audio/speech/speech_present", end=F.col("end"), v=F.lit(1.0))
    said = lambda made: together(sample(made["words"], "audio/speech/word_rate", v=F.lit(1.0)), silent, speaking, sample(made["words"], "audio/speech/asr_text", label=F.col("text")))
    return Made(said, {"words": words})


def frequencies(words: DataFrame) -> DataFrame:
    """(word, freq_zipf): the decimal logarithm of how often a cleaned word stands in a thousand million words; exact, by sums within tasks first."""
    spelled = words.groupBy("text").agg(F.count("*").alias("n")).select(scalars.clean_word(F.col("text")).alias("word"), "n").where("word is not null")
    counts = staged(spelled.groupBy("word").agg(F.sum("n").alias("n")), "frequencies")
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.select("word", F.log10(F.col("n") / F.lit(float(total)) * 1e9).alias("freq_zipf"))


def lexicon(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    """Lengths, frequencies in this corpus, and norms of words."""
    words = t["words"].withColumn("word", scalars.clean_word(F.col("text")))
    names = [c for c in t["norms"].columns if c != "word"]
    rows = words.join(frequencies(t["words"]), "word", "left").join(t["norms"], "word", "left").withColumn("word_length", F.length("word"))
    return Made(scalars_of(rows, "language/lexical", ["word_length", "freq_zipf", *names]))


def syntax(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    found = native.segment_syntax(t["parses"].withColumnRenamed("i", "seg")).withColumnRenamed("seg", "i")
    return Made(scalars_of(_timed(t | {"found": found}, "found"), "language/syntax", ["tree_depth", "mean_dep_distance", "content_frac", "noun_frac", "verb_frac"], end="end"))


def surprisal(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    found = native.segment_surprisal(t["tokens"].select("stim_id", F.col("i").alias("seg"), F.col("k").alias("i"), "logits", "target")).withColumnRenamed("seg", "i")
    return Made(scalars_of(_timed(t | {"found": found}, "found"), "language/lexical", ["surprisal", "entropy"], end="end"))


def text_sentiment(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    rows = _timed(t, "sentiment_logits").withColumn("p", scalars.softmax(F.col("logits")))
    polarity = sample(rows, "affect/depicted/text_sentiment_polarity", end=F.col("end"), v=F.element_at("p", -1) - F.element_at("p", 1))
    return Made(together(_classes(rows, "affect/depicted/text_sentiment", "affect/depicted/text_sentiment_top", F.col("p"), end=F.col("end")), polarity))


def text_emotion(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    return Made(_classes(_timed(t, "emotion_logits"), "affect/depicted/text_emotion", "affect/depicted/text_emotion_top", F.transform("logits", scalars.sigmoid), end=F.col("end")))


def language_hl(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    """How each utterance follows from those before it, by vectors of meaning and by what a model that was asked expects."""
    vectors = t["embeddings"]
    found = signals.coherence(vectors).join(signals.drift(vectors), ["stim_id", "i"]).join(signals.novelty(vectors), ["stim_id", "i"]).withColumn("surprise", 1 - F.col("coherence"))
    series = scalars_of(_timed(t | {"found": found}, "found"), "language/hl", {"coherence": "semantic_coherence", "drift": "semantic_drift", "novelty": "semantic_novelty", "surprise": "semantic_surprise"}, end="end")
    asked = _timed(t, "guesses").withColumn("expected", scalars.unit_number(F.col("reply"))).withColumn("surprise", 1 - F.col("expected"))
    return Made(together(series, scalars_of(asked, "language/hl", {"expected": "narrative_expectedness", "surprise": "narrative_surprise"}, end="end")))


def expectation_prompts(segments: DataFrame, before: int = 3) -> DataFrame:
    """(stim_id, i, prompt): what a model is asked of each utterance that has one before it; its answers are the table guesses."""
    asked = signals.prior_context(segments, before).join(segments.select("stim_id", "i", "text"), ["stim_id", "i"]).where("context <> ''")
    return asked.select("stim_id", "i", F.concat(F.lit("So far: "), "context", F.lit("\nNext: "), "text", F.lit("\nFrom 0 (unexpected) to 1 (expected), how expected is what comes next? Answer with one number.")).alias("prompt"))


def faces(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    found = native.face_samples(t["frames_seen"], t["faces"]).withColumn("present", (F.col("n_faces") > 0).cast("double"))
    return Made(scalars_of(found, "visual/faces_bodies_gaze", {"n_faces": "n_faces", "present": "faces_present", "max_face_area_frac": "max_face_frac", "face_prob": "face_det_prob"}, "t"))


def pose(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    """People of each frame; those seen are also the agents of the social channels."""
    found = native.pose_samples(t["frames_seen"], t["people"]).withColumn("present", (F.col("n_persons") > 0).cast("double")).withColumn("agents", F.col("n_persons"))
    body = scalars_of(found, "visual/faces_bodies_gaze", {"n_persons": "n_persons", "present": "pose_present", "keypoint_score": "mean_kp_score"}, "t")
    return Made(together(body, scalars_of(found, "social", {"agents": "n_agents", "min_pair_distance": "min_pair_distance"}, "t")))


def face_emotion(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    """Means over the faces of a frame: chances, of which the largest is the category, and valence and arousal held within -1 and 1."""
    rows = t["face_logits"].withColumn("p", scalars.softmax(F.col("logits")))
    parts = rows.select("stim_id", "t", F.posexplode("p").alias("k", "x")).groupBy("stim_id", "t", "k").agg(F.avg("x").alias("x"))
    means = parts.groupBy("stim_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("p")).withColumn("start", F.col("t"))
    held = lambda c: F.least(F.greatest(F.col(c), F.lit(-1.0)), F.lit(1.0)).alias(c)
    numbers = rows.select("stim_id", "t", held("valence"), held("arousal")).groupBy("stim_id", "t").agg(F.avg("valence").alias("face_valence"), F.avg("arousal").alias("face_arousal"))
    return Made(together(_classes(means, "affect/depicted/face_emotion", "affect/depicted/face_emotion_top", F.col("p")), scalars_of(numbers, "affect/depicted", ["face_valence", "face_arousal"], "t")))


def scene_emotion(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    return Made(_classes(t["scene_logits"].withColumn("start", F.col("t")), "affect/depicted/emonet", "affect/depicted/emonet_top", scalars.softmax(F.col("logits"))))


def _centres(rows: DataFrame) -> DataFrame:
    """Windows as points at their middles."""
    return rows.withColumn("start", (F.col("start") + F.col("end")) / 2)


def action(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    return Made(_classes(_centres(t["clips"]), "visual/action/action_posteriors", "visual/action/action_top", scalars.softmax(F.col("logits"))))


def audio_events(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    return Made(_classes(_centres(t["sound_windows"]), "audio/high_level/audioset_tags", "audio/high_level/audioset_top", F.transform("logits", scalars.sigmoid)))


def vocal_affect(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    return Made(scalars_of(_centres(t["voice"]), "audio/speech", {k: f"voice_{k}" for k in ("arousal", "dominance", "valence")}))


def motion(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    return Made(scalars_of(native.motion_samples(t["flow"]), "visual/dynamic_motion", {"magnitude": "flow_magnitude", "camera": "camera_motion", "residual": "residual_motion"}, "t"))


def depth(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    return Made(scalars_of(native.depth_samples(t["depth_maps"]), "visual/saliency_aesthetics_depth", ["depth_mean", "depth_range", "foreground_frac", "depth_entropy"], "t"))


def visual_semantic(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    """Unit vectors of frames, and their chances against the prompts (k, vec, scale, bias) of a fixed vocabulary, each by itself."""
    unit = t["frame_vectors"].withColumn("start", F.col("t")).withColumn("e", scalars.let(scalars.wide(F.col("vec")), lambda v: F.transform(v, lambda x: F.try_divide(x, scalars.norm(v)))))
    scores = products.prompt_cosines(unit.select("stim_id", "start", "e"), "e", t["prompts"].select("k", "vec", "scale", "bias"))
    probed = scores.withColumn("p", F.transform("cosines", lambda q: scalars.sigmoid(q["scale"] * q["cosine"] + q["bias"])))
    return Made(together(sample(unit, "visual/high_level_static/siglip_embedding", vec=F.col("e")), sample(probed, "visual/high_level_static/siglip_probe", vec=F.col("p"))))


def shots(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    """Cuts where a frame's colours differ from the frame before, and the number of the shot at each bin."""
    before = F.lag("h").over(Window.partitionBy("stim_id").orderBy("t"))
    away = F.aggregate(F.zip_with("h", "p", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    cuts = signals.detect_cuts(t["colors"].withColumn("p", before).where("p is not null").select("stim_id", "t", away.alias("distance")))
    seen = bins.join(t["colors"].select("stim_id").distinct(), "stim_id", "left_semi")
    index = signals.shot_index(cuts, seen).join(seen, ["stim_id", "bin"])
    none = sample(seen, "visual/dynamic_motion/cut", F.col("time_sec"))  # frames were looked at, so no cut is a zero
    return Made(together(sample(cuts, "visual/dynamic_motion/cut", "t", v=F.lit(1.0)), none, sample(index, "visual/dynamic_motion/shot_index", "time_sec", v=F.col("shot"))))


def visual_dino(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    return Made(sample(t["frame_features"].withColumn("start", F.col("t")), "visual/high_level_static/dino_embedding", vec=F.col("vec")))


def audio_clap(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    """Vectors of stretches of sound, and their chances against all prompts (k, vec, scale) of a vocabulary together."""
    rows = _centres(t["sound_vectors"]).select("stim_id", "start", scalars.wide(F.col("vec")).alias("e"))
    scores = products.prompt_cosines(rows, "e", t["sound_prompts"].select("k", "vec", "scale"))
    probed = scores.withColumn("p", scalars.softmax(F.transform("cosines", lambda q: q["scale"] * F.coalesce(q["cosine"], F.lit(0.0)))))
    return Made(together(sample(rows, "audio/high_level/clap_embedding", vec=F.col("e")), sample(probed, "audio/high_level/clap_probe", vec=F.col("p"))))


def language_embedding(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    return Made(sample(_timed(t, "embeddings"), "language/embedding/qwen3", end=F.col("end"), vec=F.col("vec")))


#: Channels whose course says where one event ends and another begins: what changes slowly, of each class.
EVENT_PATHS = (
    "visual/low_level_static/luminance", "visual/low_level_static/colorfulness", "visual/dynamic_motion/flow_magnitude", "visual/faces_bodies_gaze/n_faces", "audio/low_level/rms", "audio/low_level/spectral_centroid",
    "audio/speech/speech_present", "audio/speech/word_rate", "language/hl/semantic_coherence", "affect/depicted/text_sentiment_polarity", "affect/depicted/face_valence",
)


def event_segmentation(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    """States and boundaries from the scalar channels that all other extractors made."""
    known = t["channels"].where(F.col("path").isin(*EVENT_PATHS) & F.col("applicable"))
    wide = shape.to_wide(known, list(EVENT_PATHS))
    found = events.event_segments(wide, [p.replace("/", "__") for p in EVENT_PATHS]).join(bins, ["stim_id", "bin"])
    looked = found.where("event_id is not null")
    none = sample(looked, "situation/event_boundary", "time_sec")  # every bin was looked at, so none is a zero
    return Made(together(sample(looked, "situation/event_id", "time_sec", v=F.col("event_id")), none, sample(looked.where("boundary <> 0"), "situation/event_boundary", "time_sec", v=F.lit(1.0))))


#: Which field of a reply is which channel.
REPLY_CHANNELS = {
    "interaction_type": "social/interaction_type", "dominance": "social/dominance", "scene_description": "situation/scene_description", "setting": "situation/setting", "indoor_outdoor": "situation/indoor_outdoor",
    "depicted_emotion": "affect/depicted/vlm_emotion", "valence": "affect/depicted/vlm_valence", "arousal": "affect/depicted/vlm_arousal",
}


def reasoning(stimuli: DataFrame, bins: DataFrame, t: Tables) -> Made:
    """What a model said of each window, by field; a bin that two windows share has what the later one says."""
    rows = t["replies"].withColumn("f", scalars.reply_fields(F.col("reply")))
    labels = [sample(rows, REPLY_CHANNELS[k], end=F.col("end"), label=F.col(f"f.{k}")) for k in scalars.REPLY_LABELS]
    return Made(together(*labels, *(sample(rows, REPLY_CHANNELS[k], end=F.col("end"), v=F.col(f"f.{k}")) for k in scalars.REPLY_NUMBERS)))


NODES = [
    Node("ASR", ("segments",), transcript, ("words",), SPOKEN),
    Node("LanguageLexical", ("words", "norms"), lexicon, (), SPOKEN),
    Node("LanguageSyntax", ("words", "segments", "parses"), syntax, (), SPOKEN),
    Node("LanguageSurprisal", ("words", "segments", "tokens"), surprisal, (), SPOKEN),
    Node("TextSentiment", ("words", "segments", "sentiment_logits"), text_sentiment, (), SPOKEN),
    Node("TextEmotion", ("words", "segments", "emotion_logits"), text_emotion, (), SPOKEN),
    Node("LanguageHL", ("words", "segments", "embeddings", "guesses"), language_hl, (), SPOKEN),
    Node("Faces", ("frames_seen", "faces"), faces, (), SEEN, "vision"),
    Node("Pose", ("frames_seen", "people"), pose, (), SEEN, "vision"),
    Node("FaceEmotion", ("face_logits",), face_emotion, (), SEEN, "vision"),
    Node("VisualEmoNet", ("scene_logits",), scene_emotion, (), SEEN, "vision"),
    Node("VisualAction", ("clips",), action, (), SEEN, "vision"),
    Node("VisualMotion", ("flow",), motion, (), SEEN, "vision"),
    Node("VisualDepth", ("depth_maps",), depth, (), SEEN, "vision"),
    Node("VisualSemantic", ("frame_vectors", "prompts"), visual_semantic, (), SEEN, "vision"),
    Node("VisualDino", ("frame_features",), visual_dino, (), SEEN, "vision"),
    Node("LanguageEmbedding", ("words", "segments", "embeddings"), language_embedding, (), SPOKEN),
    Node("VisualShots", ("colors",), shots, (), SEEN),
    Node("AudioEvents", ("sound_windows",), audio_events, (), HEARD, "audio_hl"),
    Node("AudioClap", ("sound_vectors", "sound_prompts"), audio_clap, (), HEARD, "audio_hl"),
    Node("VocalAffect", ("voice",), vocal_affect, (), HEARD, "audio_hl"),
    Node("Reasoning", ("replies",), reasoning, (), SEEN, "vlm"),
    Node("EventSegmentation", ("channels",), event_segmentation, (), MODALITIES, "events"),
]

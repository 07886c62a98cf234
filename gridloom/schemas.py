"""Table schemas, vocabularies and the channel template.

Values here are part of the data model and are fixed.
"""

from __future__ import annotations

from pyspark.sql import types as T

MODALITIES = ("audiovisual", "video-only", "audio-only", "text-only")
DTYPES = ("scalar", "vector", "categorical", "label", "bool", "event")
SCALAR_LIKE = ("scalar", "bool", "event")
NUMERIC = ("scalar", "bool", "event", "vector")
CLASSES = ("visual", "audio", "language", "social", "situation", "affect")
LEVELS = ("low", "mid", "high")

SAMPLES = T.StructType([T.StructField("stim_id", T.StringType()), T.StructField("t", T.DoubleType()), T.StructField("v", T.DoubleType())])
WORDS = T.StructType([
    T.StructField("stim_id", T.StringType()), T.StructField("seg_idx", T.IntegerType()), T.StructField("word_idx", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("prob", T.DoubleType()),
])
CHANNEL_VALUES = T.StructType([
    T.StructField("stim_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("bin", T.IntegerType()), T.StructField("time_sec", T.DoubleType()),
    T.StructField("num", T.DoubleType()), T.StructField("vec", T.ArrayType(T.FloatType())), T.StructField("code", T.IntegerType()), T.StructField("label", T.StringType()),
])
MANIFEST = T.StructType([T.StructField(n, T.StringType() if n not in ("duration_sec", "fps", "width", "height") else T.DoubleType()) for n in ("id", "path", "source", "modality", "duration_sec", "fps", "width", "height", "has_video", "has_audio", "rights")])

# File extensions and names of the media scan.
MEDIA_EXTENSIONS = ("mp4", "mkv", "mov", "avi", "webm", "m4v", "wav", "mp3", "m4a", "flac", "aac", "ogg")
TEXT_EXTENSIONS = ("txt", "text", "story")
SKIPPED_STEMS = ("readme", "sources", "contents", "license")
SKIPPED_FOLDERS = ("Post_20140821_version",)

# Usage rights by source.
RIGHTS = {
    "open": "CC-BY (Blender open movies)",
    "spacetop": "lab-internal",
    "stories": "lab-internal",
    "narratives": "OpenNeuro ds002345 (CC0)",
    "hcp": "HCP (credentialed; not redistributable)",
    "imensa": "lab-internal",
    "kungfury": "third-party (research use)",
}

# Vocabularies of vector and categorical channels.
VOCABULARIES = {
    "text_emotion": "admiration amusement anger annoyance approval caring confusion curiosity desire disappointment disapproval disgust embarrassment excitement fear gratitude grief joy love nervousness optimism pride realization relief remorse sadness surprise neutral".split(),
    "text_sentiment": ["negative", "neutral", "positive"],
    "emonet": ["Adoration", "Aesthetic Appreciation", "Amusement", "Anxiety", "Awe", "Boredom", "Confusion", "Craving", "Disgust", "Empathic Pain", "Entrancement", "Excitement", "Fear", "Horror", "Interest", "Joy", "Romance", "Sadness", "Sexual Desire", "Surprise"],
    "face_emotion": ["Anger", "Contempt", "Disgust", "Fear", "Happiness", "Neutral", "Sadness", "Surprise"],
    "siglip_probe": [
        "people", "a single person", "a crowd of people", "a human face close-up", "an indoor scene", "an outdoor natural landscape", "a city or street scene", "an animal",
        "a vehicle", "food", "text or writing on screen", "a dark, low-light scene", "a bright and colorful scene", "fast motion or action", "a calm, static scene", "water or sky",
    ],
    "clap_probe": ["speech", "music", "singing", "silence", "background noise", "laughter", "applause", "footsteps", "a vehicle engine", "nature sounds", "a crowd of people", "wind"],
    "mfcc": [f"mfcc{i}" for i in range(13)],
    "chroma": ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"],
}

# The preferred channels of a viewer, in order.
PREFERRED = (
    "visual/low_level_static/luminance",
    "visual/dynamic_motion/flow_magnitude",
    "audio/low_level/rms",
    "audio/speech/word_rate",
    "audio/speech/voice_valence",
    "affect/depicted/vlm_valence",
    "visual/faces_bodies_gaze/n_faces",
    "situation/event_boundary",
)
EMBEDDINGS = ("siglip_embedding", "dino_embedding", "clap_embedding", "qwen3", "llama_ar")
INDEX_CHANNELS = ("situation/event_id", "visual/dynamic_motion/shot_index")

# The channel template, path|dtype|dim|units|resample|native rate.
TEMPLATE = """
visual/low_level_static/luminance|scalar||0-1|mean|fps
visual/low_level_static/rms_contrast|scalar||0-1|mean|fps
visual/low_level_static/colorfulness|scalar|||mean|fps
visual/low_level_static/edge_density|scalar||0-1|mean|fps
visual/low_level_static/entropy|scalar||bits|mean|fps
visual/low_level_static/r_mean|scalar|||mean|fps
visual/low_level_static/g_mean|scalar|||mean|fps
visual/low_level_static/b_mean|scalar|||mean|fps
visual/low_level_static/hue_mean|scalar||0-1|mean|fps
visual/low_level_static/sat_mean|scalar||0-1|mean|fps
visual/low_level_static/val_mean|scalar||0-1|mean|fps
visual/low_level_static/fft_slope|scalar|||mean|fps
visual/high_level_static/siglip_embedding|vector|768||mean|fps
visual/high_level_static/siglip_probe|vector|16|sigmoid|mean|fps
visual/high_level_static/dino_embedding|vector|384||mean|fps
visual/dynamic_motion/flow_magnitude|scalar||px|mean|fps
visual/dynamic_motion/camera_motion|scalar||px|mean|fps
visual/dynamic_motion/residual_motion|scalar||px|mean|fps
visual/dynamic_motion/cut|event||count|count|event
visual/dynamic_motion/shot_index|scalar||index|step|shot
visual/action/action_posteriors|vector|400|softmax|mean|window
visual/action/action_top|categorical|400||mode|window
visual/faces_bodies_gaze/n_faces|scalar||count|mean|fps
visual/faces_bodies_gaze/faces_present|bool||0/1|any|fps
visual/faces_bodies_gaze/max_face_frac|scalar||0-1|mean|fps
visual/faces_bodies_gaze/face_det_prob|scalar|||mean|fps
visual/faces_bodies_gaze/n_persons|scalar||count|mean|fps
visual/faces_bodies_gaze/pose_present|bool||0/1|any|fps
visual/faces_bodies_gaze/mean_kp_score|scalar|||mean|fps
visual/saliency_aesthetics_depth/saliency_mean|scalar|||mean|fps
visual/saliency_aesthetics_depth/saliency_peak|scalar|||mean|fps
visual/saliency_aesthetics_depth/saliency_entropy|scalar||bits|mean|fps
visual/saliency_aesthetics_depth/salient_area_frac|scalar|||mean|fps
visual/saliency_aesthetics_depth/depth_mean|scalar|||mean|fps
visual/saliency_aesthetics_depth/depth_range|scalar|||mean|fps
visual/saliency_aesthetics_depth/foreground_frac|scalar|||mean|fps
visual/saliency_aesthetics_depth/depth_entropy|scalar||bits|mean|fps
audio/low_level/rms|scalar|||mean|sr/512
audio/low_level/spectral_centroid|scalar||Hz|mean|sr/512
audio/low_level/spectral_bandwidth|scalar||Hz|mean|sr/512
audio/low_level/spectral_rolloff|scalar||Hz|mean|sr/512
audio/low_level/spectral_flatness|scalar|||mean|sr/512
audio/low_level/zcr|scalar||rate|mean|sr/512
audio/low_level/onset_strength|scalar|||mean|sr/512
audio/low_level/f0|scalar||Hz|mean|sr/512
audio/low_level/mfcc|vector|13||mean|sr/512
audio/low_level/chroma|vector|12||mean|sr/512
audio/low_level/tempo|scalar||BPM|nearest|whole-stimulus
audio/high_level/audioset_tags|vector|527|sigmoid|mean|window~4.0s
audio/high_level/audioset_top|categorical|527||mode|window~4.0s
audio/high_level/clap_embedding|vector|512||mean|window~4.0s
audio/high_level/clap_probe|vector|12|softmax|mean|window~4.0s
audio/speech/speech_present|bool||0/1|any|word
audio/speech/word_rate|scalar||words/s|count|word
audio/speech/asr_text|label|||concat|word
audio/speech/voice_arousal|scalar||0-1|mean|window~2.0s
audio/speech/voice_dominance|scalar||0-1|mean|window~2.0s
audio/speech/voice_valence|scalar||0-1|mean|window~2.0s
language/lexical/freq_zipf|scalar||zipf|mean|word
language/lexical/word_length|scalar||chars|mean|word
language/lexical/valence|scalar|||mean|word
language/lexical/arousal|scalar|||mean|word
language/lexical/dominance|scalar|||mean|word
language/lexical/concreteness|scalar|||mean|word
language/lexical/aoa|scalar|||mean|word
language/lexical/surprisal|scalar||bits|mean|utterance
language/lexical/entropy|scalar||bits|mean|utterance
language/syntax/tree_depth|scalar|||mean|utterance
language/syntax/mean_dep_distance|scalar|||mean|utterance
language/syntax/content_frac|scalar|||mean|utterance
language/syntax/noun_frac|scalar|||mean|utterance
language/syntax/verb_frac|scalar|||mean|utterance
language/embedding/qwen3|vector|1024||mean|utterance
language/embedding/llama_ar|vector|4096||mean|utterance
language/hl/semantic_coherence|scalar|||mean|utterance
language/hl/semantic_drift|scalar|||mean|utterance
language/hl/semantic_novelty|scalar|||mean|utterance
language/hl/semantic_surprise|scalar|||mean|utterance
language/hl/narrative_expectedness|scalar|||mean|utterance
language/hl/narrative_surprise|scalar|||mean|utterance
social/n_agents|scalar||count|mean|fps
social/min_pair_distance|scalar||0-1|mean|fps
social/interaction_type|label|||vlm|window~5.0s
social/dominance|scalar|||vlm|window~5.0s
situation/scene_description|label|||vlm|window~5.0s
situation/setting|label|||vlm|window~5.0s
situation/indoor_outdoor|label|||vlm|window~5.0s
situation/event_id|scalar||state-index|mode|derived
situation/event_boundary|event||count|count|derived
affect/depicted/emonet|vector|20|softmax|mean|fps
affect/depicted/emonet_top|categorical|20||mode|fps
affect/depicted/face_emotion|vector|8|softmax|mean|fps
affect/depicted/face_emotion_top|categorical|8||mode|fps
affect/depicted/face_valence|scalar||[-1,1]|mean|fps
affect/depicted/face_arousal|scalar||[-1,1]|mean|fps
affect/depicted/text_emotion|vector|28|sigmoid|mean|utterance
affect/depicted/text_emotion_top|categorical|28||mode|utterance
affect/depicted/text_sentiment|vector|3|softmax|mean|utterance
affect/depicted/text_sentiment_polarity|scalar||[-1,1]|mean|utterance
affect/depicted/text_sentiment_top|categorical|3||mode|utterance
affect/depicted/vlm_emotion|label|||vlm|window~5.0s
affect/depicted/vlm_valence|scalar|||vlm|window~5.0s
affect/depicted/vlm_arousal|scalar|||vlm|window~5.0s
""".strip()


def template_rows() -> list[tuple]:
    """(path, dtype, dim, units, resample, native_rate, components) of each channel of the template."""
    out = []
    for line in TEMPLATE.split("\n"):
        path, dtype, dim, units, resample, native = line.split("|")
        leaf = path.split("/")[-1]
        out.append((path, dtype, int(dim) if dim else None, units, resample, native, VOCABULARIES.get(leaf) if dtype == "vector" else None))
    return out

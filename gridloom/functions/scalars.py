"""Column functions: text, vectors, JSON and arithmetic with the library's null rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sentence ends at . ! or ? before white space.
SENTENCE_END = r"(?<=[.!?])\s+"


def clean_nan(v: Column) -> Column:
    """NULL is the only mark of a missing value."""
    return F.nanvl(v.cast("double"), F.lit(None).cast("double"))


def clean_word(word: Column) -> Column:
    """Small letters and apostrophes only; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(word), "[^a-z']+", ""), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column, word: str = r"\S") -> Column:
    """How many runs of characters of the class ``word`` a text has, without an array of them: each becomes one letter, with what is around it."""
    other = f"[^{word[1:-1]}]" if word.startswith("[") and not word.startswith("[^") else f"[{word[2:-1]}]" if word.startswith("[^") else r"\s"
    letters = F.regexp_replace(text, F.lit(f"(?:{other})*+(?:{word})++(?:{other})*+"), F.lit("x"))
    return F.when(text.rlike(word), F.length(letters)).when(text.isNotNull(), 0)


def sentences_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(text), SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")  # F.trim by itself would take the place for the letters to trim


def tweet_text(text: Column) -> Column:
    """Mentions become @user and links http; white space collapses."""
    swap = lambda w: F.when(w.startswith("@") & (F.length(w) > 1), "@user").when(w.startswith("http"), "http").otherwise(w)
    return F.array_join(F.transform(words_of(text), swap), " ")


def first_json(text: Column) -> Column:
    """From the first brace to the last one."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def unit_number(text: Column) -> Column:
    """The first number of 0 to 1 in a text, clipped; null if there is none."""
    found = F.nullif(F.regexp_extract(text, r"[01](?:\.\d+)?|\.\d+", 0), F.lit(""))
    return F.least(F.greatest(found.try_cast("double"), F.lit(0.0)), F.lit(1.0))


def wide(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def softmax(v: Column) -> Column:
    powers = let(v, lambda a: let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top))))
    return let(powers, lambda a: let(F.aggregate(a, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(a, lambda x: x / total)))


def argmax(v: Column) -> Column:
    """The place of the first maximum, from 0; -1 for null."""
    return F.coalesce(F.array_position(v, F.array_max(v)) - 1, F.lit(-1)).cast("int")


def entropy(counts: Column) -> Column:
    """Shannon entropy, in bits, of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    share = F.transform(F.filter(counts, lambda x: x > 0), lambda x: x / total)
    return -F.aggregate(share, F.lit(0.0), lambda s, p: s + p * F.log2(p))


def histogram_bin(x: Column, bins: int) -> Column:
    """Of values of 0 to 1; the last bin holds its upper edge."""
    return F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int")


def short_name(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")


def rgb(code: Column) -> Column:
    """#rrggbb as an array of three numbers of 0 to 255."""
    return F.array(*(F.conv(F.substring(code, 2 + 2 * k, 2), 16, 10).cast("int") for k in range(3)))


def blend(color: Column, toward: int, share: float) -> Column:
    """An array of three numbers moved by a share of the way toward white (255) or black (0), to whole numbers."""
    return F.transform(color, lambda x: F.round(x + (toward - x) * share).cast("int"))


def truncated(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def label_text(name: Column, levels: Column) -> Column:
    """A channel's last name with spaces, and in brackets how many levels or dimensions it has, if it has any."""
    shown = F.replace(F.element_at(F.split(name, "/"), -1), F.lit("_"), F.lit(" "))
    return F.when(levels.isNull() | (levels == 0), shown).otherwise(F.concat(shown, F.lit(" ("), levels.cast("string"), F.lit(")")))


def iso_stamp(ts: Column) -> Column:
    """Whole seconds, in UTC where the session is."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def log_softmax(v: Column) -> Column:
    return let(v, lambda a: let(F.array_max(a), lambda top: let(top + F.ln(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top))), lambda whole: F.transform(a, lambda x: x - whole))))


def surprisal_bits(log_p: Column, target: Column) -> Column:
    """Of an array of natural logarithms of chances, that of place ``target`` (from 0), in bits."""
    return -F.get(log_p, target) / F.ln(F.lit(2.0))


def entropy_bits(log_p: Column) -> Column:
    return -F.aggregate(log_p, F.lit(0.0), lambda s, x: s + F.exp(x) * x) / F.ln(F.lit(2.0))


def median(v: Column) -> Column:
    """Of an array; the mean of the two in the middle where their number is even; null for none."""
    return let(F.array_sort(v), lambda a: F.when(F.size(a) > 0, (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2))


#: What a reply may say, as labels and as numbers.
REPLY_LABELS = ("scene_description", "setting", "indoor_outdoor", "interaction_type", "depicted_emotion")
REPLY_NUMBERS = ("dominance", "valence", "arousal")


def reply_fields(text: Column) -> Column:
    """The labels, cut to 200 characters, and the numbers of the object in a reply; numbers may stand as text. All null for a bad reply."""
    schema = ", ".join(f"{k} string" for k in (*REPLY_LABELS, *REPLY_NUMBERS))
    return let(F.from_json(first_json(text), schema), lambda o: F.struct(*(truncated(o[k]).alias(k) for k in REPLY_LABELS), *(o[k].try_cast("double").alias(k) for k in REPLY_NUMBERS)))

"""Quality rules: counts over whole texts, fixed limits, and an isolation forest on what the counts say of a text.

One pass of Arrow batches counts everything a rule needs. The forest is fitted on rule statistics of a bounded sample
of labelled documents: random splits isolate an odd document early, so a short mean path marks it. The threshold on
path lengths is set on the same labelled rows: the score that best parts good rows from bad ones among those that lose
at most ``max_good_loss`` of the good ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import tokens

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def rule_counts(col: pa.Array | pa.ChunkedArray, window: int = 5) -> dict[str, np.ndarray]:
    """The counts of COUNTS of each text of a string column; a null text has none.

    Words are runs outside ASCII white space. n_repeat_words counts words in windows of ``window`` words that the text
    has twice or more, the first included; n_dup_lines lines with a word that equal an earlier line of the text.
    """
    data, offsets = tokens.column_bytes(col)
    starts, ends, word_offsets = tokens.words(data, offsets)
    n_words = len(starts)
    h, other = tokens.span_prints(data, starts, ends)
    del starts, ends
    places = np.flatnonzero(tokens.whole_windows(word_offsets, window))
    text_of = np.searchsorted(word_offsets, places, "right").astype(np.uint64)
    keyed = tokens.mix(tokens.window_hashes(h, window)[places] + text_of * np.uint64(tokens.BYTE_BASE))
    check = tokens.window_hashes(other, window)[places]
    del h, other, text_of
    order = np.argsort(keyed)
    in_order = keyed[order]
    same = in_order[1:] == in_order[:-1]
    del in_order
    if (same & (check[order][1:] != check[order][:-1])).any():
        order = np.lexsort((check, keyed))
        same = (keyed[order][1:] == keyed[order][:-1]) & (check[order][1:] == check[order][:-1])
    del keyed, check
    twice = np.zeros(len(places), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    flags = np.zeros(n_words, bool)
    flags[places] = twice
    repeated = tokens.covered(flags, n_words, window) if twice.any() else flags
    whole = np.ascontiguousarray(data)
    lead = (whole & 0xC0) != 0x80
    return {
        "n_words": np.diff(word_offsets),
        "word_chars": tokens.per_text(lead & ~tokens.SPACE[whole], offsets),
        "n_symbols": tokens.per_text(SYMBOLS[whole], offsets),
        "n_dup_lines": np.array([_dup_lines(whole[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64),
        "n_repeat_words": tokens.per_text(repeated, word_offsets),
    }


def base_failed(c: dict[str, np.ndarray], min_words: int = 10, max_repeat_percent: int = 20) -> np.ndarray:
    return (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_percent * c["n_words"])


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Statistics of the rules, one row a text: shares of symbols, repeated lines and repeated words among the words, as roots so that small shares differ, and the mean word length in tens."""
    words = np.maximum(c["n_words"], 1)
    return np.column_stack([np.sqrt(c["n_symbols"] / words), c["word_chars"] / words / 10, np.sqrt(c["n_dup_lines"] / words), np.sqrt(c["n_repeat_words"] / words)])


def _mean_path(n: np.ndarray | int) -> np.ndarray:
    """The mean path to a point among n in a random binary tree."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


@dataclass
class Forest:
    """Isolation trees as arrays [tree, node]; node i's children are 2i + 1 and 2i + 2; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    sample: int
    threshold: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for odd rows, below 0.5 for usual ones."""
        total = np.zeros(len(x))
        for feature, cut, path in zip(self.feature, self.cut, self.path, strict=True):
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = 2 * node + 1 + (x[rows, feature[node]] >= cut[node])
            total += path[at]
        return 2.0 ** (-total / len(self.feature) / max(float(_mean_path(self.sample)), 1.0))


def fit_forest(x: np.ndarray, trees: int = 100, sample: int = 256, margin: float = 0.3, seed: int = 3) -> Forest:
    """Isolation trees, each over ``sample`` rows drawn without repeats.

    A split is uniform over a feature's range in the node, which the root widens by ``margin`` on both sides: so values
    that no fitted row comes near fall into empty leaves soon, in features too in which the fitted rows are all alike.
    """
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    depth = max(1, int(np.ceil(np.log2(max(sample, 2)))))
    nodes = 2 ** (depth + 1) - 1
    feature, cut, path = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        drawn = x[rng.choice(len(x), sample, replace=False)]
        todo = [(0, 0, drawn, drawn.min(0) - margin, drawn.max(0) + margin)]
        while todo:
            node, level, rows, least, most = todo.pop()
            if level == depth or len(rows) < 2:
                path[t, node] = level + float(_mean_path(len(rows)))
                continue
            f = rng.integers(x.shape[1])
            at = rng.uniform(least[f], most[f])
            feature[t, node], cut[t, node] = f, at
            low, below, above = rows[:, f] < at, most.copy(), least.copy()
            below[f] = above[f] = at
            todo += [(2 * node + 1, level + 1, rows[low], least, below), (2 * node + 2, level + 1, rows[~low], above, most)]
    return Forest(feature, cut, path, sample)


def calibrate(scores: np.ndarray, good: np.ndarray, max_good_loss: float) -> float:
    """The threshold, documents above which go: the best difference of bad and good rows rejected, with few good ones lost. Without bad or without good rows, nothing goes."""
    if not good.any() or good.all():
        return 1.0
    cuts = np.unique(scores)
    lost, caught = ((scores[kind][None, :] > cuts[:, None]).mean(1) for kind in (good, ~good))
    gain = np.where(lost <= max_good_loss, caught - lost, -1)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return 1.0
    above = cuts[cuts > cuts[best]]
    return float((cuts[best] + above[0]) / 2) if len(above) else float(cuts[best])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (piece for whole in batches for piece in tokens.slices(whole)):
        c = rule_counts(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(base_failed(c)), pa.array(features(c).tolist(), pa.list_(pa.float64()))], names=["good", "failed", "x"])


def fit(docs: DataFrame, labels: DataFrame, most: int = 4096, max_good_loss: float = 0.005) -> Forest | None:
    """Fit and calibrate on at most ``most`` labelled documents (labels: doc_id, quality 1 or 0), chosen by hash.

    Half of them, at most, are of either quality. Rows of labels without a doc_id or a quality, and those without a
    document, are passed over; a document with differing labels counts as bad, and what fails the fixed limits is left
    out. None if no labelled document is left.
    """
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.min("quality") > 0).alias("good"))
    chosen = [r for side in (True, False) for r in one.where(F.col("good") == side).orderBy(F.xxhash64("label_id"), "label_id").limit(most // 2).collect()]
    if not chosen:
        return None
    picked = docs.sparkSession.createDataFrame(chosen, "label_id long, good boolean")
    rows = docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").join(F.broadcast(picked), "label_id").groupBy("label_id", "good").agg(F.min("text").alias("text"))
    found = rows.select("good", "text").mapInArrow(_count_batches, "good boolean, failed boolean, x array<double>").where("not failed").toPandas()
    if not len(found):
        return None
    found["key"] = [tuple(v) for v in found["x"]]
    found = found.sort_values(["key", "good"])
    x, good = np.stack(found["x"].to_numpy()), found["good"].to_numpy(bool)
    forest = fit_forest(x[good] if good.any() else x)
    forest.threshold = calibrate(forest.scores(x), good, max_good_loss)
    return forest


def verdicts(c: dict[str, np.ndarray], forest: Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, the anomaly score (0 without a forest) and kept."""
    failed = base_failed(c)
    score = forest.scores(features(c)) if forest is not None and len(failed) else np.zeros(len(failed))
    return failed, score, ~failed & (score <= (forest.threshold if forest is not None else 1.0))


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """doc_id, the counts of COUNTS, base_failed, kept and score for every row of ``docs`` (doc_id, text).

    A null or empty text has counts of zero and fails for want of words. Rows are judged each on its own, so repeated
    rows, ties and null doc_ids each keep a row; other columns are not read; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in tokens.slices(whole)):
            c = rule_counts(batch.column("text"))
            failed, score, kept = verdicts(c, forest)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c[k], pa.int64()) for k in COUNTS), pa.array(failed), pa.array(kept), pa.array(score)], names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {counts}, base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in tokens.slices(whole)):
            yield batch.filter(pa.array(verdicts(rule_counts(batch.column("text")), forest)[2]))

    return docs.mapInArrow(run, docs.schema)

"""Removal of word sequences that occur earlier in the corpus.

Every window of ``n`` words gets two Rabin-Karp hashes, of 64 and of 32 bits, over independent hashes of its words (the
halves of XXH3 of 128 bits), so that two different sequences are taken for one with a chance of 2**-96 a pair. Documents are dealt into
parts by ranges of doc_id, and of texts where one id has more than a part, so that the order of parts is the order of
documents. Each part sends its distinct hashes,
sorted, as one packed row for each range of hashes; a range's rows meet in one Spark group, which counts the parts of
each hash and answers each row with one bit a hash: whether an earlier part has it. A part then knows of each of its
windows whether its sequence starts earlier, merges those windows into maximal intervals and drops the words in them.

What moves: each text once, about eight bytes a window, and a bit a window back. A passage that a third of all
documents share is one hash from each part, so it weighs no more than any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import tokens
from gridloom.llm.parts import grown, plan_parts

CHECK_BASE = 0xA0761D6478BD642F


def _in_order(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, [("id", "ascending"), ("text", "ascending")], null_placement="at_end"))


def _prints(table: pa.Table, n: int) -> dict[str, np.ndarray]:
    """The windows of a part's documents, in order: places, and runs of equal hashes in the order of the hashes."""
    data, offsets = tokens.column_bytes(table["text"])
    starts, ends, word_offsets = tokens.words(data, offsets)
    h, other = tokens.span_prints(data, starts, ends)
    places = np.flatnonzero(tokens.whole_windows(word_offsets, n))
    high = tokens.window_hashes(h, n)[places]
    low = tokens.window_hashes(other, n, CHECK_BASE)[places].astype(np.uint32)
    order = np.argsort(high, kind="stable")
    high, low = high[order], low[order]
    same = high[1:] == high[:-1]
    if (same & (low[1:] != low[:-1])).any():
        fine = np.lexsort((order, low, high))
        order, high, low = order[fine], high[fine], low[fine]
        same = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
    new = np.ones(len(high), bool)
    new[1:] = ~same
    return {"places": places, "order": order, "new": new, "high": high[new], "low": low[new], "word_offsets": word_offsets, "starts": starts, "ends": ends, "data": data, "offsets": offsets}


def _bucket_edges(high: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2**bits ranges of hashes begins among sorted hashes, and the end."""
    firsts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(high, firsts), len(high))


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as the bytes of their differences, the bytes of like weight together."""
    gaps = np.diff(values, prepend=values[:1] * np.uint64(0))
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(gaps, dtype=np.uint64)


def seen_before(highs: list[np.ndarray], lows: list[np.ndarray]) -> np.ndarray:
    """Of the hashes of parts, laid end to end in the order of parts, whether an earlier part has the same."""
    high, low = np.concatenate(highs), np.concatenate(lows)
    order = np.argsort(high, kind="stable")
    h, w = high[order], low[order]
    same = h[1:] == h[:-1]
    if (same & (w[1:] != w[:-1])).any():
        order = np.lexsort((np.arange(len(high)), low, high))
        h, w = high[order], low[order]
        same = (h[1:] == h[:-1]) & (w[1:] == w[:-1])
    out = np.zeros(len(high), bool)
    out[order[1:]] = same
    return out


def remove_repeats(docs: DataFrame, n: int = 20, part_bytes: int = 8 << 20, bucket_windows: int = 1 << 20) -> DataFrame:
    """Drop the words of each document that lie in a window of ``n`` words occurring earlier.

    Returns one row for each row of ``docs`` (doc_id, text; other columns are not read): doc_id, n_words, n_removed,
    text (the kept words joined by one space). Earlier means a smaller doc_id, or an earlier start in one document.
    Windows are judged on the input. A null text has no words and becomes an empty text; a document of fewer than
    ``n`` words loses none. Rows of one doc_id are documents of their own, in the order of their texts, and of two
    equal rows one counts as the earlier; a null doc_id comes after all others. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    parts = plan_parts(docs, "id", "text", part_bytes)
    bits = max(0, parts.total // 6 // grown(bucket_windows, parts.total, 4)).bit_length()
    n_parts = max(parts.count, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parted = docs.withColumn("part", parts.part).repartition(n_parts, "part")

    def prints(key: tuple, table: pa.Table) -> pa.Table:
        p = _prints(_in_order(table), n)
        edges = _bucket_edges(p["high"], bits)
        full = np.flatnonzero(np.diff(edges))
        return pa.table({
            "bucket": pa.array(full, pa.int64()),
            "from_part": pa.array([key[0].as_py()] * len(full), pa.int32()),
            "high": pa.array([pack(p["high"][edges[b] : edges[b + 1]]) for b in full], pa.binary()),
            "low": pa.array([p["low"][edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
        })

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("from_part")
        highs = [unpack(x.as_py()) for x in table["high"]]
        seen = seen_before(highs, [np.frombuffer(x.as_py(), np.uint32) for x in table["low"]])
        cuts = np.cumsum([0, *map(len, highs)])
        return pa.table({
            "bucket": table["bucket"],
            "part": table["from_part"],
            "n": pa.array(np.diff(cuts), pa.int64()),
            "seen": pa.array([np.packbits(seen[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
        })

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        table = _in_order(left)
        p, right = _prints(table, n), right.sort_by("bucket")
        total_words = int(p["word_offsets"][-1])
        seen = [np.unpackbits(np.frombuffer(s.as_py(), np.uint8))[: k.as_py()].astype(bool) for k, s in zip(right["n"], right["seen"], strict=True)]
        again = np.empty(len(p["order"]), bool)
        if len(again):
            again[p["order"]] = np.concatenate(seen)[np.cumsum(p["new"]) - 1] | ~p["new"]
        flags = np.zeros(total_words, bool)
        flags[p["places"]] = again
        gone = tokens.covered(flags, total_words, n) if len(again) else flags
        removed, offsets = tokens.per_text(gone, p["word_offsets"]), p["word_offsets"]
        left = np.flatnonzero(~gone)
        kept = tokens.joined(p["data"], p["offsets"], p["starts"][left], p["ends"][left], np.searchsorted(offsets, left, "right"), 0x20)
        return pa.table({
            "doc_id": table["id"],
            "n_words": pa.array(np.diff(offsets), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "text": kept,
        })

    sent = parted.groupBy("part").applyInArrow(prints, "bucket long, from_part int, high binary, low binary")
    judged = sent.groupBy("bucket").applyInArrow(judge, "bucket long, part int, n long, seen binary")
    return parted.groupBy("part").cogroup(judged.groupBy("part")).applyInArrow(apply, "doc_id long, n_words long, n_removed long, text string")

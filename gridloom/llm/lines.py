"""Line dedup: lines equal or within a few edits of an earlier line go.

A segment-partition edit join. A line of length l is cut into threshold + 1 segments; a line within the threshold of it
holds one of them whole, near the same place. Each line's segments go into an index keyed by length, segment number and
hash, and each line probes the index of its own length and of up to ``max_edits`` less at the few places that can match.
Lines that meet under a key are compared by a banded bit-parallel edit distance.

Documents are dealt into parts by ranges of doc_id, and of texts where one id has more than a part, so the order of
lines is the order of parts. Equal lines are
resolved first, by hashes of 128 bits, and only the first of each goes into the join. Keys move as packed sorted rows, one for each
range of hashes and part. Pairs of lines are never sent: what moves is which lines stand under a key that two lines
share, and their texts, once for each such key. A key with more lines than ``block`` is dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import tokens
from gridloom.llm.parts import grown, plan_parts
from gridloom.llm.storage import set_aside
from gridloom.llm.substrings import _bucket_edges, pack, seen_before, unpack

CHAR_BASE = 0x8CB92BA72F3D8DD7
LONG = 1 << 14  # characters of a line from which its few segments are hashed one by one
CELLS = 1 << 23  # characters of pairs compared at once
HELD = 1 << 19  # characters whose lines' keys are made at once


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for as many characters as are held at once."""
    n = HELD + LONG + 1
    return _powers(CHAR_BASE, n), _powers(pow(CHAR_BASE, -1, 1 << 64), n)


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two long lines without what they share at either end, which leaves their distance as it is."""
    for turn in (1, -1):
        m = min(len(a), len(b))
        apart = a[::turn][:m] != b[::turn][:m]
        same = int(apart.argmax()) if apart.any() else m
        a, b = (x[same:] if turn == 1 else x[: len(x) - same] for x in (a, b))
    return a, b


def banded_distance(patterns: list[np.ndarray], texts: list[np.ndarray], limit: int) -> np.ndarray:
    """Edit distances of pairs; what is more than ``limit`` comes out as limit + 1.

    Many pairs are taken at once, as many as fit in ``CELLS`` characters or one pair.
    """
    pairs = [_trimmed(p, t) if min(len(p), len(t)) > 512 else (p, t) for p, t in zip(patterns, texts, strict=True)]
    tall = [p if len(p) >= len(t) else t for p, t in pairs]
    flat = [t if len(p) >= len(t) else p for p, t in pairs]
    n, m = (np.array([len(x) for x in side], np.int64) for side in (tall, flat))
    out = np.full(len(pairs), limit + 1, np.int64)
    near = np.flatnonzero(n - m <= limit)
    near = near[np.argsort(-m[near], kind="stable")]
    at = 0
    while at < len(near):
        some = near[at : at + max(1, CELLS // (int(m[near[at]]) + 3 * limit + 1))]
        out[some] = _distances_of([tall[k] for k in some], [flat[k] for k in some], n[some], m[some], limit)
        at += len(some)
    return out


def _distances_of(tall: list[np.ndarray], flat: list[np.ndarray], n: np.ndarray, m: np.ndarray, limit: int) -> np.ndarray:
    """The distances of pairs whose lengths n >= m differ by the limit at most; m falls.

    One machine word for each pair holds the vertical differences in a band of 2 * limit + 1 rows around the diagonal
    and slides down it by a row with every column.
    """
    width, band = 2 * limit + 1, np.uint64((1 << (2 * limit + 1)) - 1)
    rows = np.full((len(n), int(n.max()) + 2 * limit + 1), 0xFFFFFFFF, np.uint32)
    cols = np.full((len(n), int(m.max()) + 1), 0xFFFFFFFE, np.uint32)
    for i, (a, b) in enumerate(zip(tall, flat, strict=True)):
        rows[i, limit : limit + len(a)] = a
        cols[i, : len(b)] = b
    rows, cols = np.ascontiguousarray(rows.T), np.ascontiguousarray(cols.T)
    up = np.full(len(n), int(band) & ~((1 << limit) - 1), np.uint64)
    down = np.zeros(len(n), np.uint64)
    diagonal = np.zeros(len(n), np.int64)
    one = np.uint64(1)
    for j in range(int(m[0])):
        live = int(np.searchsorted(-m, -j, "left"))  # pairs with a column j; lengths fall
        match = np.zeros(live, np.uint64)
        for b in range(width):
            match |= (rows[j + b, :live] == cols[j, :live]).astype(np.uint64) << np.uint64(b)
        vp, vn = up[:live], down[:live]
        same = ((((match & vp) + vp) ^ vp) | match | vn) & band
        right, left = (vn | ~(same | vp)) & band, same & vp
        diagonal[:live] += ((same >> np.uint64(limit)) & one) == 0
        up[:live] = (left | ~((same >> one) | right)) & band
        down[:live] = (same >> one) & right
    below = ((one << (n - m).astype(np.uint64)) - one) << np.uint64(limit)
    found = diagonal + np.bitwise_count(up & below).astype(np.int64) - np.bitwise_count(down & below).astype(np.int64)
    return np.minimum(found, limit + 1)


def segments(length: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and sizes of the limit + 1 segments of lines of these lengths."""
    parts = limit + 1
    short, longer = length // parts, length % parts
    return [(k * short + np.maximum(0, k - (parts - longer)), short + (k >= parts - longer)) for k in range(parts)]


def _placed_segments(length: np.ndarray, limit: int, min_chars: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Of lines of these lengths, what they look for: number of the segment, lengths of lines that hold it, the lines concerned, starts, sizes, and whether this is their own segment."""
    for less in range(limit + 1):
        of = length - less
        for k, (p, size) in enumerate(segments(of, limit)):
            right = limit - k
            for shift in range(max(-k, less - right), min(k, less + right) + 1):
                s = p + shift
                ok = np.flatnonzero((of >= min_chars) & (size > 0) & (s >= 0) & (s + size <= length))
                yield k, of[ok], ok, s[ok], size[ok], less == 0 and shift == 0


def line_keys(chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray, limit: int, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of lines that lie in ``chars``: (key, number of the line, whether it is of the index).

    Segments of lines of ``LONG`` characters and more are hashed one by one, others by one polynomial over all
    characters; which, follows from the length of the line that the segment is of.
    """
    keys, lines, index = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    low = lengths < LONG + limit
    short = np.flatnonzero(low)
    if len(short):
        a, e = int(starts[short[0]]), int(starts[short[-1]] + lengths[short[-1]])
        power, back = (t if len(t) > e - a else _powers(int(t[1]), e - a + 1) for t in _tables())
        at = np.zeros(e - a + 1, np.uint64)
        np.cumsum((chars[a:e].astype(np.uint64) + np.uint64(1)) * power[: e - a], out=at[1:])
    for k, of, ok, s, size, own in _placed_segments(lengths, limit, min_chars):
        h = np.empty(len(ok), np.uint64)
        few = of >= LONG
        for i in np.flatnonzero(few):
            begin = int(starts[ok[i]] + s[i])
            h[i] = xxhash.xxh3_64_intdigest(np.ascontiguousarray(chars[begin : begin + int(size[i])]))
        if not few.all():
            many = np.flatnonzero(~few)
            begin = starts[ok[many]] + s[many] - a
            h[many] = tokens.mix((at[begin + size[many]] - at[begin]) * back[begin])
        keys.append(tokens.mix(h + of.astype(np.uint64) * np.uint64(tokens.BYTE_BASE) + np.uint64(k + 1)))
        lines.append(ok)
        index.append(np.full(len(ok), own))
    return np.concatenate(keys), np.concatenate(lines), np.concatenate(index)


def _in_order(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")], null_placement="at_end"))


class PartLines:
    """The lines of a part's documents, in order, and those that may be compared."""

    def __init__(self, table: pa.Table, min_chars: int, short_repeats: bool = False) -> None:
        self.data, self.offsets = tokens.column_bytes(table["text"])
        breaks = np.flatnonzero(self.data == 0x0A)
        self.starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]))
        self.ends = np.sort(np.concatenate([breaks, self.offsets[1:]]))
        real = np.array(table["text"].is_valid(), bool) if len(table) else np.zeros(0, bool)
        self.per_doc = np.diff(np.searchsorted(breaks, self.offsets)) + 1
        self.n_lines = np.where(real, self.per_doc, 0)
        lead = np.zeros(len(self.data) + 1, np.int32)  # a part has far fewer than 2**31 bytes, a text no more than that
        np.cumsum((self.data & 0xC0) != 0x80, out=lead[1:], dtype=np.int32)
        taking_part = lead[self.ends] - lead[self.starts] >= min_chars
        if short_repeats:
            np.cumsum(~tokens.SPACE[self.data], out=lead[1:], dtype=np.int32)
            taking_part |= lead[self.ends] > lead[self.starts]
        self.eligible = np.flatnonzero(taking_part)
        del lead
        starts, ends = self.starts[self.eligible], self.ends[self.eligible]
        high, low = tokens.span_prints(self.data, starts, ends)
        self.order = np.lexsort((np.arange(len(high)), low, high))
        h, w = high[self.order], low[self.order]
        self.new = np.ones(len(h), bool)
        self.new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        self.high, self.low = h[self.new], w[self.new]

    def again(self, judged: list[tuple[int, bytes]]) -> np.ndarray:
        """Of the eligible lines, those equal to an earlier one, from what each range of hashes answered."""
        out = np.empty(len(self.order), bool)
        if len(out):
            seen = np.concatenate([np.unpackbits(np.frombuffer(bits, np.uint8))[:n].astype(bool) for n, bits in judged])
            out[self.order] = seen[np.cumsum(self.new) - 1] | ~self.new
        return out

    def chars(self, line: int) -> np.ndarray:
        text = self.data[self.starts[line] : self.ends[line]].tobytes().decode("utf-8", "replace")
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _first_hits(later: np.ndarray, earlier: np.ndarray, grams: list[np.ndarray], counts: np.ndarray, limit: int) -> np.ndarray:
    """Of pairs of lines, the later ones that are within the limit of an earlier one. Each later line tries its candidates in order and stops at the first that is near; all lines try at once."""
    keep = np.empty(len(later), bool)
    for k in range(0, len(later), 1 << 16):  # an edit changes at most two of the counts of characters
        part = slice(k, k + (1 << 16))
        keep[part] = np.abs(counts[later[part]] - counts[earlier[part]]).sum(1) <= 2 * limit
    pairs = np.unique((later[keep].astype(np.int64) << 32) | earlier[keep])
    i, j = pairs >> 32, pairs & 0xFFFFFFFF
    settled = np.zeros(len(grams), bool)
    while len(i):
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))[:4096]
        near = banded_distance([grams[a] for a in i[first]], [grams[b] for b in j[first]], limit) <= limit
        settled[i[first[near]]] = True
        left = ~settled[i]
        left[first] = False
        i, j = i[left], j[left]
    return np.flatnonzero(settled)


def _meetings(at: int, n: int, refs: np.ndarray, index: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (later, earlier) of the lines under one key of which the later is number ``at`` or one of those after, up to ``n``: one of the two stands in the index, and of two sides they stand on different ones."""
    rows = np.arange(at, n)
    meet = (np.arange(n)[None, :] < rows[:, None]) & (refs[None, :n] != refs[at:n, None])
    meet &= index[None, :n] | index[at:n, None]
    if side.any():
        meet &= side[None, :n] != side[at:n, None]
    i, j = np.nonzero(meet)
    return rows[i], j


def near_earlier(keys: np.ndarray, refs: np.ndarray, texts: list[bytes], index: np.ndarray, side: np.ndarray, limit: int) -> np.ndarray:
    """The lines (refs) that are within the limit of an earlier line under one of the keys; rows are sorted by key and line."""
    lines, line = np.unique(refs, return_index=True)
    grams = [np.frombuffer(texts[k].decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32) for k in line]
    counts = np.array([np.bincount(g & 31, minlength=32) for g in grams], np.int32).reshape(-1, 32)
    number = np.searchsorted(lines, refs)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    ends = np.append(starts[1:], len(keys))
    later, earlier, hits = [], [], []
    two = (ends - starts == 2) & (refs[starts] != refs[np.minimum(starts + 1, len(refs) - 1)])
    two &= index[starts] | index[np.minimum(starts + 1, len(refs) - 1)]
    two &= ~side[starts].astype(bool) & ~side[np.minimum(starts + 1, len(refs) - 1)].astype(bool)
    later.append(number[starts[two] + 1])
    earlier.append(number[starts[two]])
    for a, e in zip(starts[ends - starts != 2], ends[ends - starts != 2], strict=True):
        own, step = slice(a, e), max(1, (1 << 19) // (e - a))
        order = np.argsort(refs[own], kind="stable")
        r, x, s, names = refs[own][order], index[own][order], side[own][order], number[own][order]
        for at in range(0, e - a, step):
            i, j = _meetings(at, min(e - a, at + step), r, x, s)
            if e - a > 256:
                hits.append(_first_hits(names[i], names[j], grams, counts, limit))
            else:
                later.append(names[i])
                earlier.append(names[j])
    for a in np.flatnonzero((ends - starts == 2) & ~two):
        k = slice(starts[a], ends[a])
        if side[k].any() and side[k][0] != side[k][1] and index[k].any() and refs[k][0] != refs[k][1]:
            both = np.sort(number[k])
            later.append(both[1:])
            earlier.append(both[:1])
    hits.append(_first_hits(np.concatenate(later), np.concatenate(earlier), grams, counts, limit))
    return lines[np.unique(np.concatenate(hits))]


def dedup_lines(docs: DataFrame, max_edits: int = 2, min_chars: int = 20, short_repeats: bool = False, part_bytes: int = 8 << 20, bucket_keys: int = 1 << 21, block: int = 2048) -> DataFrame:
    """Drop the lines of ``docs`` (doc_id, text and any other columns) that are near an earlier line.

    Lines are what newlines part, and are compared if they have ``min_chars`` characters or more; shorter ones stay, or with
    ``short_repeats`` go where they hold a word and equal an earlier line. Two lines of no more than ``max_edits``
    characters are near only if they are equal. Any other
    line goes if a line of the corpus before it (smaller doc_id, or earlier in one text) is within ``max_edits`` edits
    of it, whether that one stays or not. Returns all columns, with text made of the lines that stay, and n_lines,
    n_removed. Input columns of these names become n_lines_in and n_removed_in (or with more of _in, where that is taken). A null text stays null, with no lines;
    an empty one is one empty line. Rows of one doc_id follow each other in the order of their texts; of equal rows one
    counts as the earlier; a null doc_id comes after all others. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = set_aside(docs, "n_lines", "n_removed")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    keyed = docs.withColumn("__line_id", F.col("doc_id").cast("long"))
    parts = plan_parts(keyed, "__line_id", "text", part_bytes)
    keys_each = grown(bucket_keys, parts.total, 4)
    line_bits = max(0, parts.total // 100 // keys_each).bit_length()
    key_bits = max(0, parts.total // 20 // keys_each).bit_length()
    n_parts = max(parts.count, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parted = keyed.withColumn("__line_part", parts.part).drop("__line_id").repartition(n_parts, "__line_part")

    def equal_lines(key: tuple, table: pa.Table) -> pa.Table:
        lines = PartLines(_in_order(table), min_chars, short_repeats)
        edges = _bucket_edges(lines.high, line_bits)
        full = np.flatnonzero(np.diff(edges))
        return pa.table({
            "bucket": pa.array(full, pa.int64()),
            "from_part": pa.array([key[0].as_py()] * len(full), pa.int32()),
            "high": pa.array([pack(lines.high[edges[b] : edges[b + 1]]) for b in full], pa.binary()),
            "low": pa.array([lines.low[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
        })

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("from_part")
        highs = [unpack(x.as_py()) for x in table["high"]]
        seen = seen_before(highs, [np.frombuffer(x.as_py(), np.uint64) for x in table["low"]])
        cuts = np.cumsum([0, *map(len, highs)])
        bits = [np.packbits(seen[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"part": table["from_part"], "bucket": table["bucket"], "n": pa.array(np.diff(cuts), pa.int64()), "bits": pa.array(bits, pa.binary())})

    def split_answers(right: pa.Table) -> tuple[list[tuple[int, bytes]], np.ndarray]:
        """The ranges' answers, in order, and the lines named (bucket -1)."""
        rows = sorted(zip(right["bucket"].to_pylist(), right["n"].to_pylist(), right["bits"].to_pylist(), strict=True), key=lambda r: r[:2])
        return [(n, bits) for b, n, bits in rows if b >= 0], np.array([n for b, n, _ in rows if b < 0], np.int64)

    def send_keys(left: pa.Table, right: pa.Table) -> pa.Table:
        lines = PartLines(_in_order(left), min_chars, short_repeats)
        judged, _ = split_answers(right)
        firsts = lines.eligible[~lines.again(judged)]
        keys, refs, index, held, size = [], [], [], [], 0

        def flush(upto: int) -> None:
            lengths = np.array([len(x) for x in held])
            got, local, own = line_keys(np.concatenate(held), np.cumsum(lengths) - lengths, lengths, max_edits, min_chars)
            keys.append(got)
            refs.append(firsts[upto - len(held) + local])
            index.append(own)
            held.clear()

        for k, line in enumerate(firsts):
            chars = lines.chars(line)
            if held and (size + len(chars) > HELD or len(chars) >= LONG):
                flush(k)
                size = 0
            held.append(chars)
            size += len(chars)
        if held:
            flush(len(firsts))
        if not keys:
            return pa.table({"bucket": pa.array([], pa.int64()), "from_part": pa.array([], pa.int32()), "high": pa.array([], pa.binary()), "low": pa.array([], pa.binary())})
        high = np.concatenate(keys)
        low = (np.concatenate(refs).astype(np.uint32) << np.uint32(1)) | np.concatenate(index).astype(np.uint32)
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        edges = _bucket_edges(high, key_bits)
        full = np.flatnonzero(np.diff(edges))
        part = left["__line_part"][0].as_py()
        return pa.table({
            "bucket": pa.array(full, pa.int64()),
            "from_part": pa.array([part] * len(full), pa.int32()),
            "high": pa.array([pack(high[edges[b] : edges[b + 1]]) for b in full], pa.binary()),
            "low": pa.array([low[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
        })

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("from_part")
        highs = [unpack(x.as_py()) for x in table["high"]]
        high = np.concatenate(highs)
        low = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table["low"]])
        part = np.repeat(np.array(table["from_part"].to_pylist(), np.int64), [len(x) for x in highs])
        ref, index = (part << 32) | (low >> np.uint32(1)).astype(np.int64), (low & 1).astype(bool)
        order = np.lexsort((ref, high))
        high, ref, index = high[order], ref[order], index[order]
        starts = np.flatnonzero(np.append(True, high[1:] != high[:-1])) if len(high) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(high)) if len(starts) else starts
        shared = (np.add.reduceat(index.astype(np.int64), starts) > 0) & (ref[ends - 1] != ref[starts]) if len(starts) else np.zeros(0, bool)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for a, e in zip(starts[shared], ends[shared], strict=True):
            if e - a <= block:
                groups = [(high[a], slice(a, e), 0)]
            else:
                cuts = [*range(a, e, block), e]
                spans = [slice(x, y) for x, y in zip(cuts, cuts[1:], strict=False)]
                groups = []
                for x in range(len(spans)):
                    for y in range(x, len(spans)):
                        name = tokens.mix(high[a : a + 1] + np.uint64(x * 0x10001 + y + 1))[0]
                        groups += [(name, spans[x], 0)] + ([(name, spans[y], 1)] if y > x else [])
            for name, span, side in groups:
                out[0].append(np.full(span.stop - span.start, name))
                out[1].append(ref[span])
                out[2].append(index[span])
                out[3].append(np.full(span.stop - span.start, side, np.int32))
        none = np.zeros(0)
        whole = [np.concatenate(x) if x else none for x in out]
        return pa.table({"grp": pa.array(whole[0].astype(np.uint64).view(np.int64)), "ref": pa.array(whole[1].astype(np.int64)), "own": pa.array(whole[2].astype(bool)), "side": pa.array(whole[3].astype(np.int32))})

    def send_texts(left: pa.Table, right: pa.Table) -> pa.Table:
        part = left["__line_part"][0].as_py() if len(left) else 0
        _, wanted = split_answers(right)
        if not len(wanted):
            return pa.table({"ref": pa.array([], pa.int64()), "line": pa.array([], pa.binary())})
        lines = PartLines(_in_order(left), min_chars, short_repeats)
        return pa.table({"ref": pa.array((part << 32) | wanted, pa.int64()), "line": pa.array([lines.data[lines.starts[k] : lines.ends[k]].tobytes() for k in wanted], pa.binary())})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def near(held: pa.Table) -> pa.RecordBatch:
            found = np.zeros(0, np.int64)
            if len(held):
                keys, refs, index, side = (held[c].to_numpy() for c in ("grp", "ref", "own", "side"))
                found = near_earlier(keys, refs, held["line"].to_pylist(), index, side, max_edits)
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["ref"])

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = held["grp"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on
            if cut:
                yield near(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield near(held)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        table = _in_order(left) if len(left) else left
        lines = PartLines(table, min_chars, short_repeats)
        judged, near = split_answers(right)
        gone = np.zeros(len(lines.starts), bool)
        gone[lines.eligible] = lines.again(judged)
        gone[near] = True
        cuts = np.append(0, np.cumsum(lines.per_doc))
        removed = tokens.per_text(gone, cuts)
        left = np.flatnonzero(~gone)
        texts = tokens.joined(lines.data, lines.offsets, lines.starts[left], lines.ends[left], np.searchsorted(cuts, left, "right"), 0x0A)
        texts = pc.if_else(table["text"].is_valid(), texts, pa.scalar(None, pa.string()))
        table = table.drop_columns(["__line_part"])
        table = table.set_column(table.schema.get_field_index("text"), "text", texts)
        return table.append_column("n_lines", pa.array(lines.n_lines, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))

    packed, answers = "bucket long, from_part int, high binary, low binary", "part int, bucket long, n long, bits binary"
    by_part = parted.groupBy("__line_part")  # one shuffle of the texts serves all passes
    judged = by_part.applyInArrow(equal_lines, packed).groupBy("bucket").applyInArrow(judge, answers)
    keys = by_part.cogroup(judged.groupBy("part")).applyInArrow(send_keys, packed)
    members = keys.groupBy("bucket").applyInArrow(meet, "grp long, ref long, own boolean, side int")

    def named(refs: DataFrame) -> DataFrame:
        return refs.distinct().select(F.shiftright("ref", 32).cast("int").alias("part"), F.lit(-1).cast("long").alias("bucket"), F.col("ref").bitwiseAND(0xFFFFFFFF).alias("n"), F.lit(None).cast("binary").alias("bits"))

    texts = by_part.cogroup(named(members.select("ref")).groupBy("part")).applyInArrow(send_texts, "ref long, line binary")
    met = members.join(texts, "ref").repartition("grp").sortWithinPartitions("grp", "ref", "own").select("grp", "ref", "line", "own", "side")
    near = met.mapInArrow(compare, "ref long")
    verdicts = judged.unionByName(named(near))
    return by_part.cogroup(verdicts.groupBy("part")).applyInArrow(apply, schema)

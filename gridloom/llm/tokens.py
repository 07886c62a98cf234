"""Words and rolling hashes of whole Arrow columns, without a Python object for each word.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; those bytes never occur inside a UTF-8
sequence, so words of bytes are words of characters. Spans of bytes have hashes of 128 bits (XXH3), of which each
distinct span of a batch is hashed once; windows have Rabin-Karp polynomials over the words' hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
SEGMENT = 1 << 20  # bytes hashed at a time, or one span


def column_bytes(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 offsets into them; a null is an empty text."""
    chunks = col.chunks if isinstance(col, pa.ChunkedArray) else [col]
    data, offsets, at = [], [np.zeros(1, np.int64)], 0
    for c in chunks:
        if not len(c):
            continue
        c = c.fill_null("" if not pa.types.is_binary(c.type) else b"") if c.null_count else c
        big = pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type)
        _, off, buf = c.buffers()
        o = np.frombuffer(off, np.int64 if big else np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
        if buf is not None and o[-1] > o[0]:
            data.append(np.frombuffer(buf, np.uint8)[o[0] : o[-1]])
        offsets.append(o[1:] - o[0] + at)
        at += int(o[-1] - o[0])
    return (data[0] if len(data) == 1 else np.concatenate(data) if data else np.zeros(0, np.uint8)), np.concatenate(offsets)


def joined(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, text_of: np.ndarray, separator: int) -> pa.Array:
    """The chosen spans of each text with one separator byte between them. A byte follows every span but a text's last."""
    between = np.zeros(len(starts), bool)
    between[:-1] = text_of[1:] == text_of[:-1]
    change = np.zeros(len(data) + 2, np.int8)
    full = ends + between > starts
    change[starts[full]] += 1
    change[(ends + between)[full]] -= 1
    keep = np.cumsum(change[: len(data)], dtype=np.int8).view(bool)
    sizes = per_text(keep, offsets)
    out = data[keep]
    lengths = ends - starts + between
    out[np.cumsum(lengths)[between] - 1] = separator
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(out))]).cast(pa.string())


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans_as_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of bytes as an Arrow array; they are in order and may not overlap."""
    full = ends > starts
    change = np.zeros(len(data) + 1, np.int8)
    change[starts[full]] += 1
    change[ends[full]] -= 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    inside = np.cumsum(change[:-1], dtype=np.int8).view(bool)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])


def span_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every span of bytes: the halves of its XXH3 of 128 bits. Spans are in order and may not overlap."""
    out = np.empty((len(starts), 2), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + SEGMENT, "right")))
        found = spans_as_array(data[lo : int(ends[j - 1])], starts[i:j] - lo, ends[i:j] - lo).dictionary_encode()
        distinct, at = column_bytes(found.dictionary)
        whole, at, digest = memoryview(distinct), at.tolist(), xxhash.xxh3_128_digest
        prints = np.frombuffer(b"".join([digest(whole[a:b]) for a, b in zip(at, at[1:], strict=False)]), ">u8").reshape(-1, 2).astype(np.uint64)
        out[i:j] = prints[found.indices.to_numpy()]
        i = j
    return out[:, 0], out[:, 1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first of the hashes of ``span_prints``."""
    return span_prints(data, starts, ends)[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 offsets of each text's words among them."""
    w = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    found = w.copy()
    found[1:] &= ~w[:-1] | edge[1:-1]
    starts = np.flatnonzero(found)
    found[:] = w
    found[:-1] &= ~w[1:] | edge[1:-1]
    ends = np.flatnonzero(found) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def window_hashes(h: np.ndarray, n: int, base: int = WORD_BASE) -> np.ndarray:
    """The Rabin-Karp hash, mixed, of every n consecutive word hashes: len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(base)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def whole_windows(word_offsets: np.ndarray, n: int) -> np.ndarray:
    """Of the windows of n words over all texts' words, whether each lies in one text."""
    total = int(word_offsets[-1])
    ok = np.ones(max(0, total - n + 1), bool)
    cut = np.zeros(len(ok) + 1, np.int64)
    edges = word_offsets[1:-1]
    np.add.at(cut, np.clip(edges - n + 1, 0, len(ok)), 1)
    np.add.at(cut, np.clip(edges, 0, len(ok)), -1)
    return ok & (np.cumsum(cut[:-1]) == 0)


def covered(flags: np.ndarray, total: int, n: int) -> np.ndarray:
    """Words that a flagged window of n words covers."""
    change = np.zeros(total + 1, np.int32)
    at = np.flatnonzero(flags)
    change[at] += 1
    change[at + n] -= 1
    return np.cumsum(change[:-1]) > 0


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    at = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=at[1:])
    return at[offsets[1:]] - at[offsets[:-1]]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 21) -> list[pa.RecordBatch]:
    """A batch cut between rows so that each piece has ``most`` bytes of text or one row; an empty batch stays one piece."""
    lengths = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + most, "right"))
        upto = max(upto, at + 1)
        out.append(batch.slice(at, upto - at))
        at = upto
    return out or [batch]

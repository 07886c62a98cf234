"""Canonical Huffman codes of bounded length, and streams of them with a checkpoint every few ids.

A code is its lengths alone: words are numbered by length, then by id. A stream is cut into runs of ``RUN`` ids, and the
bit at which each run begins is a checkpoint, so that all runs of many streams are decoded at once, a step an id, by one
look into a table of all prefixes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

RUN = 128  # ids between two checkpoints
LONGEST = 18  # bits of a code word, more only where the ids are too many
WINDOW = 24  # bits that one look can take


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """The lengths of an optimal prefix code, none over ``longest``, of symbols with these counts (package-merge); a symbol never seen has length 0."""
    lengths = np.zeros(len(counts), np.uint8)
    seen = np.flatnonzero(counts)
    if len(seen) < 2:
        lengths[seen] = 1
        return lengths
    longest = max(longest, int(len(seen) - 1).bit_length())
    if longest > WINDOW:
        raise ValueError(f"{len(seen)} symbols need code words of more than {WINDOW} bits")
    order = seen[np.argsort(counts[seen], kind="stable")]
    single = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(longest):
        merged = np.concatenate([single, packages])
        at = np.argsort(merged, kind="stable")
        levels.append(at < len(single))
        merged = merged[at]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    taken = 2 * len(single) - 2
    for is_single in reversed(levels):
        singles = int(is_single[:taken].sum())
        lengths[order[:singles]] += 1
        taken = 2 * (taken - singles)
    return lengths


@dataclass
class Code:
    """Code words and the table that reads them: a prefix of ``width`` bits gives id * 32 + length."""

    lengths: np.ndarray
    words: np.ndarray
    table: np.ndarray
    width: int

    @classmethod
    def of(cls, lengths: np.ndarray) -> Code:
        width = max(1, int(lengths.max(initial=1)))
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        span = np.int64(1) << (width - lengths[order].astype(np.int64))
        first = np.cumsum(span) - span
        words = np.zeros(len(lengths), np.int64)
        words[order] = first >> (width - lengths[order].astype(np.int64))
        table = np.zeros(1 << width, np.uint32)
        filled = np.repeat((order << 5 | lengths[order]).astype(np.uint32), span)
        table[: len(filled)] = filled
        return cls(lengths.astype(np.int64), words, table, width)


def encode(ids: np.ndarray, code: Code) -> tuple[bytes, np.ndarray]:
    """The bits of a stream of ids, and the bit at which each of its runs begins."""
    size = code.lengths[ids]
    if len(ids) and not size.all():
        raise ValueError("an id has no code word")
    end = np.cumsum(size)
    begin = end - size
    at = begin >> 5
    room = 64 - (begin & 31) - size  # within two words of 32 bits
    shifted = code.words[ids] << room
    n_words = (int(end[-1]) + 31) // 32 if len(ids) else 0
    out = np.zeros(n_words + 1, np.int64)
    if len(ids):
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))  # code words are shorter than 32 bits: each word has one that begins in it
        out[at[first]] = np.add.reduceat(shifted.view(np.uint64) >> np.uint64(32), first).astype(np.int64)
        out[at[first] + 1] += np.add.reduceat(shifted & 0xFFFFFFFF, first)
    return out[:n_words].astype(">u4").tobytes()[: (int(end[-1]) + 7) // 8 if len(ids) else 0], begin[::RUN]


def decode(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, code: Code) -> np.ndarray:
    """The ids of runs that begin at these bits of ``data``, end to end; ``sizes`` says how many each has."""
    out = np.empty(int(sizes.sum()), np.uint32)
    if not len(out):
        return out
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    place = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    bit, place, size = begins[order].astype(np.int64), place[order], sizes[order]
    active = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # runs longer than k
    drop = np.uint32(32 - code.width)
    for k, n in enumerate(active):
        b = bit[:n]
        found = code.table[(window[b >> 3] << (b & 7).astype(np.uint32)) >> drop]
        out[place[:n] + k] = found >> 5
        b += found & 31
    return out

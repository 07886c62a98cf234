"""Byte-level BPE ids of whole texts, each distinct span encoded once.

The library parts a text into pieces before it merges bytes. No piece holds a character that is not white space before
one that is, nor an ASCII letter before an ASCII digit or sign; a text cut there gives the same ids as the whole one.
Spans between such cuts repeat, so the library is asked for each distinct one of a batch alone, and a worker keeps the
ids of a bounded number of them for its next batches.
"""

from __future__ import annotations

import array
import functools
import os

import numpy as np
import pyarrow as pa

from gridloom.llm import tokens

# First bytes of UTF-8 sequences among which white space beyond ASCII is found. A text is not cut after a character of theirs.
WIDE_SPACES = [0xC285, 0xC2A0, 0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380]
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
SIGN = np.zeros(256, bool)  # digits and signs, without the bar, which stands after a letter in the string of a special token
SIGN[[c for c in range(0x21, 0x7F) if not LETTER[c] and c != 0x7C]] = True
KEPT = 800_000  # spans whose ids a worker keeps
KEPT_BYTES = 64  # longer ones are not kept


class Spans:
    """Ids of the spans of one tokenizer seen so far in this worker."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # texts are encoded on the task's own thread
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def ids(self, spans: list[bytes]) -> list[bytes]:
        """The ids of each span as the bytes of 32-bit integers."""
        found = [self.known.get(s) for s in spans]
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i, e in zip(missing, self.library.encode_batch_fast([spans[i].decode("utf-8", "replace") for i in missing], add_special_tokens=False), strict=True):
            found[i] = array.array("I", e.ids).tobytes()
        for i in missing[: max(0, KEPT - len(self.known))]:
            if len(spans[i]) <= KEPT_BYTES:
                self.known[spans[i]] = found[i]
        return found


@functools.cache
def load(path: str, special_as_text: bool = False) -> Spans:
    """The spans of a tokenizer's file, once for each Python worker."""
    spans = Spans(path)
    spans.library.encode_special_tokens = special_as_text
    return spans


def forget() -> None:
    """Lets go of the tokenizers and spans that this worker has from an earlier stage, and of memory that Arrow holds unused."""
    load.cache_clear()
    pa.default_memory_pool().release_unused()


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where spans begin: at every text, at white space after a character that is surely none, and at a digit or sign after a letter."""
    begins = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        before, after = data[:-1], data[1:]
        begins[1:-1] = tokens.SPACE[after] & (before > 0x20) & (before != 0x7F)
        wide = np.flatnonzero(begins[1:-1] & (before > 0x7F)) + 1
        one, two, three = (data[np.maximum(wide - k, 0)].astype(np.int32) for k in (1, 2, 3))
        begins[wide[np.isin(two << 8 | one, WIDE_SPACES) | np.isin(three << 8 | two, WIDE_SPACES)]] = False
        begins[1:-1] |= SIGN[after] & LETTER[before]
    begins[offsets] = True
    begins[len(data)] = False
    return np.flatnonzero(begins)


def encode(column: pa.Array, path: str, special_as_text: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a string column's texts, end to end, and each text's n + 1 offsets among them; a null is an empty text.

    ``special_as_text`` takes the strings of special tokens as ordinary text; otherwise, as the library does unless told,
    they are their tokens. A text without any cut goes to the library whole.
    """
    data, offsets = tokens.column_bytes(column)
    starts = cuts(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    bounds = pa.array(np.append(starts, len(data)))
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds.buffers()[1], pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    found = load(path, special_as_text).ids(spans.dictionary.to_pylist())
    counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat = np.frombuffer(b"".join(found), np.uint32)
    places = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts))), pa.array(flat))
    at = spans.indices
    per_span = np.append(0, np.cumsum(counts[at.to_numpy()]))
    return places.take(at).flatten().to_numpy(), per_span[np.searchsorted(starts, offsets)]

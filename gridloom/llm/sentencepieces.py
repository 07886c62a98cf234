"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

A piece sequence is the model's BPE result exactly if every two neighbours stand side by side when the two alone are
merged. So the result is the one path through the text's pieces in which all neighbours fit, where a step weighs 0 if
they fit and minus infinity if not. A giant document is cut into chunks at fixed places. The state at a cut is the piece
that covers the character before it. Each chunk, on its own, yields the matrix of weights from the states at its left
cut to those at its right cut; matrices combine by (max, +) products, which are associative, in a tree; going down the
tree fixes the state at every cut, and each chunk is then traced back by itself. Between the first and the last word
start of a chunk no piece spans two words, so that the matrix needs the chunk's ends only and the library's own encoder
gives what lies between. A document of one chunk has no cut, and is encoded whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import tokens
from gridloom.llm.storage import stage

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"  # stands for a space
State = tuple[int, int]  # start and end of a piece, counted from a cut


class Pieces:
    """A BPE model with byte fallback, no added symbols, and a mark before the text."""

    def __init__(self, model: bytes) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.library.get_piece_size())
        plain = [i for i in ids if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.rank = {self.library.id_to_piece(i): self.library.get_score(i) for i in plain}
        self.id = {self.library.id_to_piece(i): i for i in plain}
        self.longest = max(map(len, self.rank))
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.whole_words = not any(MARK in p.lstrip(MARK) for p in self.rank)
        self.first_mark = self.id["a"]
        self.fits = lru_cache(maxsize=1 << 16)(self._fits)
        self.reachable = lru_cache(maxsize=1 << 15)(lambda p: self.merge(p) == [p])

    def merge(self, text: str) -> list[str]:
        """BPE by definition: the best pair of neighbours, the leftmost of equals, again and again."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.rank.get(parts[i] + parts[i + 1], -np.inf), -i))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        return self.merge(left + right) == [left, right]

    def pieces_at(self, text: str, at: int) -> Iterator[int]:
        """Ends of the pieces that start at a place; a character outside the vocabulary is a piece of its own."""
        yield at + 1
        for end in range(at + 2, min(len(text), at + self.longest) + 1):
            if text[at:end] in self.rank and self.reachable(text[at:end]):
                yield end

    def begins_word(self, text: str, at: int) -> bool:
        """Whether no piece can span the place, because a word starts there after another."""
        return self.whole_words and 0 < at < len(text) and text[at] == MARK and text[at - 1] != MARK

    def states(self, text: str, cut: int) -> list[State | None]:
        """The states at a cut: pieces that cover the character before it, by start and end from the cut.

        One state, None, at a document's start or end or where a word starts: which piece ends there is of no matter.
        """
        if cut in (0, len(text)) or self.begins_word(text, cut):
            return [None]
        return [(s - cut, e - cut) for s in range(max(0, cut - self.longest), cut) for e in self.pieces_at(text, s) if e >= cut]

    def walk(self, text: str, before: str | None, at: int, stop: int) -> dict[tuple[int, int], tuple[int, int] | None]:
        """All pieces on paths of fitting neighbours from a place, after the piece ``before``, each with the one before it, as far as ``stop`` is not passed by a start."""
        found: dict[tuple[int, int], tuple[int, int] | None] = {}
        ending: dict[int, list[tuple[int, int] | None]] = {at: [None]}
        for p in range(at, stop):
            for last in ending.pop(p, ()):
                left = before if last is None else text[last[0] : last[1]]
                for end in self.pieces_at(text, p):
                    if left is None or self.fits(left, text[p:end]):
                        found.setdefault((p, end), last)
                        ending.setdefault(end, []).append((p, end))
        return found

    def ids_of(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            out += [self.id[p]] if p in self.id else [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def encode(self, text: str) -> list[int]:
        """The library's ids for a whole text."""
        return self.library.encode(text, num_threads=1) if text else []

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids, of which ``first`` says whether they begin a document (and so with a mark that no text has)."""
        shown = self.library.decode([self.first_mark, *ids], num_threads=1)[1:]
        return shown[1:] if first and ids else shown


@lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    return Pieces(model)


def marked(text: str) -> str:
    """The text as the model sees it."""
    return MARK + text.replace(" ", MARK) if text else ""


def _place(state: State | None, cut: int, text: str) -> tuple[int, str | None]:
    """Where the next piece starts after a state at a cut, and the piece before it."""
    return (cut, None) if state is None else (state[1] + cut, text[state[0] + cut : state[1] + cut])


def _inner_words(m: Pieces, window: str, lo: int, hi: int) -> tuple[int, int] | None:
    """The first and the last place between lo and hi where a word starts after another."""
    first = next((p for p in range(lo + 1, hi) if m.begins_word(window, p)), None)
    return None if first is None else (first, next(p for p in range(hi - 1, first - 1, -1) if m.begins_word(window, p)))


def _last(walked: dict, state: State | None, cut: int) -> tuple[int, int] | None:
    """The piece of a walk that makes the state at a cut."""
    if state is None:
        return next((x for x in walked if x[1] == cut), None)
    x = (state[0] + cut, state[1] + cut)
    return x if x in walked else None


def transfer(m: Pieces, window: str, lo: int, hi: int) -> np.ndarray:
    """The max-plus matrix from the states at lo to those at hi; the chunk is window[lo:hi]."""
    left, right = m.states(window, lo), m.states(window, hi)
    weight = lambda ok: np.where(ok, 0.0, -np.inf)
    inner = _inner_words(m, window, lo, hi)
    if inner is None:
        out = np.zeros((len(left), len(right)), bool)
        for i, s in enumerate(left):
            at, before = _place(s, lo, window)
            walked = m.walk(window, before, at, hi)
            out[i] = [(r is None and at == hi) or _last(walked, r, hi) is not None for r in right]
        return weight(out)
    head = []
    for s in left:
        at, before = _place(s, lo, window)
        head.append(at == inner[0] or _last(m.walk(window, before, at, inner[0]), None, inner[0]) is not None)
    walked = m.walk(window, None, inner[1], hi)
    tail = [_last(walked, r, hi) is not None for r in right]
    return weight(np.array(head))[:, None] + weight(np.array(tail))[None, :]


def _trace(m: Pieces, window: str, before: str | None, at: int, state: State | None, cut: int) -> list[str]:
    walked = m.walk(window, before, at, cut)
    x, out = _last(walked, state, cut), []
    while x is not None:
        out.append(window[x[0] : x[1]])
        x = walked[x]
    return out[::-1]


def backtrace(m: Pieces, window: str, lo: int, hi: int, left: State | None, right: State | None) -> list[int]:
    """The ids of a chunk's pieces, those that start in it, between the states chosen at its cuts."""
    at, before = _place(left, lo, window)
    inner = _inner_words(m, window, lo, hi)
    if inner is None:
        return m.ids_of(_trace(m, window, before, at, right, hi)) if at < hi else []
    head = _trace(m, window, before, at, None, inner[0]) if at < inner[0] else []
    middle = m.encode(window[inner[0] + 1 : inner[1]]) if inner[1] > inner[0] else []
    return m.ids_of(head) + middle + m.ids_of(_trace(m, window, None, inner[1], right, hi))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product of two matrices."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def choose_states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """The states at each chunk's cuts on the best path through all of them: a tree of products up, choices down."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([combine(now[i], now[i + 1]) if i + 1 < len(now) else now[i] for i in range(0, len(now), 2)])
    if levels[-1][0].max() == -np.inf:
        raise ValueError("no path through the chunks")
    i, j = np.unravel_index(int(levels[-1][0].argmax()), levels[-1][0].shape)
    chosen = [(int(i), int(j))]
    for below in reversed(levels[:-1]):
        finer = []
        for k, (i, j) in enumerate(chosen):
            if 2 * k + 1 < len(below):
                mid = int((below[2 * k][i, :] + below[2 * k + 1][:, j]).argmax())
                finer += [(i, mid), (mid, j)]
            else:
                finer.append((i, j))
        chosen = finer
    return chosen


def cut_points(n: int, chunk: int) -> list[tuple[int, int]]:
    return [(a, min(n, a + chunk)) for a in range(0, max(n, 1), chunk)]


def encode_in_chunks(m: Pieces, text: str, chunk: int) -> list[int]:
    """What the tasks of ``encode_documents`` do with one document, in one place."""
    whole = marked(text)
    windows = [(whole[max(0, a - m.longest) : b + m.longest], a - max(0, a - m.longest), b - max(0, a - m.longest)) for a, b in cut_points(len(whole), chunk)]
    chosen = choose_states([transfer(m, *w) for w in windows])
    return [x for w, (i, j) in zip(windows, chosen, strict=True) for x in backtrace(m, *w, m.states(w[0], w[1])[i], m.states(w[0], w[2])[j])]


def _load(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())  # a model file, half a megabyte


def encode_documents(docs: DataFrame, model: str = MODEL, chunk: int = 1 << 14) -> DataFrame:
    """SentencePiece ids of every row of ``docs`` (doc_id, text; other columns are not read).

    Returns doc_id, n_tokens, n_chunks, token_ids, round_trip: whether decoding the ids gives the text again, which
    fails for texts that hold the model's own mark for a space. Documents of ``chunk`` characters or more go through the
    scan. A null or empty text has no ids. Rows are numbered as they are cut, so repeated rows and null doc_ids keep a
    row each. An empty table gives an empty table. ``model`` is a path that the driver reads.
    """
    if chunk < 64:
        raise ValueError("a chunk must be longer than any piece")
    shared = _load(docs, model)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = "doc_id long, n_tokens long, n_chunks long, token_ids array<int>, round_trip boolean"
    names = ["doc_id", "n_tokens", "n_chunks", "token_ids", "round_trip"]
    ids_type = pa.list_(pa.int32())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(shared.value)
        for batch in (piece for b in batches for piece in tokens.slices(b, most=1 << 20)):
            texts = batch.column("text").to_pylist()
            ids = [m.encode(t) for t in texts]
            same = [m.decode(i) == t for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array([1] * len(ids), pa.int64()), pa.array(ids, ids_type), pa.array(same, pa.bool_())], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = pieces(shared.value).longest
        for batch in batches:
            for doc, row, text in zip(*(batch.column(c) for c in ("doc_id", "row", "text")), strict=True):
                plain = MARK not in text.as_py()
                text = marked(text.as_py())
                cuts = cut_points(len(text), chunk)
                for at in range(0, len(cuts), 64):
                    some = [(k, max(0, a - longest), a, b) for k, (a, b) in enumerate(cuts[at : at + 64], at)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([doc.as_py()] * len(some), pa.int64()), pa.array([row.as_py()] * len(some), pa.int64()), pa.array([k for k, *_ in some], pa.int64()),
                        pa.array([a - w for _, w, a, _ in some], pa.int32()), pa.array([b - w for _, w, _, b in some], pa.int32()), pa.array([text[w : b + longest] for _, w, _, b in some]), pa.array([plain] * len(some)),
                    ], names=["doc_id", "row", "k", "lo", "hi", "window", "plain"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(shared.value)
        for batch in batches:
            found = [transfer(m, w.as_py(), lo.as_py(), hi.as_py()) for w, lo, hi in zip(*(batch.column(c) for c in ("window", "lo", "hi")), strict=True)]
            packed = [json.dumps([list(x.shape), np.packbits(x == 0).tobytes().hex()]) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(packed, pa.string())], names=["row", "k", "matrix"])

    def resolve(key: tuple, table: pa.Table) -> pa.Table:
        # a document's matrices: some hundred bytes for each chunk, and a text has 2 GB at most
        table = table.sort_by("k")
        read = []
        for x in table["matrix"].to_pylist():
            (rows, cols), bits = json.loads(x)
            read.append(np.where(np.unpackbits(np.frombuffer(bytes.fromhex(bits), np.uint8))[: rows * cols].reshape(rows, cols) == 1, 0.0, -np.inf))
        chosen = choose_states(read)
        return pa.table({"row": table["row"], "k": table["k"], "from_state": pa.array([i for i, _ in chosen], pa.int32()), "to_state": pa.array([j for _, j in chosen], pa.int32())})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(shared.value)
        for batch in (piece for b in batches for piece in tokens.slices(b, "window", 1 << 20)):
            ids, same = [], []
            for w, lo, hi, i, j, plain in zip(*(batch.column(c).to_pylist() for c in ("window", "lo", "hi", "from_state", "to_state", "plain")), strict=True):
                left, right = m.states(w, lo)[i], m.states(w, hi)[j]
                ids.append(backtrace(m, w, lo, hi, left, right))
                shown = w[_place(left, lo, w)[0] : _place(right, hi, w)[0]].replace(MARK, " ")
                same.append(plain and m.decode(ids[-1], first=False) == shown)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("k"), pa.array(ids, ids_type), pa.array(same, pa.bool_())], names=["doc_id", "row", "k", "ids", "same"])

    long = F.char_length("text") >= chunk
    short_rows = docs.where(~long).mapInArrow(whole, out)
    chunks = docs.where(long).withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, "doc_id long, row long, k long, lo int, hi int, window string, plain boolean")
    chunks = stage(chunks, "chunks")
    states = chunks.select("row", "k", "lo", "hi", "window").mapInArrow(matrices, "row long, k long, matrix string").groupBy("row").applyInArrow(resolve, "row long, k long, from_state int, to_state int")
    traced = chunks.join(states, ["row", "k"]).mapInArrow(trace, "doc_id long, row long, k long, ids array<int>, same boolean")
    ordered = F.array_sort(F.collect_list(F.struct("k", "ids")))
    joined = traced.groupBy("row", "doc_id").agg(F.count("*").alias("n_chunks"), F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("token_ids"), F.every("same").alias("same"))
    long_rows = joined.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "n_chunks", "token_ids", F.col("same").alias("round_trip"))
    return short_rows.unionByName(long_rows)

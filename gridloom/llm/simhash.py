"""Near-duplicate documents by SimHash fingerprints and vantage-point trees.

Equal fingerprints are one point, however many documents share them. The upper levels of a vantage-point tree, fitted on
a bounded sample of fingerprints, deal all of them into leaves by Hamming distance from vantage points. A point lives
in one leaf; where it lies within the radius of a split it is also a guest on the split's other side, by the triangle
bound, so that every pair within the radius meets in some leaf. A leaf goes on with the same tree in memory and
compares exactly. It unites what it links and returns each point with its class's first, never the pairs. A class that
spans leaves is put together by the contraction in ``graphs``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import tokens
from gridloom.llm.graphs import components, join_to_one
from gridloom.llm.storage import stage

LONG = 1 << 20  # bytes of a text from which its words are taken in pieces
PIECE = 1 << 16  # words of a piece
BRUTE = 1 << 18  # comparisons below which points are compared without a further split


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, some thousand words at a time."""
    digest = xxhash.xxh64_intdigest
    if len(text) > LONG:  # no object for each word of a very long text
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = tokens.words(data, np.array([0, len(data)]))
        pieces = ([data[a:e].tobytes() for a, e in zip(starts[at : at + PIECE + shingle - 1], ends[at : at + PIECE + shingle - 1], strict=True)] for at in range(0, max(1, len(starts) - shingle + 1), PIECE))
    else:
        pieces = iter([text.split()])
    for words in pieces:
        if not words:
            return
        if len(words) < shingle:
            yield np.array([digest(b" ".join(words), 42)], np.uint64)
            continue
        joined = b" ".join(words)
        stops = np.cumsum([len(w) + 1 for w in words]) - 1
        first = [0, *(stops[:-shingle] + 1).tolist()] if len(words) > shingle else [0]
        yield np.array([digest(joined[a:b], 42) for a, b in zip(first, stops[shingle - 1 :].tolist(), strict=True)], np.uint64)


def simhash(text: bytes, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text; no words: zero."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text.lower(), shingle):
        n += len(h)
        for at in range(0, len(h), 4096):
            counts += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, extra: list[Column] | None = None) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row, and the columns of ``extra`` as they are."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(extra or []))
    rest = [c for c in chosen.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [simhash(x.as_py() or b"", shingle) for x in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(np.array(fp, np.uint64).view(np.int64))], names=[*rest, "fp"])

    return chosen.mapInArrow(run, ", ".join([*(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in rest), "fp long"]))


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _vantage(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """Of a few of the points, the one from which distances spread most, and the distance that splits it best; None if no distance splits the points."""
    best = None
    for v in points[np.linspace(0, len(points) - 1, min(12, len(points))).astype(int)]:
        d = distances(points, v)
        if best is None or d.std() > best[0]:
            best = (d.std(), v, d)
    _, v, d = best
    mu = int(np.median(d))
    if mu >= d.max():
        mu -= 1
    return (v, mu) if mu >= d.min() else None


def build_tree(sample: np.ndarray, leaves: int) -> list:
    """A nested list [vantage, mu, inside, outside] whose leaves are numbered from 0: at least one."""
    count = 0

    def grow(points: np.ndarray, leaves: int):
        nonlocal count
        split = _vantage(points) if leaves > 1 and len(points) > 2 else None
        if split is None:
            count += 1
            return count - 1
        inside = distances(points, split[0]) <= split[1]
        return [int(split[0]), split[1], grow(points[inside], leaves // 2), grow(points[~inside], leaves - leaves // 2)]

    return grow(sample, leaves)


def _step(points: np.ndarray, home: np.ndarray, vantage: np.uint64, mu: int, radius: int) -> tuple:
    """Which points go inside and outside, and which of these live there. A pair that a split parts is found inside."""
    d = distances(points, vantage).astype(np.int16)
    inside, outside = d <= mu + radius, np.where(home, d > mu, d > mu - radius)
    return inside, home & (d <= mu), outside, home


def route(points: np.ndarray, tree: list, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Leaves, the points that live in them, and their guests."""
    todo = [(tree, points, np.ones(len(points), bool))]
    while todo:
        node, p, home = todo.pop()
        if not len(p):
            continue
        if isinstance(node, int):
            yield node, p[home], p[~home]
            continue
        inside, home_in, outside, home_out = _step(p, home, np.uint64(node[0]), node[1], radius)
        todo += [(node[2], p[inside], home_in[inside]), (node[3], p[outside], home_out[outside])]


class Classes:
    """Union of positions, whose links come in arrays."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def link_within(points: np.ndarray, home: np.ndarray, radius: int, classes: Classes) -> None:
    """Link every pair of points within the radius of which one at least lives here. Points are distinct."""
    todo = [(np.arange(len(points)), home)]
    while todo:
        at, lives = todo.pop()
        n_home = int(lives.sum())
        if not n_home or len(at) < 2:
            continue
        split = _vantage(points[at[lives]]) if n_home > 24 and n_home * len(at) > BRUTE else None
        if split is not None:
            inside, home_in, outside, home_out = _step(points[at], lives, split[0], split[1], radius)
            if max(inside.sum(), outside.sum()) < 0.95 * len(at):
                todo += [(at[inside], home_in[inside]), (at[outside], home_out[outside])]
                continue
        own, step = at[lives], max(1, (1 << 20) // len(at))
        for k in range(0, n_home, step):
            i, j = np.nonzero(np.bitwise_count(points[own[k : k + step], None] ^ points[None, at]) <= radius)
            classes.link(own[k + i], at[j])


def linked_classes(fps: DataFrame, radius: int = 2, leaf_points: int = 8192, most_sampled: int = 1 << 20) -> DataFrame:
    """Of distinct fingerprints (fp), those with a smaller one in their class: node, root.

    The tree is fitted on about 32 fingerprints for each leaf, chosen by hash, ``most_sampled`` at most; all are indexed.
    """
    n = fps.count()
    leaves = max(1, -(-n // leaf_points))
    one_in = max(1, leaf_points // 32, -(-2 * n // most_sampled))
    chosen = fps.where(F.pmod(F.xxhash64(F.lit(9), "fp"), F.lit(one_in)) == 0).limit(most_sampled)
    sample = np.sort(chosen.toPandas()["fp"].to_numpy(np.int64)).view(np.uint64) if leaves > 1 else np.zeros(0, np.uint64)
    tree = build_tree(sample, leaves) if len(sample) else 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            found = list(route(points, tree, radius))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), *(pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (1, 2))], names=["leaf", "home", "guests"])

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        home, guests = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint64) for c in ("home", "guests"))
        points, lives = np.concatenate([home, guests]), np.arange(len(home) + len(guests)) < len(home)
        order = np.argsort(points.view(np.int64))
        points, lives = points[order], lives[order]
        classes = Classes(len(points))
        link_within(points, lives, radius, classes)
        moved = classes.root != np.arange(len(points))
        signed = points.view(np.int64)
        return pa.table({"a": pa.array(signed[moved]), "b": pa.array(signed[classes.root[moved]])})

    leafed = fps.mapInArrow(deal, "leaf long, home binary, guests binary")
    return components(leafed.groupBy("leaf").applyInArrow(solve, "a long, b long"), "simhash")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, leaf_points: int = 8192) -> DataFrame:
    """Class every row of ``docs`` (doc_id, text; other columns are not read): doc_id, fp, component_id.

    Rows link if their fingerprints differ in ``radius`` bits or fewer; ``component_id`` is the smallest doc_id that
    links reach, the row's own included. ASCII letters count as small. A text of fewer words than a shingle is one
    shingle; a null text is an empty one, whose fingerprint is zero, linked like any other. Rows repeated or of one
    doc_id each keep a row. Null doc_ids are passed over in minima; a class with no other has a null component_id. An
    empty table gives an empty table.
    """
    marked = stage(fingerprints(docs, shingle), "fingerprints")
    return join_to_one(marked, fingerprint_classes(marked, radius, leaf_points), "fp", marked.count()).select("doc_id", "fp", "component_id")


def fingerprint_classes(marked: DataFrame, radius: int, leaf_points: int) -> DataFrame:
    """fp, its class's least fingerprint (root) and component_id of every distinct fingerprint in (doc_id, fp)."""
    points = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = linked_classes(points.select("fp"), radius, leaf_points)
    placed = stage(points.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "classes")
    firsts = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return join_to_one(placed, firsts, "root", placed.count()).select("fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, leaf_points: int = 8192) -> DataFrame:
    """The rows of ``docs`` with one of each class: that of the smallest doc_id, or of rows of one doc_id any one.

    All columns are kept. Rows whose doc_id is null stay only where their class has no other.
    """
    key = F.xxhash64("text")
    marked = stage(fingerprints(docs, shingle, [key.alias("text_key")]), "fingerprints")
    rows = join_to_one(marked, fingerprint_classes(marked, radius, leaf_points), "fp", marked.count())
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("b")).select("b.doc_id", "b.text_key")
    best = stage(best, "kept")
    kept = docs.alias("d").join(best.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & F.xxhash64("d.text").eqNullSafe(F.col("k.text_key")), "left_semi")
    repeated = marked.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept

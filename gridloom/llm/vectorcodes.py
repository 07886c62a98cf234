"""Vectors as short codes: an index into a small codebook for each part of a vector, learned in whole numbers.

Components become integers, so assignments, sums and errors are exact and do not depend on the order of rows. An entry
is found by partial distances: dimensions are taken in descending variance of the codebook, and a vector drops an entry
as soon as what has been summed exceeds its best whole distance. A round is one pass over the vectors: tasks sum what
they assigned, Spark adds up a row for each entry's component, and the driver sees the codebooks, never vectors but the
first few.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.storage import set_aside

ROWS = 1 << 14  # vectors compared at a time


@dataclass
class Codebooks:
    """The entries of each part, an array (entries, width) of integers; ``dims`` is None where no vector was kept."""

    books: list[np.ndarray]
    dims: int | None
    scale: int

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, as decimals with commas between."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def bound(dims: int, scale: int) -> float:
    """The least size of a component from which sums of squares would leave 64 bits."""
    return 2.0**30 / math.sqrt(max(1, dims)) / scale


def kept_vectors(vectors: DataFrame, vector_col: str, scale: int, dims: int | None = None) -> DataFrame:
    """Rows whose vector is no null, of finite components below the bound, and of ``dims`` of them if given."""
    most = bound(dims or 1, scale)
    kept = vectors.where(F.col(vector_col).isNotNull()).where(F.forall(F.col(vector_col).cast("array<double>"), lambda x: F.abs(x) < F.lit(most)))
    return kept if dims is None else kept.where(F.size(vector_col) == dims)


def edges(dims: int, parts: int) -> list[int]:
    """Where parts begin and end: consecutive, of equal width where ``parts`` divides ``dims``."""
    return [k * dims // parts for k in range(parts + 1)]


def integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """The components of kept vectors, an array (dims, rows), rounded down."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)
    return np.ascontiguousarray(np.floor(scale * x).astype(np.int64).T)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of vectors (width, rows), the index of the nearest entry, of equally near ones the first, and its squared distance."""
    spread = len(book) * (book * book).sum(0) - book.sum(0) ** 2
    order = np.argsort(-spread, kind="stable")
    code, best = np.zeros(part.shape[1], np.uint8), ((part - book[0][:, None]) ** 2).sum(0)
    for k in range(1, len(book)):
        alive, summed = np.arange(len(best)), np.zeros(len(best), np.int64)
        for d in order:
            summed = summed + (part[d][alive] - book[k, d]) ** 2
            stays = summed <= best[alive]
            if not stays.all():
                alive, summed = alive[stays], summed[stays]
                if not len(alive):
                    break
        better = summed < best[alive]
        best[alive[better]] = summed[better]
        code[alive[better]] = k
    return code, best


def _assigned(x: np.ndarray, books: list[np.ndarray], cut: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and distances, arrays (parts, rows)."""
    found = [nearest(x[a:b], book) for book, a, b in zip(books, cut, cut[1:], strict=False)]
    return np.array([c for c, _ in found]), np.array([d for _, d in found])


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks:
    """Codebooks that start as the parts of the ``entries`` kept vectors of the smallest ids and are replaced ``rounds`` times by the means, rounded down, of what is nearest to each.

    An entry to which nothing is nearest stays. Null ids come last, rows of one id in the order of their vectors. The
    first kept vector says how many components a vector has; null vectors and those with another number of components, or
    with a null, non-finite or too large one (see ``bound``), take no part. Fewer than ``entries`` vectors give as many entries.
    """
    first = lambda kept, n: kept.orderBy(F.asc_nulls_last(id_col), vector_col).limit(n).select(F.col(vector_col).cast("array<double>")).collect()
    start = first(kept_vectors(vectors, vector_col, scale), entries)
    if not start:
        return Codebooks([np.zeros((0, 0), np.int64)] * parts, None, scale)
    dims = len(start[0][0])
    if any(len(r[0]) != dims or any(abs(x) >= bound(dims, scale) for x in r[0]) for r in start):
        start = first(kept_vectors(vectors, vector_col, scale, dims), entries)
    rows = np.floor(scale * np.array([r[0] for r in start], np.float64).reshape(len(start), dims)).astype(np.int64)
    cut = edges(dims, parts)
    books = [rows[:, a:b].copy() for a, b in zip(cut, cut[1:], strict=False)]
    kept = kept_vectors(vectors, vector_col, scale, dims).select(F.col(vector_col).cast("array<double>").alias("x"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = [np.zeros(book.shape, np.int64) for book in books], np.zeros((parts, len(rows)), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = integers(batch.column("x").slice(at, ROWS), dims, scale)
                codes, _ = _assigned(x, books, cut)
                for k in range(parts):
                    count[k] += np.bincount(codes[k], minlength=len(rows))
                    order = np.argsort(codes[k], kind="stable")
                    begins = np.flatnonzero(np.append(True, np.diff(codes[k][order])))
                    if cut[k] < cut[k + 1]:
                        total[k][codes[k][order][begins]] += np.add.reduceat(x[cut[k] : cut[k + 1]][:, order], begins, axis=1).T
        at = [(k, e, d) for k in range(parts) for e in range(len(rows)) if count[k, e] for d in range(cut[k + 1] - cut[k])]
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([k for k, _, _ in at], pa.int32()),
                "entry": pa.array([e for _, e, _ in at], pa.int32()),
                "dim": pa.array([d for _, _, d in at], pa.int32()),
                "total": pa.array([int(total[k][e, d]) for k, e, d in at], pa.int64()),
                "n": pa.array([int(count[k, e]) for k, e, _ in at], pa.int64()),
            }
        )

    for _ in range(rounds):
        found = kept.mapInArrow(sums, "part int, entry int, dim int, total long, n long").groupBy("part", "entry", "dim")
        for r in found.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
            books[r.part][r.entry, r.dim] = int(r.total) // r.n
    return Codebooks(books, dims, scale)


def encode(vectors: DataFrame, codebooks: Codebooks, vector_col: str = "embedding") -> DataFrame:
    """Rows of ``vectors`` that take part, without their vectors, with code (two hexadecimal digits a part) and error (the squared distances to the entries, summed).

    Input columns of these names get _in behind them (or more of it, where that is taken). Null vectors and those that
    ``fit`` leaves out are not returned; an empty table gives an empty table.
    """
    vectors = set_aside(vectors, "code", "error")
    rest = [f for f in vectors.schema.fields if f.name != vector_col]
    schema = T.StructType([*rest, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if codebooks.dims is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims, cut, digits = codebooks.dims, edges(codebooks.dims, len(codebooks.books)), np.frombuffer(b"0123456789abcdef", np.uint8)
    kept = kept_vectors(vectors, vector_col, codebooks.scale, dims).select(*(F.col(f"`{f.name}`") for f in rest), F.col(vector_col).cast("array<double>").alias(vector_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                codes, distances = _assigned(integers(some.column(vector_col), dims, codebooks.scale), codebooks.books, cut)
                text = np.stack([digits[codes.T >> 4], digits[codes.T & 15]], axis=2)
                shown = pa.Array.from_buffers(pa.string(), some.num_rows, [None, pa.py_buffer((np.arange(some.num_rows + 1) * 2 * len(codes)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text))])
                yield pa.RecordBatch.from_arrays([*(some.column(f.name) for f in rest), shown, pa.array(distances.sum(0))], names=schema.names)

    return kept.mapInArrow(run, schema)

"""Exact top-k search by inner product, over buckets of vectors of like length.

Candidates are sorted by length and cut into buckets, neighbouring buckets into groups; queries are packed into blocks.
Every query begins with a floor, its k-th best score among a bounded seed of the longest vectors, and a block goes to
those groups only that are long enough for one of its queries to reach its floor. There it meets the buckets, longest
first, and its floors rise. A floor gives a bucket a local cosine threshold: floor / (query length x bucket length).
Above 1 the bucket is skipped. Else the bucket picks, for the query, length pruning, where few of its vectors are long
enough for the floor, or coordinate pruning: partial products over the query's largest coordinates, as many as leave a
remainder that is small against the threshold, bound the rest by lengths. What is left is verified by whole products in
integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.storage import stage

REMAINDER = 0.4  # of the local threshold: how much of a query the coordinates left out may hold
MOST_GROUPS = 1 << 16  # groups of buckets, whose lengths every block of queries is held against


def quantized(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as long; null for vectors null, empty or with a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    wide = F.transform(vector, lambda x: x.cast("double"))
    return F.when(~F.exists(wide, bad), F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


class Vectors:
    """Rows of integers with their ids; kept as doubles too for fast products."""

    def __init__(self, ids: np.ndarray, v: np.ndarray) -> None:
        self.ids, self.v, self.f = ids, v, v.astype(np.float64)
        self.lengths = np.sqrt((self.f**2).sum(1))
        self.most = int(np.abs(self.f).max(initial=0.0))

    @cached_property
    def columns(self) -> np.ndarray:
        return np.ascontiguousarray(self.f.T)

    @cached_property
    def largest(self) -> tuple[np.ndarray, np.ndarray]:
        """Each row's coordinates, the largest first, and the length of what is left after each number of them."""
        order = np.argsort(-np.abs(self.f), axis=1, kind="stable")
        tail = np.cumsum(np.take_along_axis(self.f, order, 1)[:, ::-1] ** 2, axis=1)[:, ::-1]
        return order, np.sqrt(np.append(tail, np.zeros((len(tail), 1)), 1))


def products(a: Vectors, rows: np.ndarray | slice, b: Vectors, columns: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Exact inner products of rows; beyond what a long holds they stop at its ends."""
    bound = a.most * b.most * max(1, a.v.shape[1])
    if bound < 1 << 53:
        return (a.f[rows] @ b.f[columns].T).astype(np.int64)
    if bound < 1 << 62:
        return a.v[rows] @ b.v[columns].T
    return np.clip(a.v[rows].astype(object) @ b.v[columns].astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far; equal scores go to smaller ids. An id counts once, with its best score, or as often as it comes."""

    def __init__(self, n: int, k: int, once: bool = True) -> None:
        self.k, self.once, self.floor = k, once, np.full(n, -np.inf)
        self.score: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * n

    def add(self, q: int, score: np.ndarray, ids: np.ndarray, own: int) -> None:
        near = (score >= self.floor[q]) & (ids != own)
        score, ids = score[near], ids[near]
        if not len(ids):
            return
        score, ids = np.concatenate([self.score[q], score]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((ids, ~score))
        if self.once:
            _, first = np.unique(ids[order], return_index=True)
            order = order[np.sort(first)]
        order = order[: self.k]
        self.score[q], self.ids[q] = score[order], ids[order]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], self.score[q][-1])


def search_bucket(best: Best, queries: Vectors, bucket: Vectors) -> int:
    """Offer a bucket's vectors, sorted by falling length, to all queries; returns how many products were verified."""
    slack = 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = best.floor / (queries.lengths * bucket.lengths[0])
    cosine[~np.isfinite(cosine)] = -1.0  # no k scores yet, or a length of zero
    order, rest = queries.largest
    dense, verified, n = [], 0, len(bucket.ids)
    for q in np.flatnonzero(cosine <= 1 + slack):
        if cosine[q] <= 0:
            dense.append(q)
            continue
        size = queries.lengths[q]
        long = int(np.searchsorted(-bucket.lengths, -best.floor[q] / size * (1 - slack), "right"))
        left = np.arange(long)
        if 4 * long > n:  # lengths leave too many: coordinates
            k = int(np.argmax(rest[q] <= REMAINDER * cosine[q] * size))
            part = queries.f[q, order[q, :k]] @ bucket.columns[order[q, :k], :long]
            left = np.flatnonzero(part + (rest[q, k] + slack * size) * bucket.lengths[:long] >= best.floor[q])
        if 2 * len(left) > n:
            dense.append(q)
        elif len(left):
            verified += len(left)
            best.add(q, products(queries, slice(q, q + 1), bucket, left)[0], bucket.ids[left], queries.ids[q])
    if dense:  # hardly pruned: their products at once
        score = products(queries, np.array(dense), bucket)
        verified += score.size
        reach = (score >= best.floor[dense][:, None]) & (bucket.ids[None, :] != queries.ids[dense][:, None])
        for k in np.flatnonzero(reach.any(1)):
            best.add(dense[k], score[k, reach[k]], bucket.ids[reach[k]], queries.ids[dense[k]])
    return verified


def floors(queries: Vectors, seed: Vectors | None, k: int, once: bool) -> np.ndarray:
    """Each query's k-th best score among the seed; minus infinity where there are fewer."""
    best = Best(len(queries.ids), k, once)
    if seed is not None and len(seed.ids):
        search_bucket(best, queries, seed)
    return best.floor


def _narrow(v: np.ndarray) -> bytes:
    """Integers in the fewest bytes that hold them all."""
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= v.min() and v.max() <= np.iinfo(t).max)
    return v.astype(kind).tobytes()


def _unpack(ids: bytes, vectors: bytes, dim: int) -> Vectors:
    ids = np.frombuffer(ids, np.int64)
    return Vectors(ids, np.frombuffer(vectors, f"i{len(vectors) // (len(ids) * dim)}").astype(np.int64).reshape(-1, dim))


def _packer(most: int):
    """Batches of (vec_id, v), sorted by dimension and length, as rows of at most ``most`` vectors of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packed(dim: int) -> pa.RecordBatch:
            ids, v = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held.clear()
            lengths = Vectors(ids, v).lengths
            order = np.lexsort((ids, -lengths))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([float(lengths.max())]), pa.array([len(ids)], pa.int64()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([_narrow(v[order])], pa.binary())], names=["dim", "longest", "n", "ids", "vectors"])

        dim = 0
        for batch in batches:
            ids, vectors = batch.column("vec_id").to_numpy(), batch.column("v")
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy()
            ends = np.cumsum(sizes)
            at = 0
            while at < len(ids):
                if held and (sizes[at] != dim or sum(len(h[0]) for h in held) >= most):
                    yield packed(dim)
                dim = int(sizes[at])
                room = most - sum(len(h[0]) for h in held)
                run_end = at + int(np.argmax(np.append(sizes[at:] != dim, True)))
                upto = min(run_end, at + room)
                held.append((ids[at:upto].astype(np.int64), flat[ends[at] - dim : ends[upto - 1]].reshape(-1, dim).astype(np.int64)))
                at = upto
        if held:
            yield packed(dim)

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, bucket: int = 2048, block: int = 512, seed_vectors: int = 4096, group_buckets: int | None = None, once: bool = True) -> DataFrame:
    """The ``k`` vectors of largest inner product with each query: query_id, rank (from 1), vec_id, score.

    ``vectors`` has vec_id and embedding (other columns are not read); ``queries`` says which rows are queries too.
    Components become floor(scale * x). Ties go to the smaller vec_id. A query is compared with every vector of its
    dimension but those of its own id. Rows that share a vec_id count as one, with their best score, or, without
    ``once``, as rows of their own; rows of one id that are queries share one list. Rows with a null vec_id, and vectors
    null, empty or holding null or non-finite components, take no part. Fewer vectors than ``k`` give shorter lists; an
    empty table gives an empty one. ``group_buckets`` says how many buckets a task holds at once; unset, it is as many
    as leave each task some groups, 32 at most (4 MB of bytes), and more only beyond ``MOST_GROUPS`` groups.
    """
    spark = vectors.sparkSession
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("embedding"), scale).alias("v"), queries.alias("is_query"))
    found = found.where("vec_id is not null and v is not null and size(v) > 0")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    found = stage(found.withColumn("squares", squares), "vectors")
    seed = found.orderBy(F.col("squares").desc(), "vec_id").limit(seed_vectors).select("vec_id", "v").collect()  # bounded by seed_vectors
    seed_of = {dim: Vectors(np.array([r.vec_id for r in seed if len(r.v) == dim], np.int64), np.array([r.v for r in seed if len(r.v) == dim], np.int64)) for dim in {len(r.v) for r in seed}}
    order = [F.size("v"), F.col("squares").desc(), F.xxhash64("vec_id")]
    packed = "dim int, longest double, n long, ids binary, vectors binary"

    def pack(df: DataFrame, most: int) -> DataFrame:
        return df.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "v").mapInArrow(_packer(most), packed).withColumn("number", F.monotonically_increasing_id())

    def with_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a block must know: its queries' floors, and the shortest length that can reach one of them."""
        for batch in batches:
            kept, least = [], []
            for dim, ids, v in zip(*(batch.column(c).to_pylist() for c in ("dim", "ids", "vectors")), strict=True):
                block_of = _unpack(ids, v, dim)
                floor = floors(block_of, seed_of.get(dim), k, once)
                with np.errstate(divide="ignore", invalid="ignore"):
                    needed = np.where((floor > 0) & (block_of.lengths > 0), floor / block_of.lengths, 0.0)
                kept.append(floor.tobytes())
                least.append(float(needed.min()) * (1 - 1e-9) if not np.isnan(needed).any() else 0.0)
            yield batch.append_column("floors", pa.array(kept, pa.binary())).append_column("least", pa.array(least, pa.float64()))

    buckets = stage(pack(found, bucket), "buckets")
    blocks = stage(pack(found.where("is_query"), block).mapInArrow(with_floors, packed + ", number long, floors binary, least double"), "blocks")
    n_buckets = buckets.count()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group_buckets = max(group_buckets or min(32, n_buckets // (2 * partitions)), n_buckets // MOST_GROUPS, 1)
    # neighbours in the order of lengths, within a partition of that order
    group = F.shiftleft(F.shiftright("number", 33), 33) + F.floor(F.col("number").bitwiseAND((1 << 33) - 1) / group_buckets)
    grouped = buckets.withColumn("group", group)
    listed = grouped.groupBy("group", "dim").agg(F.max("longest").alias("longest")).agg(F.collect_list(F.struct("group", "dim", "longest")).alias("groups"))  # MOST_GROUPS entries about, of 24 bytes
    reach = F.explode(F.transform(F.filter("groups", lambda g: (g["dim"] == F.col("dim")) & (g["longest"] >= F.col("least"))), lambda g: g["group"]))
    asked = blocks.crossJoin(F.broadcast(listed)).select(reach.alias("group"), F.lit(1).alias("kind"), "dim", "longest", "number", "ids", "vectors", "floors")
    held = grouped.select("group", F.lit(0).alias("kind"), "dim", "longest", "number", "ids", "vectors", F.lit(None).cast("binary").alias("floors"))
    n_tasks = max(partitions, -(-n_buckets // group_buckets))  # few bytes, but much to compute: not to be put together by size
    met = held.union(asked).repartition(n_tasks, "group").sortWithinPartitions("group", "kind", F.col("longest").desc(), "number")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                of, kind, dim, ids, v, floor = (batch.column(c)[row].as_py() for c in ("group", "kind", "dim", "ids", "vectors", "floors"))
                if of != now:
                    now, mine = of, []
                if kind == 0:
                    mine.append((dim, _unpack(ids, v, dim)))
                    continue
                asking = _unpack(ids, v, dim)
                best = Best(len(asking.ids), k, once)
                best.floor[:] = np.frombuffer(floor, np.float64)
                for other, bucket_of in mine:
                    if other == dim:
                        search_bucket(best, asking, bucket_of)
                sizes = [len(x) for x in best.ids]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asking.ids, sizes), pa.int64()), pa.array(np.concatenate(best.ids), pa.int64()), pa.array(np.concatenate(best.score), pa.int64())], names=["query_id", "vec_id", "score"])

    scored = met.mapInArrow(search, "query_id long, vec_id long, score long")
    if once:
        scored = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

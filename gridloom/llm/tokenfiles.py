"""Token ids of documents in files: Huffman-coded blocks in the order of doc_id, each readable alone.

Format (a folder of three Parquet tables, so that any store Spark writes to will do and its commits hold):

- ``code``: id, bits. The lengths of a canonical code over the counts of the whole corpus.
- ``blocks``: file, block, at (ids of the file before the block), doc_ids, sizes, befores (of each piece of a document in
  the block: its doc_id, its ids, and the document's ids before it), starts (the checkpoints: the bit at which each run of
  128 ids begins; every piece begins one), bits. A block has up to 65,536 ids; a longer document goes on in others.
- ``files``: file, first (ids in all files before it).

Documents are encoded once and staged with their ids; ids are counted by tasks and summed; each piece of a document is
coded where it lies and only code words move to the file that holds its range of doc_ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, huffman, tokens
from gridloom.llm.parts import plan_parts
from gridloom.llm.storage import discard, new_path, stage

BLOCK = 1 << 16  # ids of a block; a multiple of the run
ENCODED = 8 << 20  # bytes of text encoded at a time, or one text


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, str]:
    """doc_id, n_ids, print (a hash of the ids), row (a number of the row's own) and ids (bytes of 16- or 32-bit integers) of every document, the end id last; and the kind of integers."""
    from tokenizers import Tokenizer

    width = "<u2" if max(end_id, Tokenizer.from_file(tokenizer).get_vocab_size() - 1) < 1 << 16 else "<u4"
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tokens.slices(batch, most=ENCODED):
                ids, offsets = bpe.encode(piece.column("text"), tokenizer)
                ids = np.insert(ids.astype(width), offsets[1:], end_id)
                offsets = (offsets + np.arange(len(offsets))) * ids.itemsize
                held = pa.Array.from_buffers(pa.large_binary(), piece.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                sizes = pa.array(np.diff(offsets) // ids.itemsize)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("row"), sizes, held.cast(pa.binary())], names=["doc_id", "row", "n_ids", "ids"])
            pa.default_memory_pool().release_unused()

    found = chosen.mapInArrow(run, "doc_id long, row long, n_ids long, ids binary")
    return found.withColumn("print", F.xxhash64("ids")), width


def count_ids(encoded: DataFrame, width: str) -> np.ndarray:
    """How often each id occurs. Tasks count; the driver sees one row an id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()  # workers live on from stage to stage
        total = np.zeros(1, np.int64)
        for batch in batches:
            data, _ = tokens.column_bytes(batch.column("ids"))
            found = np.bincount(data.view(width), minlength=len(total))
            found[: len(total)] += total
            total = found
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = rows["id"].to_numpy(), rows["n"].to_numpy()
    counts = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    counts[ids] = n
    return counts


def _coded(lengths: np.ndarray, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        code = huffman.Code.of(lengths)
        for batch in batches:
            rows: dict[str, list] = {"of": [], "before": [], "size": [], "starts": [], "bits": []}
            for i, held in enumerate(batch.column("ids")):
                ids = np.frombuffer(held.as_buffer(), width)
                for before in range(0, len(ids), BLOCK):
                    piece = ids[before : before + BLOCK]
                    bits, starts = huffman.encode(piece, code)
                    for name, value in (("of", i), ("before", before), ("size", len(piece)), ("starts", starts.astype("<u4").tobytes()), ("bits", bits)):
                        rows[name].append(value)
            of = pa.array(rows["of"], pa.int64())
            columns = [batch.column(c).take(of) for c in ("part", "doc_id", "print", "row")]
            columns += [pa.array(rows["before"], pa.int64()), pa.array(rows["size"], pa.int64()), pa.array(rows["starts"], pa.binary()), pa.array(rows["bits"], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "print", "row", "before", "size", "starts", "bits"])

    return run


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces laid into blocks; a block ends where its file does, or before the piece that would fill it beyond its size."""
    file, block, at, size = None, 0, 0, 0
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        bases = np.cumsum([0, *(8 * len(bits) for *_, bits in held)])
        starts = np.concatenate([np.frombuffer(s, "<u4") + b for (*_, s, _), b in zip(held, bases, strict=False)])
        return pa.RecordBatch.from_pydict(
            {
                "file": pa.array([file], pa.int32()),
                "block": pa.array([block], pa.int64()),
                "at": pa.array([at], pa.int64()),
                "doc_ids": pa.array([[h[0] for h in held]], pa.list_(pa.int64())),
                "befores": pa.array([[h[1] for h in held]], pa.list_(pa.int64())),
                "sizes": pa.array([[h[2] for h in held]], pa.list_(pa.int64())),
                "starts": pa.array([starts.astype("<u4").tobytes()], pa.binary()),
                "bits": pa.array([b"".join(h[4] for h in held)], pa.binary()),
            }
        )

    for batch in batches:
        for part, *piece in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "before", "size", "starts", "bits")), strict=True):
            if held and (part != file or size + piece[2] > BLOCK):
                yield flush()
                block, at, size, held = block + 1, at + size, 0, []
            if part != file:
                file, block, at = part, 0, 0
            size += piece[2]
            held.append(tuple(piece))
    if held:
        yield flush()


_BLOCKS = "file int, block long, at long, doc_ids array<long>, befores array<long>, sizes array<long>, starts binary, bits binary"


def write_tokens(docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int = 2, file_ids: int = 1 << 22) -> str:
    """Encode the texts of ``docs`` (doc_id, text; other columns are not read) and write their ids as token files; returns the folder.

    A null text is an empty one, whose only id is the end. Documents stand in the order of doc_id, null last; rows of one
    doc_id in an order that their ids alone decide, and each of equal rows is a document. A table without rows gives
    files without blocks. ``out`` unset: a folder among the session's shared ones.
    """
    spark = docs.sparkSession
    out = out or new_path(spark, "tokens")
    found, width = tokenize(docs, tokenizer, end_id)
    ids_path = new_path(spark, "ids")
    found.write.option("compression", "zstd").parquet(ids_path)
    encoded = spark.read.schema(found.schema).parquet(ids_path)
    lengths = huffman.code_lengths(count_ids(encoded, width))
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": pa.array(used, pa.int64()), "bits": pa.array(lengths[used].astype(np.int32))})).coalesce(1).write.parquet(f"{out}/code")
    parts = plan_parts(encoded, "doc_id", "ids", file_ids, weight=F.col("n_ids"))
    coded = encoded.withColumn("part", parts.part).mapInArrow(_coded(lengths, width), "part int, doc_id long, print long, row long, before long, size long, starts binary, bits binary")
    n = max(parts.count, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = coded.repartition(n, "part").sortWithinPartitions("part", F.asc_nulls_last("doc_id"), "print", "row", "before")
    dealt.mapInArrow(_assembled, _BLOCKS).write.parquet(f"{out}/blocks")
    discard(spark, ids_path)
    per_file = spark.read.parquet(f"{out}/blocks").groupBy("file").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # a row for each file of some million ids
    per_file.selectExpr("file", "coalesce(sum(n) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first").write.parquet(f"{out}/files")
    return out


def read_code(spark: SparkSession, path: str) -> np.ndarray:
    """The code's lengths by id; the table has a row an id of the vocabulary."""
    rows = spark.read.schema("id long, bits int").parquet(f"{path}/code").toArrow()
    ids = rows["id"].to_numpy()
    lengths = np.zeros(int(ids.max(initial=0)) + 1, np.uint8)
    lengths[ids] = rows["bits"].to_numpy()
    return lengths


def _decoded(batch: pa.RecordBatch, code: huffman.Code) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of blocks, end to end, and the n + 1 offsets of their pieces."""
    data, offsets = tokens.column_bytes(batch.column("bits"))
    starts, start_offsets = tokens.column_bytes(batch.column("starts"))
    begins = starts.view("<u4").astype(np.int64) + np.repeat(8 * offsets[:-1], np.diff(start_offsets) // 4)
    sizes = batch.column("sizes").flatten().to_numpy()
    n_runs = -(-sizes // huffman.RUN)
    runs = np.full(int(n_runs.sum()), huffman.RUN)
    runs[np.cumsum(n_runs) - 1] = sizes - (n_runs - 1) * huffman.RUN
    return huffman.decode(data, begins, runs, code), np.append(0, np.cumsum(sizes))


def read_pieces(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document in a block: doc_id, start (of the document, among all ids), before, size, crc (of the piece's ids), and with ``with_ids`` the ids.

    Every block is decoded alone, in any task.
    """
    lengths = read_code(spark, path)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    placed = blocks.join(spark.read.schema("file int, first long").parquet(f"{path}/files"), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        code = huffman.Code.of(lengths)
        for batch in batches:
            for piece in tokens.slices(batch, "bits", 1 << 20):
                ids, offsets = _decoded(piece, code)
                counts = np.diff(piece.column("sizes").offsets.to_numpy())
                at = piece.column("first").to_numpy() + piece.column("at").to_numpy()
                first_piece = np.cumsum(counts) - counts
                before = piece.column("befores").flatten().to_numpy()
                start = np.repeat(at - offsets[first_piece], counts) + offsets[:-1] - before
                whole = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:], strict=False)]
                columns = [piece.column("doc_ids").flatten(), pa.array(start), pa.array(before), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "before", "size", "crc"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return placed.mapInArrow(run, "doc_id long, start long, before long, size long, crc long" + ", ids array<int>" * with_ids)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (array<int>) of every document of token files; a document's pieces are laid together."""
    pieces = read_pieces(spark, path, with_ids=True)
    whole = pieces.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("before", "ids"))), lambda p: p["ids"])).alias("ids"))
    return whole.select("doc_id", "start", "ids")


def read_range(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """start and ids of the runs that hold the ids numbered ``first`` to ``first + count - 1``, cut to them.

    Only blocks of the range are read, and of these only the runs of the range are decoded, from their checkpoints.
    """
    lengths = read_code(spark, path)
    files = spark.read.schema("file int, first long").parquet(f"{path}/files")
    n = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").join(files, "file").withColumn("at", F.col("first") + F.col("at"))
    wanted = blocks.where((F.col("at") < first + count) & (F.col("at") + n > first)).select("at", "sizes", "starts", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = huffman.Code.of(lengths)
        for batch in batches:
            for at, sizes, starts, bits in zip(*(batch.column(c).to_pylist() for c in ("at", "sizes", "starts", "bits")), strict=True):
                n_runs = [-(-s // huffman.RUN) for s in sizes]
                runs = np.array([min(huffman.RUN, s - k * huffman.RUN) for s, m in zip(sizes, n_runs, strict=True) for k in range(m)], np.int64)
                begins = at + np.cumsum(runs) - runs
                some = np.flatnonzero((begins < first + count) & (begins + runs > first))
                ids = huffman.decode(np.frombuffer(bits, np.uint8), np.frombuffer(starts, "<u4")[some], runs[some], code)
                low = max(0, first - int(begins[some[0]]))
                high = min(len(ids), first + count - int(begins[some[0]]))
                yield pa.RecordBatch.from_arrays([pa.array([int(begins[some[0]]) + low], pa.int64()), pa.array([ids[low:high].astype(np.int32)], pa.list_(pa.int32()))], names=["start", "ids"])

    return wanted.mapInArrow(run, "start long, ids array<int>")


def _shift(crc: int, n_bytes: int) -> int:
    """A CRC-32 as it stands after ``n_bytes`` zero bytes more, without the inversions: a product in the field of its polynomial."""

    def product(a: int, b: int) -> int:
        out = 0
        for k in range(31, -1, -1):  # the highest bit stands for x^0
            if a >> k & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, square = 1 << 31, 1 << 23  # x^0 and x^8
    while n_bytes:
        power = product(power, square) if n_bytes & 1 else power
        square, n_bytes = product(square, square), n_bytes >> 1
    return product(crc, power)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of token files; the CRCs of pieces are combined without their ids."""
    pieces = read_pieces(spark, path)
    whole = pieces.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.sum("size").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("before", "size", "crc"))).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for some in batch.column("pieces").to_pylist():
                crc = some[0]["crc"]
                for p in some[1:]:
                    crc = _shift(crc, 4 * p["size"]) ^ p["crc"]
                out.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(out, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return whole.select("doc_id", "start", "n_tokens", "pieces").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

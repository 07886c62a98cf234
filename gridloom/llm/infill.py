"""Fill-in-middle: documents cut at token boundaries into prefix, middle and suffix, and put in another order.

A token is a word with the white space before it, or white space at a text's end, so a token ends where a character that
is none is followed by white space or by nothing: a predicate on two adjacent characters. A text is cut into chunks that
overlap by a character. Each chunk counts its boundaries alone; prefix sums of the counts say how many tokens a text has
and which chunks own its two cuts; only these are scanned again for the places.

Texts of some chunks have them counted side by side in one task. Those of a longer text are dealt over all tasks: chunks
move once, then a row of counts for each, and the text once more to meet its cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import tokens
from gridloom.llm.storage import set_aside

CHUNK = 1 << 16  # bytes
NEAR = 16  # chunks of a text that one task counts
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
COLUMNS = ["n", "form", "prefix_chars", "middle_chars", "output"]


def boundaries(data: np.ndarray) -> np.ndarray:
    """Of bytes but the last, whether a token ends there; the last is the overlap with what follows."""
    space = tokens.SPACE[data]
    return ~space[:-1] & space[1:]


def chunk_edges(data: np.ndarray, begin: int, end: int, size: int) -> list[int]:
    """Where the chunks of a text begin, and its end; no character is cut."""
    edges = [begin]
    while end - edges[-1] > size:
        at = edges[-1] + size
        while at > edges[-1] + 1 and data[at] & 0xC0 == 0x80:
            at -= 1
        edges.append(at)
    return [*edges, end]


def lead(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def place(data: np.ndarray, rank: int) -> tuple[int, int]:
    """Bytes and characters of a chunk up to the end of its ``rank``-th token; the chunk's overlap follows it."""
    at = int(np.flatnonzero(boundaries(data))[rank - 1]) + 1
    return at, int(lead(data[:at]).sum())


def two_cuts(data: np.ndarray, size: int, draws: tuple[int, int], wanted: bool) -> tuple[int, int, int]:
    """The tokens of one text, and the characters before its two cuts (0 where they are not wanted). ``data`` ends with a space as overlap."""
    edges = chunk_edges(data, 0, len(data) - 1, size)
    counts = [int(boundaries(data[a : b + 1]).sum()) for a, b in zip(edges, edges[1:], strict=False)]
    sums = np.cumsum(counts)
    n = int(sums[-1]) + (len(data) > 1 and bool(tokens.SPACE[data[-2]]))
    if not wanted:
        return n, 0, 0
    chars = np.append(0, np.cumsum([int(lead(data[a:b]).sum()) for a, b in zip(edges, edges[1:], strict=False)]))
    cuts = []
    for rank in sorted(d % (n + 1) for d in draws):
        k = int(np.searchsorted(sums, rank))
        if rank == 0 or k == len(sums):
            cuts.append(0 if rank == 0 else int(chars[-1]))
        else:
            cuts.append(int(chars[k]) + place(data[edges[k] : edges[k + 1] + 1], rank - int(sums[k]) + counts[k])[1])
    return n, *cuts


def _bytes(value: pa.Scalar) -> np.ndarray:
    """A text's bytes with a space behind them."""
    held = value.as_buffer()
    return np.concatenate([np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8), np.array([0x20], np.uint8)])


def _near(docs: DataFrame, size: int) -> DataFrame:
    """Documents whose chunks one task counts, with n, low and high."""
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in ("__fim_n", "__fim_low", "__fim_high"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, a, b = (batch.column(c).to_pylist() for c in ("__fim_cut", "__fim_h1", "__fim_h2"))
            found = [two_cuts(_bytes(x), size, (a[i], b[i]), wanted[i]) for i, x in enumerate(batch.column("__fim_text").cast(pa.binary()))]
            new = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return docs.mapInArrow(run, schema)


def _far(docs: DataFrame, size: int) -> DataFrame:
    """Documents whose chunks are dealt over tasks, with n, low and high.

    Rows equal in doc_id and text have the same cuts; their chunks are counted each, their counts taken once.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("__fim_key", F.sha2(F.concat(F.col("__fim_id"), F.lit(":"), F.col("__fim_text")).cast("binary"), 256))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = 0
        for batch in batches:
            for key, a, b, text in zip(*(batch.column(c).to_pylist() for c in ("key", "h1", "h2")), batch.column("text").cast(pa.binary()), strict=True):
                data = _bytes(text)
                edges = chunk_edges(data, 0, len(data) - 1, size)
                for k in range(0, len(edges) - 1, 256):
                    some = list(zip(edges[k:], edges[k + 1 : k + 257], strict=False))
                    m = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * m), pa.array([a] * m, pa.int64()), pa.array([b] * m, pa.int64()), pa.array([x for x, _ in some], pa.int64()), pa.array([y == len(data) - 1 for _, y in some]), pa.array(range(dealt, dealt + m), pa.int64()), pa.array([data[x : y + 1].tobytes() for x, y in some], pa.binary())],
                        names=["key", "h1", "h2", "at", "last", "dealt", "data"],
                    )
                    dealt += m

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column("data")]
            ends, chars = [int(boundaries(d).sum()) for d in held], [int(lead(d[:-1]).sum()) for d in held]
            trailing = [bool(is_last) and len(d) > 1 and bool(tokens.SPACE[d[-2]]) for d, is_last in zip(held, batch.column("last").to_pylist(), strict=True)]
            new = [pa.array([len(d) for d in held], pa.int64()), pa.array(ends, pa.int64()), pa.array(chars, pa.int64()), pa.array(np.array(trailing, np.int64))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "h1", "h2", "at")), *new], names=["key", "h1", "h2", "at", "size", "ends", "chars", "trailing"])

    sent = docs.select(F.col("__fim_key").alias("key"), F.col("__fim_h1").alias("h1"), F.col("__fim_h2").alias("h2"), F.col("__fim_text").alias("text")).mapInArrow(chunks, "key string, h1 long, h2 long, at long, last boolean, dealt long, data binary")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = sent.repartition(n_parts, "key", "at", "dealt").mapInArrow(count, "key string, h1 long, h2 long, at long, size long, ends long, chars long, trailing long")
    once = counted.groupBy("key", "at").agg(*(F.max(c).alias(c) for c in ("h1", "h2", "size", "ends", "chars", "trailing")))
    own = Window.partitionBy("key")
    upto = own.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = once.withColumns({"upto": F.sum("ends").over(upto), "chars_upto": F.sum("chars").over(upto), "n": F.sum(F.col("ends") + F.col("trailing")).over(own)})
    sums = sums.withColumns({"low": F.least(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)), "high": F.greatest(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1))})
    owns = lambda rank: (F.col(rank) > F.col("upto") - F.col("ends")) & (F.col(rank) <= F.col("upto"))
    owner = lambda rank: F.max(F.when(owns(rank), F.struct("at", "size", (F.col("chars_upto") - F.col("chars")).alias("before"), (F.col(rank) - F.col("upto") + F.col("ends")).alias("rank"))))
    routed = sums.groupBy(F.col("key").alias("__fim_key")).agg(F.max("n").alias("__fim_n"), F.max("low").alias("__fim_low"), F.max("high").alias("__fim_high"), F.sum("chars").alias("__fim_chars"), owner("low").alias("__fim_low_at"), owner("high").alias("__fim_high_at"))
    schema = T.StructType([*docs.drop("__fim_key").schema.fields, *(T.StructField(c, T.LongType()) for c in ("__fim_n", "__fim_low", "__fim_high"))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = []
            for rank, owned in (("__fim_low", "__fim_low_at"), ("__fim_high", "__fim_high_at")):
                found = []
                for r, chars, o, text in zip(*(batch.column(c).to_pylist() for c in (rank, "__fim_chars", owned)), batch.column("__fim_text").cast(pa.binary()), strict=True):
                    if o is None:
                        found.append(0 if r == 0 else chars)
                        continue
                    held = np.frombuffer(text.as_buffer(), np.uint8)[o["at"] : o["at"] + o["size"]]
                    held = held if len(held) == o["size"] else np.append(held, np.uint8(0x20))
                    found.append(o["before"] + place(held, o["rank"])[1])
                cuts.append(pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-3]), batch.column("__fim_n"), *cuts], names=schema.names)

    return docs.join(routed, "__fim_key").drop("__fim_key").mapInArrow(find, schema)


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, chunk: int = CHUNK, near: int = NEAR) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output.

    Cuts and forms follow from the SHA-256 of ``seed:doc_id`` and the text's tokens alone, so equal rows come out alike. A
    null text is an empty one; empty texts and such as contain a sentinel stay plain, whose output is the text and whose
    lengths are null. A null doc_id is the empty string in the hash. Texts of more than ``near`` chunks have their chunks
    dealt over tasks. Input columns named like the new ones get _in behind their names (or more of it, where that is taken).
    An empty table gives an empty table.
    """
    docs = set_aside(docs, *COLUMNS)
    text = F.coalesce("text", F.lit(""))
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    group = lambda k: F.conv(F.substring(h, 8 * k - 7, 8), 16, 10).cast("long")
    plain = (text == "") | (group(3) % 100 >= rate)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(text, F.lit(mark))
    form = F.when(plain, F.lit("plain")).when(group(4) % 100 < spm_rate, F.lit("spm")).otherwise(F.lit("psm"))
    given = docs.columns
    ready = docs.select("*", text.alias("__fim_text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__fim_id"), group(1).alias("__fim_h1"), group(2).alias("__fim_h2"), form.alias("form")).withColumn("__fim_cut", F.col("form") != "plain").drop("text")
    size = F.octet_length("__fim_text")
    cut = _near(ready.where(size <= chunk * near), chunk).unionByName(_far(ready.where(size > chunk * near), chunk))
    whole, low, high = F.col("__fim_text"), F.col("__fim_low").cast("int"), F.col("__fim_high").cast("int")
    prefix, middle, suffix = F.substring(whole, F.lit(1), low), F.substring(whole, low + 1, high - low), F.substring(whole, high + 1, F.char_length(whole))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    cut_only = lambda c: F.when(F.col("__fim_cut"), c)
    return cut.select(
        *(F.col(f"`{c}`") if c != "text" else whole.alias("text") for c in given),
        F.col("__fim_n").alias("n"),
        "form",
        cut_only(F.col("__fim_low")).alias("prefix_chars"),
        cut_only(F.col("__fim_high") - F.col("__fim_low")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(whole).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made of, from the output and its form alone."""
    between = lambda a, b: F.substring(output, F.instr(output, a) + 3, F.instr(output, b) - F.instr(output, a) - 3)
    middle = F.substring(output, F.instr(output, MIDDLE) + 3, F.char_length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

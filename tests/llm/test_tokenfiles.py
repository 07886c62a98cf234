"""Token files: codes, checkpoints, reading of ranges, and whole documents against the library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import bpe, huffman, queries, tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=0, max_size=300), st.integers(9, 20))
def test_codes_are_complete_and_bounded(counts, longest):
    lengths = huffman.code_lengths(np.array(counts, np.int64), longest).astype(int)
    used = lengths[lengths > 0]
    assert [x > 0 for x in lengths] == [c > 0 for c in counts] and max(used, default=0) <= longest
    assert len(used) < 2 or sum(2.0**-x for x in used) == 1


def plain_huffman(counts):
    import heapq

    heap, total = sorted(c for c in counts if c), 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    return total


def test_codes_are_as_short_as_huffmans():
    rng = random.Random(1)
    for _ in range(20):
        counts = np.array([int(rng.paretovariate(0.7)) for _ in range(rng.randrange(2, 400))])
        lengths = huffman.code_lengths(counts, 24).astype(int)
        assert (lengths * counts).sum() == plain_huffman(counts.tolist())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 1000), st.integers(0, 2**32 - 1))
def test_streams_come_back(n_symbols, n, seed):
    rng = np.random.default_rng(seed)
    counts = np.floor(rng.pareto(0.6, n_symbols) + 1).clip(max=1e12).astype(np.int64)
    code = huffman.Code.of(huffman.code_lengths(counts, 12))
    ids = rng.integers(0, n_symbols, n)
    bits, starts = huffman.encode(ids, code)
    sizes = np.array([min(huffman.RUN, n - k) for k in range(0, n, huffman.RUN)], np.int64)
    assert huffman.decode(np.frombuffer(bits, np.uint8), starts, sizes, code).tolist() == ids.tolist()
    assert len(bits) == -(-int(code.lengths[ids].sum()) // 8)


def test_spans_give_the_ids_of_whole_texts(library):
    rng = random.Random(2)
    some = ["a", "b", "Zed", "'s", "'ll", "'", " ", "   ", "\n", "\t", "\x0b", "\x1c", "\x7f", "\x85", "\xa0", " ", "　", "​", "᠎", "é", "×", "日", "7", "12", "<|endoftext|>", "<|", "|>", ".", "’", "…"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(5000)] + [None, "", "x" * 5000, " " * 5000, "word " * 3000]
    ids, offsets = bpe.encode(pa.array(texts), PATH)
    assert all(ids[a:b].tolist() == library.encode(t or "", add_special_tokens=False).ids for t, a, b in zip(texts, offsets, offsets[1:], strict=False))


def plain(library, rows):
    """(doc_id, n, crc) by document."""
    out = []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


def test_documents_of_any_kind(spark, odd, odd_rows, library):
    path = tokenfiles.write_tokens(odd, PATH, file_ids=1 << 12)
    got = sorted(tokenfiles.digests(spark, path).collect(), key=lambda r: r.start)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((key((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)) == sorted(map(key, plain(library, [r[:2] for r in odd_rows])))
    assert [(r.doc_id is None, r.doc_id or 0) for r in got] == sorted((r.doc_id is None, r.doc_id or 0) for r in got)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()][:-1]
    assert spark.read.parquet(f"{path}/files").count() > 1
    whole = [i for r in sorted(tokenfiles.read_documents(spark, path).collect(), key=lambda r: r.start) for i in r.ids]
    for first, count in ((0, 5), (1000, 3000), (len(whole) - 7, 100), (127, 2)):
        found = sorted(tokenfiles.read_range(spark, path, first, count).collect(), key=lambda r: r.start)
        assert [i for r in found for i in r.ids] == whole[first : first + count] and found[0].start == first


def test_no_documents(spark, nothing):
    path = tokenfiles.write_tokens(nothing, PATH)
    assert tokenfiles.digests(spark, path).count() == 0 and tokenfiles.read_documents(spark, path).count() == 0 and tokenfiles.read_range(spark, path, 0, 5).count() == 0


def test_a_text_of_ten_megabytes(spark, library):
    """Its pieces lie in many blocks, among equal long ones."""
    rng = random.Random(3)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "straße", "日本"]) for _ in range(1_700_000))
    rows = [(5, text), (5, text), (1, "short"), (9, text[:900_000]), (None, "")]
    path = tokenfiles.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH)
    got = [(r.doc_id, r.n_tokens, r.ids_crc32) for r in sorted(tokenfiles.digests(spark, path).collect(), key=lambda r: r.start)]
    assert got == sorted(plain(library, rows), key=lambda r: (r[0] is None, r[0] or 0)) and spark.read.parquet(f"{path}/blocks").count() > 20


def test_query(spark, sf, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = sorted(queries.QUERIES["op11_token_files"](spark, sf).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == plain(library, rows) and got[0].start == 0


def test_workers_keep_no_spans_after_the_texts_are_encoded(spark):
    """A worker lives on, and what it kept for encoding would stand beside all that later stages need."""
    from gridloom.llm import bpe

    docs = spark.createDataFrame([(k, f"one two three {k}") for k in range(40)], "doc_id long, text string").repartition(4)
    path = tokenfiles.write_tokens(docs, PATH)
    tokenfiles.digests(spark, path).collect()

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bpe.load.cache_info().currsize] * batch.num_rows, pa.int64())], names=["n"])

    assert {r.n for r in spark.range(64).repartition(4).mapInArrow(held, "n long").collect()} == {0}

"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chat, infill, licenses, mixing, quality, sharding, tokenfiles, vectorcodes
from gridloom.llm.lines import dedup_lines
from gridloom.llm.sentencepieces import encode_documents
from gridloom.llm.simhash import near_duplicates
from gridloom.llm.storage import stage
from gridloom.llm.substrings import remove_repeats
from gridloom.llm.topk import top_k


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each 20th vector among all others. Null vectors, empty ones and those with a null or non-finite component take no part; rows that share a vec_id count each, a null vec_id is no query; an empty table gives no rows."""
    return top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, once=False)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, read back and digested. Null roles and texts are empty; rows of one turn come in the order of their texts, a null turn first; repeated rows are turns of their own."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(turns.unionByName(chat.probe_conversation(spark))))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents. Null and empty texts have no words and fail; each of repeated rows is judged alone; without labels the base rules decide."""
    docs = _read(spark, sf_dir, "documents")
    forest = quality.fit(docs, _read(spark, sf_dir, "labels"))
    return quality.judge(docs, forest)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and their round trip. A null text is an empty one; each of repeated rows has a row."""
    return encode_documents(_read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. Null and empty texts have no words and are not taken; a null source is a source, the last; equal rows are taken each on its own."""
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases in all documents. A null text is an empty one, with score 0; each of repeated rows has a row."""
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight written shards, read back. A null text is no bytes; null doc_ids and equal rows are records of their own."""
    text = F.coalesce("text", F.lit(""))
    return sharding.shard_documents(_read(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(sharding.LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that stay of all documents. Null texts have none; rows of one doc_id come in the order of their texts, null doc_ids last; of equal rows the first keeps its words."""
    kept = remove_repeats(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and classes of all documents. Texts without words, null ones too, have fingerprint zero and are one class; each of repeated rows has a row; a null doc_id is no class's least where there is another."""
    found = near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stay of all documents, short exact repeats removed as well. Null texts have no lines; rows of one doc_id come in the order of their texts, null doc_ids last; of equal rows the first keeps its lines."""
    kept = dedup_lines(_read(spark, sf_dir, "documents"), short_repeats=True)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as token files and read back. A null text is an empty one (the end id alone), rows of one doc_id are documents of their own, a null doc_id comes last; other columns are not read."""
    path = tokenfiles.write_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.digests(spark, path)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in fill-in-middle form, and the texts rebuilt from it, as digests. A null text is an empty one and stays plain, equal rows come out alike, a null doc_id hashes as no digits; other columns are not read."""
    made = infill.fill_in_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, with the error of each label's vectors together. Null or non-finite vectors are left out; null labels are one label; rows of one vec_id, or of none, are vectors of their own."""
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    books = vectorcodes.fit(vectors)
    coded = stage(vectorcodes.encode(vectors, books), "codes")
    per_label = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_chat": op2_chat,
    "op3_quality": op3_quality,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_mixing": op5_mixing,
    "op6_licenses": op6_licenses,
    "op7_sharding": op7_sharding,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_simhash": op9_simhash,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_files": op11_token_files,
    "op12_infill": op12_infill,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}



def _codes_sql(rounds: int = 6) -> str:
    """The rounds of op13 one after the other: distances to all entries, the first of the nearest, means rounded down."""
    part = lambda e: f"list_slice({e}, k * len({e}) // 8 + 1, (k + 1) * len({e}) // 8)"
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT row, k::INTEGER AS k, {part('e')} AS x FROM v, range(8) r(k))",
        "b0 AS MATERIALIZED (SELECT k, (row - 1)::INTEGER AS i, x AS c FROM p WHERE row <= 16)",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS MATERIALIZED (SELECT row, k, i, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{r} USING (k))")
        steps.append(f"a{r} AS MATERIALIZED (SELECT row, k, min(d) AS d, arg_min(i, d::HUGEINT * 16 + i) AS i FROM d{r} GROUP BY 1, 2)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT k, i, j, floor(sum(x[j]) / count(*)::DOUBLE)::BIGINT AS m FROM (SELECT k, i, x, unnest(range(1, len(x) + 1)) AS j FROM a{r} JOIN p USING (row, k)) GROUP BY 1, 2, 3)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT k, i, coalesce(n.c, b{r}.c) AS c FROM b{r} LEFT JOIN (SELECT k, i, list(m ORDER BY j) AS c FROM m{r} GROUP BY 1, 2) n USING (k, i))")
    steps.append(f"o AS (SELECT row, string_agg(format('{{:02x}}', i), '' ORDER BY k) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, i)) AS codebooks_sha256 FROM b{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN o USING (row), h"


_SPLIT = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

ORACLES: dict[str, str] = {
    "op1_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20""",
    "op2_chat": """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, t, r, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(t, r)),
e AS (SELECT *, replace(replace(replace(text, '\\', '\\\\'), '</turn>', '\\e'), '### ', '\\h') AS shown FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(length(role) + length(shown) + 14)::BIGINT AS formatted_chars, false AS rewritten FROM e GROUP BY 1""",
    "op6_licenses": licenses.oracle(),
    "op8_substring_dedup": f"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS row, doc_id, {_SPLIT} AS ws FROM documents), w AS (SELECT row, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
k AS (SELECT row, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS sequence FROM (SELECT row, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
f AS (SELECT row, i, row_number() OVER (PARTITION BY sequence ORDER BY row, i) > 1 AS again FROM k),
g AS (SELECT w.row, w.i, w.word, coalesce(max(again::INTEGER) OVER (PARTITION BY w.row ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone FROM w LEFT JOIN f ON f.row = w.row AND f.i = w.i),
r AS (SELECT row, sum(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (row)""",
    "op12_infill": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
s AS (SELECT *, array_to_string(w[1:low], '') AS p, array_to_string(w[low + 1:high], '') AS m, array_to_string(w[high + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM s""",
    "op13_vector_codes": _codes_sql(),
}

"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir) and return a DataFrame. All but the last return the columns of documents; n_chars is
that of the text as the stage leaves it. Every stage takes any rows: nulls in any column, empty and very long texts,
repeated rows and rows of one doc_id; what becomes of them is said at each. A table without rows stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import mixing, quality
from gridloom.llm.lines import dedup_lines
from gridloom.llm.sentencepieces import encode_documents
from gridloom.llm.similar import drop_similar
from gridloom.llm.storage import discard, new_path, set_aside, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed limits or the calibrated forest reject go.

    Null, empty and short texts have too few words and go. Rows are judged one by one, so repeated rows and ties go or
    stay alike; a null doc_id has no label but is judged like others. Without labels the fixed limits alone decide.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines near an earlier line go; a document that loses all of its lines stays, with an empty text.

    Null texts stay null and empty ones empty. Earlier is by doc_id, null last, then by text; of equal rows one counts as
    the earlier, so the others lose their lines. n_chars changes where lines went, and stays as it was, null too, elsewhere.
    """
    changed = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    aside = set_aside(docs, "n_lines", "n_removed").columns  # columns of these names, which the operator's own would hide
    return dedup_lines(docs).select(*(changed.alias(c) if c == "n_chars" else F.col(f"`{held}`").alias(c) for c, held in zip(docs.columns, aside, strict=True)))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, Jaccard similarity of 0.8 or more) the document of the smallest doc_id stays.

    Texts without words, null ones too, are one class. Of equal rows, and of rows of one doc_id that are alike, one stays;
    a row without a doc_id stays only where its class has no other.
    """
    return drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times.

    A null source is a source of its own, the last. Documents without words are not taken. Equal rows are taken each on its own.
    """
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each row: doc_id, n_tokens, n_chunks, token_ids, round_trip. A null text is an empty one, without ids; equal rows and null doc_ids keep a row each."""
    return encode_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", tokenize),
]

# An isolation forest, edit distances, fingerprint classes and tokenizers are not for SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; what each leaves is written to the session's shared folder, and deleted when the next has been written."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES[:-1]:
        before, path = path, new_path(spark, name.replace(" ", "-"))
        docs = stage(function(spark, docs, sf_dir), name, path)
        if before is not None:
            discard(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The pipeline's stages on odd rows and on none."""

from collections import Counter

import corpus_pipeline
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd_documents(spark, odd_rows, tmp_path_factory):
    """A folder with odd documents, and labels with nulls and ties."""
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([r[:5] for r in odd_rows] * 2, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (9, None, None), (20, 1, 0), (20, 1, 0), (10**6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_each_stage_takes_odd_rows(spark, odd_documents):
    docs = spark.read.parquet(f"{odd_documents}/documents.parquet")
    want = Counter((r.doc_id, r.text) for r in docs.collect())
    for name, function in corpus_pipeline.STAGES[:-1]:
        got = function(spark, docs, odd_documents)
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        rows = got.collect()
        if name != "line dedup":
            assert not Counter((r.doc_id, r.text) for r in rows) - Counter({k: 3 * n for k, n in want.items()})
        else:
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
            assert sum(r.text is None for r in rows) == sum(n for (_, t), n in want.items() if t is None)
    tokens = corpus_pipeline.tokenize(spark, docs, odd_documents).collect()
    assert len(tokens) == sum(want.values()) and sum(r.doc_id is None for r in tokens) == sum(n for (i, _), n in want.items() if i is None)


def test_run_takes_odd_rows(spark, odd_documents):
    assert corpus_pipeline.run(spark, odd_documents).count() > 0


def test_run_of_nothing(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs, str(tmp_path)).count() == 0


CLASHING = ["n_lines", "n_removed", "N_words", "fp", "size", "taken", "kept", "part", "bucket", "row", "set_id", "grp", "shard", "slot", "chunk", "ids", "score", "base_failed", "root", "class"]


def test_columns_of_any_name_come_through(spark, odd_documents):
    """Extra columns named like the operators' own keep their values in every stage but the last."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{odd_documents}/documents.parquet").withColumns({c: F.lit(700 + k).cast("long") for k, c in enumerate(CLASHING)})
    for name, function in corpus_pipeline.STAGES[:-1]:
        got = function(spark, docs, odd_documents)
        assert got.columns == docs.columns, name
        assert got.select(*CLASHING).distinct().collect() == [tuple(700 + k for k in range(len(CLASHING)))], name

"""Every query of the library's own operators against DuckDB, and the contract of the entry module."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as driver
from gridloom.plans.all import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 4) + 0.0)
    return repr([plain(x) for x in v]) if isinstance(v, list | tuple) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    want = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[k]) for k in place) for r in want.fetchall())


def test_entry(spark):
    assert driver.entry(spark).columns == ["rank", "stim_id", "seg", "score"]
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_library_stands_without_the_training_data_operators(tmp_path):
    """Nothing but the entry module's guard knows of them."""
    root = os.path.dirname(os.path.abspath(driver.__file__))
    for item in os.listdir(root):
        if item not in ("corpus_pipeline.py", "gridloom", ".git"):
            os.symlink(os.path.join(root, item), tmp_path / item)
    (tmp_path / "gridloom").mkdir()
    for item in os.listdir(os.path.join(root, "gridloom")):
        if item not in ("llm", "__pycache__"):
            os.symlink(os.path.join(root, "gridloom", item), tmp_path / "gridloom" / item)
    (tmp_path / "__spark_entry__.py").unlink()
    with open(os.path.join(root, "__spark_entry__.py")) as f:
        (tmp_path / "__spark_entry__.py").write_text(f.read())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'fastest_segments' in q and not any(k.startswith('op') for k in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_streamed_cuts_are_those_of_the_batch(spark, sf):
    both = [sorted((r.stim_id, r.t) for r in QUERIES[q](spark, sf).collect()) for q in ("cut_detect", "stream_cuts")]
    assert both[0] == both[1]


@pytest.mark.parametrize("missing", ["sentencepiece", "xxhash"])
def test_library_stands_without_what_the_training_data_operators_need(missing):
    code = f"import sys; sys.modules['{missing}'] = None; import __spark_entry__ as e; q = e.queries(); assert 'fastest_segments' in q and not any(k.startswith('op') for k in q)"
    root = os.path.dirname(os.path.abspath(driver.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)

"""Every catalogue query against its SQL in DuckDB."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from corpusloom.plans import catalog, oracle

SQL = oracle.oracle_sql()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def duck(tiny):
    connection = duckdb.connect()
    for path in glob.glob(f"{tiny}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x.item() if hasattr(x, "item") else x) for x in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, tiny, name):
    got, want = catalog.QUERIES[name](spark, tiny).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_is_named():
    assert set(SQL) == set(catalog.queries())


@pytest.mark.parametrize("hidden", ["tiktoken", "corpus_pipeline", "corpusloom.llm"])
def test_entry_without_training_data(hidden):
    """Where the training-data queries can't be imported, all others are still there."""
    code = f"import sys; sys.modules['{hidden}'] = None; import __spark_entry__ as e; print(*e.queries(), *e.oracle_sql())"
    names = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert set(SQL) <= set(names) and not any(n.startswith("op1_") or n == "pipeline" for n in names)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())

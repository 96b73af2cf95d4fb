"""Every query of the engine against its SQL in DuckDB, over the smallest tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from quillstream import registry
from quillstream.session import TABLES

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the test tables are not here")


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return repr(round(float(x), 6) + 0.0)
    return str(x)


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, str(SF)).toPandas()
    if name in registry.ORACLE_SQL:
        want = duck.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_lists_what_there_is(spark):
    q = __spark_entry__.queries()
    assert set(registry.QUERIES) <= set(q) and set(__spark_entry__.oracle_sql()) <= set(q)
    assert __spark_entry__.entry(spark).count() > 0


def test_the_engine_imports_nothing_of_the_training_data_subpackage():
    for path in Path(registry.__file__).parent.rglob("*.py"):
        if "llm" not in path.relative_to(Path(registry.__file__).parent).parts:
            assert "quillstream.llm" not in path.read_text(), path

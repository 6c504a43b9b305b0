"""Every query with SQL gives DuckDB's rows at the smallest scale; the others give rows."""

import math

import duckdb
import pandas as pd
import pytest

from sparkweave import plans, registry  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(int(value)) if hasattr(value, "__int__") and not isinstance(value, str) else str(value)


def rows(frame):
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    found = registry.QUERIES[name](spark, DATA)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert {c: KINDS[t] for c, t in found.dtypes} == dict(zip(want.columns, map(str, want.types)))
    assert rows(found.toPandas()) == rows(want.df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_some_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_import_needs_no_session():
    import os
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql().keys() <= e.queries().keys()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)

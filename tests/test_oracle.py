"""Every query with SQL against DuckDB on the smallest tables; every other query must run."""

import collections
import math

import duckdb
import pandas as pd
import pytest
from conftest import DATA

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
SF = DATA / "sf0.001"


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, list):
        return tuple(map(plain, x))
    return x.isoformat() if hasattr(x, "isoformat") else x


def rows(df):
    df = df[sorted(df.columns)]
    return collections.Counter(tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(SF))
    assert len(set(got.columns)) == len(got.columns)
    pdf = got.toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(pdf.columns) == sorted(want.columns)
        assert rows(pdf) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0

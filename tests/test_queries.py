"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LIBRARY = [n for n in entry.QUERIES if n in entry.ORACLE_SQL]


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or (not isinstance(x, str) and pd.isna(x)):
            return ""
        if isinstance(x, float):
            return str(int(x)) if abs(x) < 1e15 and x == int(x) else repr(round(x, 6))
        return str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", LIBRARY)
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0

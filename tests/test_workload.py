"""Each registered query with SQL must give DuckDB's rows."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def plain(df):
    def one(v):
        return None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(repr([one(v) for v in row]) for row in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    found = entry.queries()[name](spark, SF_DIR).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert plain(found) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0

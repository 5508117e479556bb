"""Every query with an SQL twin gives the twin's rows, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        return round(float(v), 6) if isinstance(v, float) else str(v) if not isinstance(v, (int, bool)) else v

    return sorted(repr([plain(v) for v in r]) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_equals_sql(spark, db, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() == 200

"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

from marlstone import plans

DIR = os.environ.get("MARLSTONE_TEST_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
        return None
    return round(v, 6) if isinstance(v, float) else str(v) if not isinstance(v, (int, bool)) else v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, DIR).toPandas()
    want = duck.execute(plans.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs_without_sql(spark, name):
    assert plans.QUERIES[name](spark, DIR).toPandas() is not None

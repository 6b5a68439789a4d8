"""Every query that has SQL against DuckDB on the smallest tables; the others by what must hold."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from gridloom import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) + 0.0 if isinstance(x, float) else x


def rows(frame, columns):
    return sorted((tuple(plain(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(name, spark, sf, duck):
    got, want = registry.queries()[name](spark, sf).toPandas(), duck.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(name, spark, sf):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[0] == "raster_id"
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert os.path.exists(__spark_entry__.__file__)

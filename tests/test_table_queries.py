"""Every table query against DuckDB on the same files."""

import glob
import os

import duckdb
import pytest

from libraryloom.plans import library_queries, service_queries, table_queries
from libraryloom.plans.register import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(name, spark, sf, duck):
    assert QUERIES[name].__module__ in (library_queries.__name__, service_queries.__name__, table_queries.__name__)
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    rows = lambda d: sorted(map(tuple, d[columns].astype(str).values))
    assert rows(ours) == rows(theirs)

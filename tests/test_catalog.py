"""Every catalog query against DuckDB at the smallest scale."""

import math

import duckdb
import pytest

from prismspark.plans import registry
from prismspark.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in registry.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return (round(v, 6) + 0.0 if math.isfinite(v) else str(v)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, other, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = other.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert mine == theirs


def test_every_query_has_sql():
    assert set(QUERIES) <= set(registry.oracle_sql()) <= set(registry.queries())

"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from quillgraph.plans import registry

from .conftest import SMALL

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SMALL):
        c.sql(f"create view {name.split('.')[0]} as select * from '{SMALL}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b), a.compare(b).head() if len(a) == len(b) else (len(a), len(b))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

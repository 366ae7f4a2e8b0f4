"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from trafficjobs.plans import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


def rows(names, found):
    order = [names.index(c) for c in sorted(names)]
    return sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())

"""Every registered query with a SQL counterpart agrees with it at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, normalised

FOLDER = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def test_every_counterpart_has_a_query():
    assert set(SQL) <= set(queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = queries()[name](spark, FOLDER)
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    mine = normalised(df.columns, df.collect())
    assert mine == normalised(columns, result.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0

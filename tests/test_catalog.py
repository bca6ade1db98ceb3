"""Every query against its SQL twin on the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from assayframe.catalog import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = [p.stem for p in DATA.glob("*.parquet")] if DATA.exists() else []

pytestmark = pytest.mark.skipif(not TABLES, reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_the_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert bag(df.columns, map(tuple, df.collect())) == bag(columns, cursor.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(queries())
    assert set(QUERIES) == set(ORACLES)

"""Every registered query against its SQL twin on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from occuspan.plans.inputs import Tables
from occuspan.plans.queries import QUERIES

DATA = entry_points.SMALL_DATA
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
ORACLES = entry_points.oracle_sql()
WITHOUT_SQL = set()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    return con


@pytest.fixture(scope="module")
def tables(spark):
    """One set of tables for all queries, so that stages are written once."""
    return Tables(spark, DATA)


def test_names_match():
    named = set(entry_points.queries())
    assert set(QUERIES) <= named and set(ORACLES) <= named
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert len(rows) == 10 and rows[0]["turnover_count"] >= rows[-1]["turnover_count"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(tables, sql, name):
    df = QUERIES[name](tables)
    columns = sorted(df.columns)
    found = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    if name in WITHOUT_SQL:
        assert found
        return
    result = sql.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert found == sorted((tuple(row[i] for i in order) for row in result.fetchall()), key=repr)

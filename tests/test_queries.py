"""Every registered query against DuckDB on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from billweave.plans.oracle import oracle_queries
from billweave.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "date": "DATE", "boolean": "BOOLEAN"}

ORACLE = oracle_queries()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_same_result(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    expected = duck.sql(ORACLE[name])
    types = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    columns = sorted(df.columns)
    assert (sorted(repr(tuple(r)) for r in df.select(*columns).collect())
            == sorted(repr(r) for r in expected.select(*[f'"{c}"' for c in columns]).fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0

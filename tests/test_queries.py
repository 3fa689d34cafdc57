"""Every registered query against its SQL twin on the smallest given tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as contract
from rowloom.suite.registry import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return sorted(repr([plain(row[i]) for i in at]) for row in rows)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


ORACLES = contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    rows = df.collect()
    if name not in ORACLES:
        return
    twin = duck.sql(ORACLES[name])
    assert sorted(c.lower() for c in df.columns) == sorted(c.lower() for c in twin.columns)
    assert ordered(df.columns, rows) == ordered(twin.columns, twin.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0

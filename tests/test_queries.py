"""Every query with an oracle agrees with DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from quantspark.plans import oracles, store_oracles, store_queries
from quantspark.plans import queries as plans

QUERIES = plans.QUERIES | store_queries.QUERIES
SQL = oracles.SQL | store_oracles.SQL


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for file in os.listdir(sf):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf}/{file}'")
    return connection


def norm(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, datetime.datetime) and value.time() == datetime.time():
        return str(value.date())
    return round(float(value), 5) + 0.0 if isinstance(value, float) else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([norm(r[i]) for i in order]) for r in data)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())

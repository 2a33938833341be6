"""Every catalogue query with an oracle against DuckDB on the smallest tables, and that none is empty."""

import os

import duckdb
import pytest

from vellum.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def rows(columns, data):
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(plain(r[i])) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLES[name])
    columns, data = [c[0] for c in want.description], want.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert data and rows(got.columns, got.collect()) == rows(columns, data)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(QUERIES) <= set(__spark_entry__.queries())

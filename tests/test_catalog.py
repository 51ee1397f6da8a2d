"""Every query against its SQL on the small test tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from reviewmill.catalog.oracles import ORACLES
from reviewmill.catalog.queries import QUERIES
from reviewmill.sources.fixtures import TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def as_sorted(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(row[i]) for i in order) for row in data)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = as_sorted(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        columns = [c[0] for c in result.description]
        assert got == as_sorted(columns, result.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["company", "period", "mean", "trace_mean", "count"]
    assert df.count() > 0

"""Every named query against its SQL twin, on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
import oracles
from sensorloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.all_queries()
ORACLES = oracles.all_oracles()


@pytest.fixture(scope="module")
def engine():
    made = duckdb.connect()
    for name in os.listdir(SF):
        made.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return made


def content(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: repr(v + 0.0) if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(text(row[i]) for i in order) for row in rows)


def kind(name):
    """Types that the two engines name differently."""
    return {
        "bigint": "long",
        "long": "long",
        "varchar": "string",
        "timestamp_ntz": "timestamp",
        "int": "integer",
    }.get(name.lower(), name.lower())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in ORACLES:
        assert rows
        return
    expected = engine.sql(ORACLES[name])
    assert content(got.columns, rows) == content(expected.columns, expected.fetchall())
    types = {c: kind(str(t)) for c, t in zip(expected.columns, expected.types)}
    assert {c: kind(t) for c, t in got.dtypes} == types


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship_query(spark):
    assert entry_points.entry(spark).count() == 10


def test_all_queries_are_registered():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql())

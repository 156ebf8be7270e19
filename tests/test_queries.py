"""All registered queries against their SQL forms on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry
from check import TABLES, compare
from corpusdetect.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
# Slices so narrow that the smallest tables have no row in them.
NARROW = {"roc_curve_by_corpus": "/root/testdata/sf0.01"}


def _connect(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def con():
    return _connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    folder = NARROW.get(name, FOLDER)
    verdict, _ = compare(spark, con if folder == FOLDER else _connect(folder), name, folder)
    assert verdict.startswith("ok"), verdict


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).count() > 0

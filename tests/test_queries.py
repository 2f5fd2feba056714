"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as driver
from herdlens.plans.catalog import QUERIES
from tests.support import mismatch, register_tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    register_tables(connection, FOLDER)
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    got = driver.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(driver.oracle_sql()[name]).df()
    assert mismatch(got, want) is None


def test_every_query_has_sql():
    assert set(QUERIES) <= set(driver.queries())
    assert set(QUERIES) <= set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() == 3

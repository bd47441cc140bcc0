"""Every registered query against its reference SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from workload.compare import database, spark_rows, sql_rows
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    columns, got = spark_rows(entry.queries()[name](spark, SF))
    assert (columns, got) == sql_rows(db, entry.oracle_sql()[name])


def test_own_queries_have_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

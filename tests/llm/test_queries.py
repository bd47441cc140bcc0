"""Queries with SQL against it; all operators and the pipeline are registered."""

import pytest

import __spark_entry__ as entry
from parcelflow.llm.queries import ORACLES
from workload.compare import database, spark_rows, sql_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert spark_rows(entry.queries()[name](spark, SF)) == sql_rows(database(SF), ORACLES[name])


def test_all_are_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert any(q.startswith(f"op{n}_") for q in names)
    assert "pipeline" in names and set(ORACLES) <= set(entry.oracle_sql())

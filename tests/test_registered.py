"""Every registered query against DuckDB on the smallest tables, and its plan for what must not be there."""

import pytest

import __spark_entry__ as contract
from workload import oracles
from workload import queries as registered
from workload.compare import difference, duckdb_tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duckdb_tables(SF_DIR)


def test_every_query_has_sql():
    assert set(registered.build()) == set(oracles.build())


@pytest.mark.parametrize("name", sorted(registered.build()))
def test_equals_duckdb(spark, connection, name):
    df = contract.queries()[name](spark, SF_DIR)
    assert difference(df, connection, contract.oracle_sql()[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("Python", "Cartesian", "BroadcastNestedLoop", "ArrowEval"):
        assert bad not in plan


def test_entry(spark):
    assert contract.entry(spark).columns == ["journey", "conversion_flg", "counts"]
    assert contract.entry(spark).count() > 0

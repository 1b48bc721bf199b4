"""Every registered query gives the rows of its SQL on DuckDB."""

import pytest
from oracle import compare, connect

import __spark_entry__ as driver
from corpusaudit.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(name, spark, sf_dir, connection):
    assert compare(QUERIES[name](spark, sf_dir), connection, ORACLES[name]) is None


def test_entry(spark):
    assert driver.entry(spark).count() == 10
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_plans_have_no_pairing_joins(spark, sf_dir):
    for name, query in QUERIES.items():
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
        assert "BatchEvalPython" not in plan, name

"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as driver

QUERIES = driver.queries()
ORACLES = driver.oracle_sql()


@pytest.fixture(scope="module")
def database(data):
    return oracle.database(data)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, data, database, name):
    frame = QUERIES[name](spark, data)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert oracle.difference(frame, database, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    frame = driver.entry(spark)
    assert frame.columns == ["published", "headline", "theme", "facebook_interactions", "link"]
    assert frame.count() > 0

"""Every registered query against its SQL; queries without SQL must at least run and give rows."""

import pytest

from loadspark.catalog import ORACLES, QUERIES
from loadspark.catalog.check import compare, connect

# Fitted for minutes on any size; their parts are tested in test_models and test_capacity.
SLOW = {"random_search", "gbt_importance", "production_errors", "capacity", "featured_table", "prepared_baselines"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    ok, note = compare(spark, con, QUERIES[name], ORACLES[name], sf)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


CHEAP_PLANS = sorted(set(ORACLES) - {"ridge_cv", "standardise", "isotonic_daily"})


@pytest.mark.parametrize("name", CHEAP_PLANS)
def test_no_cross_joins(spark, sf, name):
    text = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text

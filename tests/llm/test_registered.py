"""Every registered query of the folder: its SQL where there is one, else that it runs over its whole table."""

import pytest

from loadspark.catalog.check import compare, connect
from loadspark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    ok, note = compare(spark, connect(sf), QUERIES[name], ORACLES[name], sf)
    assert ok, note


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))


NATIVE = ("op2_secret_scan", "op5_sharding", "op6_license_scan", "op7_quality_rules")


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, sf, name):
    if name in ("op3_vector_dedup", "op9_repeated_text", "op4_near_dedup", "op1_quality_classifier"):
        pytest.skip("run in full by the tests of their modules")
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

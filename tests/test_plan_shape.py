"""Physical-plan guards: pruned scans, few shuffles (cross products: test_oracle)."""

import re

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def test_flagship_scans_are_pruned_and_shuffles_few(spark):
    df = E.queries()["linear_embedding"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    li = [s for s in schemas if "l_orderkey" in s]
    assert li and "l_shipdate" not in li[0] and "l_partkey" not in li[0]
    orders = [s for s in schemas if "o_orderkey" in s]
    assert orders and "o_totalprice" not in orders[0]
    # joins (household + region lookup), one aggregation shuffle, one small window shuffle
    assert plan.count("Exchange hashpartitioning") <= 5
    assert "Generate inline" in plan
    # the aggregation shuffle is keyed by region *and* feature/level, so a hot
    # region is spread over reducers (and pre-aggregated map-side)
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert any("region" in k and "feature" in k and "level" in k for k in keys)
    assert "partial_sum" in plan

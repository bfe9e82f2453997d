"""Plan shape of every registered query: no cartesian products, no nested-
loop joins, no Python evaluation, and column pruning at the scans."""

import re

from parcelry.plans.catalog import catalog
from tests.conftest import SF_SMALL

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "MapInArrow", "FlatMapGroupsInArrow", "FlatMapCoGroupsInArrow"]


def test_plans_have_no_forbidden_operators(spark):
    bad = {}
    for name, fn in catalog().items():
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        hits = [op for op in FORBIDDEN if op in plan]
        if hits:
            bad[name] = hits
    assert not bad


def test_scans_read_only_needed_columns(spark):
    """The flagship never reads lineitem's unused columns (quantity, tax, flags, dates)."""
    plan = catalog()["order_documents"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    li = [s for s in schemas if "l_orderkey" in s]
    assert li and all("l_tax" not in s and "l_quantity" not in s and "l_shipdate" not in s for s in li)

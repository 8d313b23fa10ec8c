"""Shares of tasks of the queries that go through line items by order."""

import pytest

from loomspan.plans import documents, routing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", [documents.chart_pivot, documents.stitched_tables, routing.routing_segments, routing.mixed_plan])
def test_rows_are_shuffled_once_over_many_tasks(spark, query):
    plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Join" not in plan

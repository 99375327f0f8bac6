"""What a task holds of orders, parts and line items does not grow with them."""

from __future__ import annotations

import pytest

from tracewright.functions import dealing
from tracewright.plans import queries


@pytest.mark.parametrize("name", ["file_change_stats", "hotspots"])
def test_no_table_is_broadcast_to_dealt_tasks(spark, data, monkeypatch, name):
    """But the one row of maxima."""
    monkeypatch.setattr(dealing, "ROWS", 500)  # 6,000 line items: 12 tasks
    plan = getattr(queries, name)(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_a_task_has_few_rows(spark):
    assert dealing.tasks_for(spark, 36_000_000) >= 270

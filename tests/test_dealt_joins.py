"""No join deals rows over fewer tasks than they are dealt over."""

from __future__ import annotations

import re

import pytest

from tracewright.functions import dealing
from tracewright.plans import facts, queries


@pytest.mark.parametrize("name", ["co_change_pairs_parts", "architecture", "hotspots", "file_change_stats", "module_candidates", "module_evidence", "pair_evidence"])
def test_joins_keep_the_number_of_tasks(spark, data, monkeypatch, name):
    """Spark plans the exchange of one side anew with the other's number of tasks (4 here), unless both are dealt."""
    monkeypatch.setattr(dealing, "ROWS", 500)  # 6,000 line items: 12 tasks
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = (getattr(queries, name, None) or getattr(facts, name))(spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(re.findall(r"hashpartitioning\(.*, (\d+)\), REPARTITION_BY_NUM", plan)) == {"12"}

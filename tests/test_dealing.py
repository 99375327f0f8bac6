"""Rows beyond a bound are dealt over more tasks; results stay what they were."""

from __future__ import annotations

import pytest

from tracewright.functions import dealing
from tracewright.operators import history, scoring
from tracewright.plans import facts, queries


def test_tasks_grow_with_the_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert dealing.tasks_for(spark, dealing.ROWS * cores) is None
    assert [dealing.tasks_for(spark, dealing.ROWS * n) for n in (10, 100, 1000)] == [10, 100, 1000]
    assert history.file_stats(spark.range(9).selectExpr("id % 3 path", "id churn"), tasks=7).rdd.getNumPartitions() == 7


@pytest.mark.parametrize("name", ["file_change_stats", "co_change_pairs", "impact_all", "pair_evidence", "module_evidence", "file_evidence"])
def test_dealt_rows_give_the_same(spark, data, monkeypatch, name):
    run = getattr(queries, name, None) or getattr(facts, name)
    want = sorted(map(tuple, run(spark, data).collect()))
    monkeypatch.setattr(dealing, "ROWS", 500)  # 6,000 line items: 12 tasks
    df = run(spark, data)
    assert sorted(map(tuple, df.collect())) == want and df.rdd.getNumPartitions() == 12


def test_impact_passes_over_the_relations_once_for_both_ways(spark):
    rel = spark.range(8).selectExpr("cast(id as string) source", "cast(id * 3 % 8 as string) target", "'co_change' kind", "0.5D weight")
    out = scoring.impact(rel)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") <= 2  # ranking and evidence
    assert {(r.selected_path, r.path, r.score) for r in out.where("selected_path in ('0', '1')").collect()} == {("0", "0", 0.5), ("1", "3", 0.95)}


def test_impact_of_one_path_shuffles_no_other_relations(spark, data):
    """The path is sought in the pairs before they are grouped, and not by a sort of all relations."""
    plan = queries.impact_selected(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan.replace("  ", " ") and plan.count(queries.SELECTED) > 2

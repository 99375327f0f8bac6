"""Every registered engine query against its SQL on the smallest tables; the shapes of the plans."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tracewright.plans import queries
from tracewright.plans.queries import QUERIES
from tracewright.plans.sql import SQL


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(r[i] for i in order) for r in values], key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    assert got
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.fetchall(), want.columns)
    counts = [c for c in df.columns if c in ("n_rows", "n_remaining")]
    assert all(r[df.columns.index(c)] for r in df.collect() for c in counts) if counts else True


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["hotspots", "co_change_pairs", "claim_assessment", "impact_all", "grounded_answers"])
def test_no_nested_loops(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_citation_check_sees_the_whole_answer(spark, data, monkeypatch):
    answers = spark.createDataFrame([(2, "x" * 6000, [1]), (4, "x" * 6001, [1])], "query_id long, answer string, evidence array<long>")
    monkeypatch.setattr(queries, "grounded", lambda spark, d: answers)
    assert {r.conv_id: r.valid for r in queries.citation_check(spark, data).collect()} == {2: True, 4: False}

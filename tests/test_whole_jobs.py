"""Queries do the whole of their job: no page without its file, no change without its row."""

from __future__ import annotations

import datetime as dt

from tracewright.plans import driver_map as m
from tracewright.plans import facts
from tracewright.plans import queries


def test_every_page_is_a_file_and_links_resolve(spark, tmp_path):
    pages = [
        (1, "http://h.org/en/1", '<a href="/en">'), (2, "http://h.org/en/2?x=1", '<a href="/en"><a href="/nowhere">'),
        (3, "http://h.org/", ""), (4, "http://g.org/en/1/", '<a href="/a.css">'),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    files = {r.path for r in m.page_files(spark, str(tmp_path)).collect()}
    assert files == {"h.org/en~1", "h.org/en~2", "h.org/en.ts", "h.org/index.ts", "g.org/en~1", "g.org/en.ts"}
    edges = {(r.from_key, r.to_key) for r in queries.link_edges(spark, str(tmp_path)).collect()}
    assert edges == {("h.org/en~1", "h.org/en.ts"), ("h.org/en~2", "h.org/en.ts"), ("g.org/en~1", "asset:g.org/a.css")}
    assert {(r.kind, r.n) for r in queries.graph_summary(spark, str(tmp_path)).collect()} == {("FILE", 6), ("MODULE", 1)}
    assert {(r.path, r.n) for r in queries.link_diagnostics(spark, str(tmp_path)).collect()} == {("h.org/en~2", 1)}


def test_scoped_changes_are_all_there(spark, tmp_path):
    """Both scopes that the query has had lie within its own, and no newest changes are picked."""
    spark.createDataFrame([(1,)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(7, 1), (8, 2)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    day = dt.datetime(1994, 1, 1)
    orders = [(i, 7, "F", "1-URGENT", day + dt.timedelta(days=i)) for i in range(900)] + [(9999, 8, "F", "1-URGENT", day)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    got = facts.scoped_changes(spark, str(tmp_path)).collect()
    assert len(got) == 824 + 30 + 1 and {r.doc_id for r in got} == {f"change:{i}:1-URGENT" for i in range(855)}

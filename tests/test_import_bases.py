"""Import resolution normalises a path once for all of its candidates."""

from __future__ import annotations

from tracewright.operators import graph


def test_the_base_of_an_import_is_made_once(spark):
    imports = spark.createDataFrame([("a/b.ts", "../c/./d"), ("a/b.ts", "lib"), ("b.ts", "../up")], "path string, module string")
    out = graph.resolve(imports, spark.createDataFrame([("c/d/index.tsx",), ("c/d.js",)], "path string"))
    assert {(r.module, r.resolved, r.target_class) for r in out.collect()} == {("../c/./d", "c/d.js", "resolved"), ("lib", None, "external"), ("../up", None, "unresolved")}
    # A fold for each mention of the path's parts in a base, and no more for each candidate.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 12

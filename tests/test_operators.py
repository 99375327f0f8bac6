from __future__ import annotations

import datetime as dt
import itertools
import random
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracewright.operators import audit, governance, graph, history, retrieval, scoring, views

DAY = [dt.datetime(2024, 1, i + 1) for i in range(9)]


@pytest.fixture
def changes(spark):
    rows = [("c1", "app/a.ts", DAY[0], 10), ("c1", "app/b.ts", DAY[0], 10), ("c2", "app/a.ts", DAY[1], 6), ("c2", "app/b.ts", DAY[1], 6), ("c3", "app/a.ts", DAY[2], 0), ("c3", "app/a.ts", DAY[2], 0)]
    return spark.createDataFrame(rows, "commit string, path string, authored_at timestamp, commit_churn long")


def test_evolution(spark, changes):
    files = spark.createDataFrame([("app/a.ts",), ("app/b.ts",), ("app/new.ts",), ("README",)], "path string")
    out = history.evolution(changes, files)
    pair = out["co_changes"].collect()
    assert [(r.left_path, r.right_path, r.commit_count, round(r.confidence, 4), r.evidence) for r in pair] == [("app/a.ts", "app/b.ts", 2, 0.6667, ["c1", "c2"])]
    hot = {r.path: r for r in out["hotspots"].collect()}
    assert (hot["app/a.ts"].commit_count, hot["app/a.ts"].churn, round(hot["app/a.ts"].score, 4)) == (3, 5 + 3 + 1, 1.0)
    assert hot["app/a.ts"].evidence == ["c1", "c2", "c3"]
    mods = {r.module: r for r in out["modules"].collect()}
    assert mods["app"].confidence == 0.5 + 0.5 * 2 / 3 and mods["app"].evidence == ["c1", "c2", "c3"] and mods["app"].inferred
    assert mods["repository-root"].evidence == [] and mods["repository-root"].changed_files == 0
    assert mods["app"].description == "Inferred directory module containing 3 current files; 2 have observed commit evidence."


def test_partitioned_history_equals_single(spark, changes):
    two = changes.withColumn("repo", F.lit("x")).unionByName(changes.withColumn("repo", F.lit("y"))).repartition(8)
    st = history.file_stats(history.split_churn(two, ("repo",)), ("repo",))
    one = history.hotspots(history.file_stats(history.split_churn(changes)))
    for repo in "xy":
        got = history.hotspots(st, ("repo",)).where(F.col("repo") == repo).drop("repo")
        assert sorted(got.collect()) == sorted(one.collect())
    assert history.co_changes(two, ("repo",), max_files=1).count() == 0


def test_evidence_is_capped_and_distinct(spark):
    rows = [("p", f"c{i // 2:02d}", DAY[0]) for i in range(60)]
    df = spark.createDataFrame(rows, "path string, commit string, authored_at timestamp")
    got = history.first_evidence(df, ["path"], "commit", [F.col("authored_at"), F.col("commit")]).first()
    assert got.evidence == [f"c{i:02d}" for i in range(20)]


def test_risk_without_commits_is_zero(spark):
    df = spark.createDataFrame([("a", 0, 0, 0.0)], "path string, commit_count long, churn long, score double")
    row = scoring.risk(df).first()
    assert row.score == 0 and row.rationale == "Relative risk combines hotspot (0.00), change frequency (0.00), and churn (0.00)."


def test_impact(spark):
    rel = spark.createDataFrame([("a", "b", "co_change", 0.5), ("b", "a", "imports", 1.0), ("a", "a", "imports", 0.2), ("c", "a", "co_change", 0.5)], "source string, target string, kind string, weight double")
    got = {r.path: r for r in scoring.impact(rel, spark.createDataFrame([("a",)], "selected_path string")).collect()}
    assert got["b"].score == 1.0 and got["b"].reasons == ["imports (0.90)", "co change (0.50)"] and got["b"].rank == 1
    assert got["a"].score == 0.2 and got["c"].score == 0.45
    assert {r.selected_path for r in scoring.impact(rel).collect()} == {"a", "b", "c"}


def test_evaluate(spark):
    df = spark.createDataFrame([(0.9, 1), (0.1, 0), (None, 1)], "score double, label int")
    row = scoring.evaluate(df).first()
    assert round(row.model_brier, 6) == 0.01 and row.constant_brier == 0.25 and row.useful
    assert scoring.evaluate(df.limit(0)).first().useful is None


def test_retrieval(spark):
    mods = spark.createDataFrame([("auth", "login and session code")], "module string, description string")
    hot = spark.createDataFrame([("src/login.ts", 4)], "path string, commit_count long")
    commits = spark.createDataFrame([("c1", "add login", DAY[0]), ("c2", "fix build", DAY[1])], "commit string, message string, authored_at timestamp_ntz")
    docs = retrieval.retrieval_documents(mods, hot, commits)
    asked = spark.createDataFrame([("q1", "where is the login session"), ("q2", "latest changes?"), ("q3", "zebra"), ("q4", None)], "query_id string, text string")
    got = {r.query_id: r for r in retrieval.answers(asked, docs).collect()}
    assert got["q1"].evidence[0] == "module:auth" and got["q1"].answer.startswith("Relevant repository evidence: Module auth: login")
    assert got["q2"].evidence == ["commit:c2", "commit:c1"]
    assert got["q3"].evidence == [] and got["q4"].answer.startswith("Insufficient")
    plan = retrieval.overlaps(asked, docs)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_citations(spark):
    rows = [("a", ["x", "x"], ["x", "y"]), ("b", ["z"], ["x"]), ("c", [], ["x"]), (" ", ["x"], ["x"])]
    df = spark.createDataFrame(rows, "answer string, cited array<string>, allowed array<string>")
    assert [(r.n_cited, r.valid) for r in retrieval.check_citations(df).collect()] == [(1, True), (1, False), (0, False), (1, False)]


def test_audit_from_report_to_markdown(spark):
    text = "Added login form validation.\nAll tests passing.\nDeployed to production."
    reports = spark.createDataFrame([("r1", text), ("r2", "  "), ("r3", None), ("r4", "x" * 100_001)], "report_id string, text string")
    claims, rejected = audit.split_reports(reports)
    assert claims.count() == 3 and {r.report_id for r in rejected.collect()} == {"r2", "r3", "r4"}
    ch = spark.createDataFrame([("R", "c1", "src/login.ts", DAY[3], 8), ("R", "c1", "src/login.ts", DAY[3], 8), ("R", "c2", "docs/x.md", DAY[4], 4), ("R", "c3", "late.ts", DAY[8], 50)], "repository_id string, commit string, path string, authored_at timestamp, churn long")
    scope = spark.createDataFrame([("r1", "R", DAY[3], DAY[5])], "report_id string, repository_id string, scope_from timestamp, scope_to timestamp")
    commits = spark.createDataFrame([("R", "c1", "added login form validation")], "repository_id string, commit string, message string")
    inside = audit.in_scope(ch, scope)
    assert {r.commit for r in inside.collect()} == {"c1", "c2"}
    cand = audit.candidates(inside, commits)
    assert cand.count() == 2 and cand.where("commit = 'c2'").first().text == "docs/x.md "
    q = claims.select("report_id", F.col("ordinal").alias("query_id"), F.col("claim").alias("text"), "claim_type")
    done = audit.assess(q, cand.select("report_id", "doc_id", "kind", "text"), ("report_id",))
    got = {r.query_id: r for r in done.collect()}
    assert (got[0].status, got[0].confidence, got[0].evidence) == ("VERIFIED", 1.0, ["change:c1:src/login.ts"])
    assert got[1].status == "EXTERNAL_EVIDENCE_REQUIRED" and got[2].evidence == [] and got[2].confidence == 1.0
    cited = done.select("report_id", F.explode("evidence").alias("doc_id")).join(cand.select("report_id", "doc_id", "path"), ["report_id", "doc_id"])
    un = audit.unreported(inside.dropDuplicates(["commit", "path"]), cited)
    row = un.first()
    assert (un.count(), row.path, row.materiality, row.evidence) == (1, "docs/x.md", 0.5, ["change:c2:docs/x.md"])
    seen = audit.view(claims, done.withColumnRenamed("query_id", "ordinal"))
    assert not seen.first().pending
    body = audit.report_markdown(seen, un).first().body
    assert "### 1. Added login form validation." in body and "Confidence: 1.00" in body and "- `docs/x.md` (0.50): Observed in 1 scoped commit(s) but not cited by a claim." in body
    open_ = audit.view(claims, done.withColumnRenamed("query_id", "ordinal").where("ordinal = 0"))
    assert open_.first().pending and "Status: PENDING\nConfidence: 0.00\nEvidence: none" in audit.report_markdown(open_, un.limit(0)).first().body


def test_ci_evidence_lets_tests_be_verified(spark):
    claims = spark.createDataFrame([(0, "login tests passing", "test")], "query_id int, text string, claim_type string")
    ev = spark.createDataFrame([("ci:1", "ci_run", "login tests passing")], "doc_id string, kind string, text string")
    assert audit.assess(claims, ev).first().status == "VERIFIED"


SPAN = "span struct<start_line:int,start_column:int,end_line:int,end_column:int>"
PART = "repository_id string, snapshot_id string"


def facts(spark):
    s = lambda n: (n, 0, n, 9)
    files = spark.createDataFrame([("R", "ab12", "app/page.tsx", "tsx", "h1"), ("R", "ab12", "lib/util.ts", "typescript", "h2")], f"{PART}, path string, language string, content_sha256 string")
    symbols = spark.createDataFrame([("R", "ab12", "lib/util.ts", "run", "function", True, s(1))], f"{PART}, path string, name string, kind string, exported boolean, {SPAN}")
    exports = spark.createDataFrame([("R", "ab12", "lib/util.ts", "run", s(1)), ("R", "ab12", "lib/util.ts", None, s(2))], f"{PART}, path string, local_name string, {SPAN}")
    imports = spark.createDataFrame([("R", "ab12", "app/page.tsx", m, s(i), i) for i, m in enumerate(["../lib/util", "react", "react", "./x.css", "./lost", "./user.service"])], f"{PART}, path string, module string, {SPAN}, ordinal int")
    diags = spark.createDataFrame([("R", "ab12", "app/page.tsx", "PARSE_ERROR", "bad", s(5))], f"{PART}, path string, code string, message string, {SPAN}")
    return files, symbols, exports, imports, diags


def test_structural_graph(spark):
    g = graph.structural_graph(*facts(spark))
    nodes = {(r.kind, r.natural_key): r for r in g["nodes"].collect()}
    assert set(nodes) == {("FILE", "app/page.tsx"), ("FILE", "lib/util.ts"), ("SYMBOL", "lib/util.ts#function:run:1:0"), ("MODULE", "external:react"), ("MODULE", "asset:app/x.css"), ("MODULE", "asset:app/user.service")}
    assert json.loads(nodes["FILE", "app/page.tsx"].properties)["parse_status"] == "PARTIAL"
    assert len(nodes["MODULE", "external:react"].evidence_ids) == 2
    edges = sorted((r.kind, r.evidence_id) for r in g["edges"].collect())
    assert [k for k, _ in edges] == ["DECLARES", "EXPORTS", "IMPORTS", "IMPORTS", "IMPORTS", "IMPORTS"]
    known = {r.evidence_id for r in g["evidence"].collect()}
    assert {e for _, e in edges} <= known and {e for n in nodes.values() for e in n.evidence_ids} <= known
    assert sorted(r.code for r in g["diagnostics"].collect()) == ["PARSE_ERROR", "UNRESOLVED_IMPORT"]
    again = graph.structural_graph(*(x.repartition(5) for x in facts(spark)))
    assert sorted(map(str, again["edges"].collect())) == sorted(map(str, g["edges"].collect()))


def test_node_evidence_is_bounded(spark):
    """A module with many importers: the first pieces of evidence equal those of the whole, cut before the module's rows meet."""
    files, symbols, exports, imports, diags = facts(spark)
    span = imports.schema["span"].dataType.simpleString()
    many = spark.range(30_000).selectExpr("'R' AS repository_id", "'ab12' AS snapshot_id", "concat('app/f', id % 10000, '.ts') AS path", "if(id % 3 = 0, 'left', 'react') AS module", f"cast(named_struct('a', id, 'b', 0, 'c', id, 'd', 9) AS {span}) AS span", "cast(id AS int) AS ordinal")
    parts = (files, symbols, exports, imports.unionByName(many), diags)
    whole, first = graph.structural_graph(*parts), graph.structural_graph(*parts, most_evidence=5)
    want = {r.node_id: r for r in whole["nodes"].collect()}
    got = {r.node_id: r for r in first["nodes"].collect()}
    assert set(got) == set(want) and all(got[k].properties == want[k].properties and got[k].evidence_ids == want[k].evidence_ids[:5] for k in want)
    n = {r.node_id: r["count"] for r in first["node_evidence"].groupBy("node_id").count().collect()}
    assert n == {k: len(r.evidence_ids) for k, r in want.items()} and max(n.values()) == 20_002
    plan = first["nodes"]._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan.split("WindowGroupLimit")[-1].split("\n")[0] and "collect_set" not in plan


def test_graph_input_is_checked(spark):
    bad = spark.createDataFrame([("R", "xyz", "a"), ("R", "ab", "b"), ("R", "ab", "b")], f"{PART}, path string")
    assert sorted(r.reason for r in graph.check_input(bad, ("repository_id", "snapshot_id"), "snapshot_id").collect()) == ["DUPLICATE_PATH", "SHA"]


def test_page_keeps_edges_inside(spark):
    nodes = spark.createDataFrame([("FILE", k) for k in "abcd"], "kind string, natural_key string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d")], "from_key string, to_key string")
    assert [(r.node_key, r.n_edges) for r in graph.page(nodes, edges, ("FILE", "a"), 2).orderBy("node_key").collect()] == [("b", 1), ("c", 0)]
    files = spark.createDataFrame([("a.ts", "import x from './b'")], "path string, text string")
    assert graph.link_facts(files).first().module == "./b"


def test_stored_pages_cover_all_nodes_once(spark, tmp_path):
    keys = sorted({(k, f"{i * 7919 % 5000:05}") for i in range(900) for k in ("FILE", "SYMBOL")})
    nodes = spark.createDataFrame(keys, "kind string, natural_key string").repartition(5)
    path = str(tmp_path / "nodes")
    graph.store_nodes(nodes, path, run=100)
    n_runs = spark.read.parquet(f"{path}/index").count()
    assert n_runs > 10
    seen, cursor, pages = [], None, 0
    while True:
        page = graph.read_page(spark, path, cursor, 130)
        assert len(page.runs) <= 5 < n_runs  # few runs of a page
        seen += [tuple(r) for r in page.nodes.collect()]
        pages, cursor = pages + 1, page.cursor
        if cursor is None:
            break
    assert seen == keys and pages == -(-len(keys) // 130)
    far = graph.read_page(spark, path, None, 50, offset=1500)
    assert [tuple(r) for r in far.nodes.collect()] == keys[1500:1550] and len(far.runs) <= 3 and far.cursor == keys[1549]
    both = graph.read_page(spark, path, keys[300], 10, offset=250)
    assert [tuple(r) for r in both.nodes.collect()] == keys[551:561]
    end = graph.read_page(spark, path, keys[-1], 10)
    assert end.nodes.count() == 0 and end.cursor is None
    exact = graph.read_page(spark, path, keys[-11], 10)
    assert exact.nodes.count() == 10 and exact.cursor is None


def test_first_diagnostics(spark):
    d = spark.createDataFrame([(f"p{i:03}", "C", "m") for i in range(300)], "path string, code string, message string")
    assert [r.path for r in graph.first_diagnostics(d, 1000).collect()] == [f"p{i:03}" for i in range(250)]


def test_large_commits_are_dealt_into_blocks(spark, monkeypatch):
    """The pairs of a commit of many files, by few files to a block, and how they spread over keys."""
    monkeypatch.setattr(history, "BLOCK", 8)
    rng = random.Random(1)
    commits = {"big": [f"f{i:03}" for i in range(90)], "also": [f"f{i:03}" for i in range(0, 90, 2)], **{f"c{j}": rng.sample([f"f{i:03}" for i in range(90)], rng.randint(1, 9)) for j in range(30)}}
    rows = spark.createDataFrame([(c, f) for c, fs in commits.items() for f in fs], "commit string, path string")
    got = history.file_pairs(rows).select("commit", "left_path", "right_path")
    have = [tuple(r) for r in got.collect()]
    want = {(c, *p) for c, fs in commits.items() for p in itertools.combinations(sorted(fs), 2)}
    assert len(have) == len(want) and set(have) == want
    keys = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__lo" in keys and "__hi" in keys


def test_scopes_hold_the_changes_between_their_bounds(spark):
    day = lambda x: dt.datetime(2020, 1, 1) + dt.timedelta(days=x)
    rng = random.Random(2)
    changes = [(rng.choice("rs"), f"c{i}", f"p{i % 5}", day(rng.randrange(0, 4000) / 4)) for i in range(300)] + [("r", "edge", "p", day(100)), ("r", "none", "p", None)]
    reports = [(f"t{i}", rng.choice("rs"), day(a := rng.randrange(-50, 900)), day(a + rng.choice([0, 1, 29, 30, 31, 400]))) for i in range(40)]
    reports += [("back", "r", day(200), day(100)), ("exact", "r", day(100), day(100)), ("open", "r", None, day(9))]
    got = audit.in_scope(spark.createDataFrame(changes, "repository_id string, commit string, path string, authored_at timestamp_ntz"), spark.createDataFrame(reports, "report_id string, repository_id string, scope_from timestamp_ntz, scope_to timestamp_ntz"))
    have = [(r.report_id, r.commit) for r in got.collect()]
    want = {(t, c) for c_repo, c, _, x in changes for t, repo, a, b in reports if repo == c_repo and x and a and a <= x <= b}
    assert len(have) == len(want) > 100 and set(have) == want and ("exact", "edge") in want


def test_views(spark):
    snaps = spark.createDataFrame([("R", "s1", "aa", DAY[0]), ("R", "s2", "bb", DAY[1]), ("R", "s3", "cc", None)], f"{PART}, commit_sha string, published_at timestamp")
    assert views.latest_snapshot(snaps).first().snapshot_id == "s2"
    assert views.latest_snapshot(snaps, sha="aa").first().snapshot_id == "s1"
    assert views.latest_snapshot(snaps, sha="cc").count() == 0
    inv = views.inventory(snaps.where("published_at is not null"), "repository_id", [F.desc("published_at")], 1).collect()
    assert [(r.snapshot_id, r.truncated) for r in inv] == [("s2", True)]
    ev = spark.createDataFrame([("r", "QUEUED", 1), ("r", "FAILED", 2), ("r", "RUNNING", 3), ("q", "RUNNING", 1)], "run_id string, state string, seq int")
    assert {(r.run_id, r.state) for r in views.run_ledger(ev).collect()} == {("r", "FAILED"), ("q", "RUNNING")}
    fb = spark.createDataFrame([("a", "u", 1, DAY[0]), ("a", "u", -1, DAY[1]), ("zz", "u", 1, DAY[0]), ("a", "v", 5, DAY[0])], "answer_id string, user_id string, rating int, created_at timestamp")
    good, bad = views.record_feedback(spark.createDataFrame([("a",)], "answer_id string"), fb)
    assert [r.rating for r in good.collect()] == [-1] and bad.count() == 2
    hot = spark.createDataFrame([("p", 0.5)], "path string, score double")
    pr = spark.createDataFrame([("a", "b", 0.5)], "left_path string, right_path string, confidence double")
    mods = spark.createDataFrame([("m", 1.0)], "module string, confidence double")
    assert views.architecture(hot, pr, mods).count() == 3 and views.architecture(hot, pr, mods.limit(0)).count() == 0
    assert [r.n for r in views.run_summary(a=hot, b=mods.limit(0)).collect()] == [1, 0]
    rows = spark.createDataFrame([("w1", 1, DAY[0]), ("w2", 2, DAY[1])], "workspace_id string, id int, created_at timestamp")
    members = spark.createDataFrame([("w1", "u"), ("w1", "u")], "workspace_id string, user_id string")
    assert [r.id for r in views.tenant_visibility(rows, members, "u").collect()] == [1] and views.tenant_visibility(rows, members, "x").count() == 0
    assert [r.id for r in views.newest_first(rows).collect()] == [2, 1] and views.newest_first(rows, "w1").count() == 1


def stored(spark, path, rows, schema, by):
    spark.createDataFrame(rows, schema).repartition(1).write.partitionBy(by).parquet(path)
    return path


def retained(spark, tmp_path):
    """Reports of several days with claims, assessments of claims and unreported changes; answers with feedback."""
    to = lambda name: str(tmp_path / name)
    rid = [(i, DAY[i % 6], i % 6) for i in range(12)] + [(99, None, 0)]
    claim = [(f"c{i}-{j}", i, i % 6) for i, _, _ in rid for j in range(2)] + [("orphan", None, 1)]
    return {
        "reports": governance.Stored(stored(spark, to("reports"), rid, "report_id int, created_at timestamp, day int", "day"), "day", at="created_at", cutoff=F.lit(DAY[2])),
        "claims": governance.Stored(stored(spark, to("claims"), claim, "claim_id string, report_id int, day int", "day"), "day", parent="reports", parent_key="report_id", on="report_id"),
        "assessments": governance.Stored(stored(spark, to("assessments"), [(c, "VERIFIED", (r or 0) % 3) for c, r, _ in claim], "claim string, status string, shard int", "shard"), "shard", parent="claims", parent_key="claim_id", on="claim"),
        "unreported": governance.Stored(stored(spark, to("unreported"), [(i, f"p{i}", i % 6) for i, _, _ in rid], "report_id int, path string, day int", "day"), "day", parent="reports", parent_key="report_id", on="report_id"),
    }


def test_retention_cascade(spark, tmp_path):
    tables = retained(spark, tmp_path)
    gone = {n: df.count() for n, df in governance.expiring(spark, tables).items()}
    assert gone == {"reports": 4, "claims": 8, "assessments": 8, "unreported": 4}
    files = lambda: {str(p) for p in tmp_path.rglob("*.parquet")}
    before, total = files(), {n: spark.read.parquet(t.path).count() for n, t in tables.items()}
    touched = governance.purge(spark, tables)
    left = {n: spark.read.parquet(t.path) for n, t in tables.items()}
    assert {n: df.count() for n, df in left.items()} == {n: total[n] - gone[n] for n in total}
    assert {r.report_id for r in left["reports"].collect()} == {2, 3, 4, 5, 8, 9, 10, 11, 99} and left["claims"].where("claim_id = 'orphan'").count() == 1
    # Days 0 and 1 alone lose rows, day 1 of the reports all; files of other partitions keep their names.
    assert touched == {"reports": ["0", "1"], "claims": ["0", "1"], "assessments": ["0", "1"], "unreported": ["0", "1"]}
    rewritten = {f.split("/")[-3] + "/" + f.split("/")[-2] for f in before - files()}
    assert rewritten == {f"{n}/{t.by}={x}" for n, t in tables.items() for x in touched[n]} and not (tmp_path / "reports" / "day=1").exists()
    assert governance.purge(spark, tables) == {n: [] for n in tables}


def test_retention_goes_on_after_a_break(spark, tmp_path, monkeypatch):
    tables = retained(spark, tmp_path)
    broken = governance.Stored(**{**tables["claims"].__dict__, "path": str(tmp_path / "nowhere")})
    with pytest.raises(Exception, match="nowhere"):
        governance.purge(spark, tables | {"claims": broken})
    governance.purge(spark, tables)
    assert {n: spark.read.parquet(t.path).count() for n, t in tables.items()} == {"reports": 9, "claims": 19, "assessments": 19, "unreported": 9}


def test_governance(spark):
    req = spark.createDataFrame([("k", 1, "f", "a"), ("k", 2, "f", "b"), ("k", 3, "g", "c")], "key string, seq int, fp string, res string")
    row = governance.idempotent_writes(req, ["key"], ["seq"], "fp", "res").first()
    assert (row.first_res, row.n_replays, row.n_conflicts) == ("a", 1, 1)
    times = [DAY[0] + dt.timedelta(seconds=s) for s in (1, 2, 3, 62)]
    ev = spark.createDataFrame([("u", t, i) for i, t in enumerate(times)], "user string, ts timestamp, id int")
    got = governance.admit(ev, "user", "ts", "id", 2).orderBy("id").collect()
    assert [r.admitted for r in got] == [True, True, False, True]


def test_package_imports_stay_apart():
    root = Path(__file__).resolve().parent.parent / "tracewright"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tracewright.llm" not in p.read_text()

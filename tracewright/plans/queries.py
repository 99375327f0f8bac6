"""One query per operator of the engine over the given tables; SQL in the module beside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.ids import stable_id
from tracewright.functions.text import AUDIT_STOP, claim_type, spreadsheet_safe, terms
from tracewright.operators import audit, governance, graph, history, retrieval, scoring, views
from tracewright.plans import driver_map as m
from tracewright.plans import facts
from tracewright.sources import buckets
from tracewright.sources.readers import load_table
from tracewright.sources.snapshots import append_new
from tracewright.streaming import jobs, stateful

#: Dates that the queries cut at.
SNAPSHOT_CUTOFF, KNOWN_BEFORE, RETAIN_FROM, ANSWERS_FROM = "1997-01-01", "1996-01-01", "1996-07-01", "2024-01-10"
SELECTED = "00000007"


def bar(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "|")


def day(c: str):
    return F.col(c).cast("date").cast("string")


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def file_change_stats(spark: SparkSession, d: str) -> DataFrame:
    n = m.line_tasks(spark, d)
    return history.file_stats(history.split_churn(m.changes(spark, d), tasks=n), tasks=n)


def hotspots(spark: SparkSession, d: str) -> DataFrame:
    return history.hotspots(file_change_stats(spark, d))


def co_change_pairs(spark: SparkSession, d: str) -> DataFrame:
    return history.co_changes(m.supplier_changes(spark, d), tasks=m.line_tasks(spark, d))


def co_change_pairs_parts(spark: SparkSession, d: str) -> DataFrame:
    return history.co_changes(m.changes(spark, d), tasks=m.line_tasks(spark, d))


def module_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth part has a second file, which no order touches."""
    parts = m.parts(spark, d)
    files = parts.unionByName(parts.where("p_partkey % 4 = 0").withColumn("path", F.concat("path", F.lit("-notes"))))
    return history.modules(files, m.changes(spark, d), tasks=m.line_tasks(spark, d)).select("module", "n_files", "changed_files", "confidence", "description")


def risk_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.risk(hotspots(spark, d)).select("path", "score", "hotspot", "change_frequency", "relative_churn")


def impact_all(spark: SparkSession, d: str) -> DataFrame:
    return scoring.impact(scoring.relations(co_change_pairs(spark, d)), tasks=m.line_tasks(spark, d)).select("selected_path", "path", "score", "n_reasons", "rank")


def impact_selected(spark: SparkSession, d: str) -> DataFrame:
    rel = m.touching(scoring.relations(co_change_pairs(spark, d), m.supplier_imports(spark, d)), SELECTED)
    chosen = F.broadcast(spark.range(1).select(F.lit(SELECTED).alias("selected_path")))  # one row
    kinds = F.array_join(F.transform("reasons", lambda r: F.regexp_replace(r, r" \(.*$", "")), "|")
    return scoring.impact(rel, chosen).select("path", "score", kinds.alias("reasons"))


def score_eval(spark: SparkSession, d: str) -> DataFrame:
    docs = load_table(spark, d, "documents")
    labels = load_table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    top = docs.agg(F.max("n_chars").alias("mx"))
    scored = docs.join(labels, "doc_id").crossJoin(F.broadcast(top)).select((F.col("n_chars") / F.col("mx")).alias("score"), "label")  # one row
    return scoring.evaluate(scored).select(F.round("model_brier", 9).alias("model_brier"), F.round("constant_brier", 9).alias("constant_brier"), "useful")


def term_sets(spark: SparkSession, d: str) -> DataFrame:
    t = load_table(spark, d, "benchmark").select("item_id", F.array_sort(terms(F.col("text"), AUDIT_STOP)).alias("t"))
    return t.select("item_id", F.size("t").cast("long").alias("n_terms"), F.array_join("t", "|").alias("terms"))


def claims(spark: SparkSession, d: str) -> DataFrame:
    return audit.split_reports(m.reports(spark, d), ("conv_id", "turn"))[0]


def claim_split(spark: SparkSession, d: str) -> DataFrame:
    return claims(spark, d).select("conv_id", "turn", F.col("ordinal").cast("long").alias("ordinal"), "claim", "claim_type")


def claim_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Whether each claim stands in its text where its offsets say."""
    joined = claims(spark, d).join(m.reports(spark, d), ["conv_id", "turn"])
    part = F.substring(F.col("text"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    return joined.select("conv_id", "turn", F.col("ordinal").cast("long").alias("ordinal"), (part == F.col("claim")).alias("exact"))


def claim_types(spark: SparkSession, d: str) -> DataFrame:
    return claims(spark, d).groupBy("claim_type").agg(F.count(F.lit(1)).alias("n"))


def assessments(spark: SparkSession, d: str) -> DataFrame:
    items = load_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", claim_type(F.col("text")).alias("claim_type"))
    docs = m.documents(spark, d).withColumn("kind", F.lit("repository_change"))
    return audit.assess(items, docs)


def claim_assessment(spark: SparkSession, d: str) -> DataFrame:
    return assessments(spark, d).select(F.col("query_id").alias("item_id"), "status", "confidence", bar("evidence").alias("evidence"))


def unreported_changes(spark: SparkSession, d: str) -> DataFrame:
    docs = load_table(spark, d, "documents")
    ch = docs.select("source", F.col("doc_id").alias("path"), F.col("doc_id").alias("commit"), F.col("doc_id").alias("authored_at"), F.col("n_chars").alias("churn"))
    cited = assessments(spark, d).select(F.explode("evidence").alias("doc_id")).distinct().join(docs, "doc_id").select("source", F.col("doc_id").alias("path"))
    return audit.unreported(ch, cited, ("source",)).select("source", F.col("path").alias("doc_id"), "churn", "materiality")


def report_markdown(spark: SparkSession, d: str) -> DataFrame:
    text = load_table(spark, d, "benchmark").select("item_id", F.lit(0).alias("ordinal"), F.col("text").alias("claim"))
    rows = text.join(assessments(spark, d).withColumnRenamed("query_id", "item_id"), "item_id")
    # Every second item has two paths that no claim names; which of them weighs more depends on the item.
    even = load_table(spark, d, "benchmark").where("item_id % 2 = 0").select("item_id", F.explode(F.array(F.lit("a/"), F.lit("b/"))).alias("name"))
    weight = F.when(F.col("name") == "a/", 0.5).when(F.col("item_id") % 4 == 0, 0.25).otherwise(0.75)
    missing = even.select("item_id", F.concat("name", F.col("item_id").cast("string")).alias("path"), weight.alias("materiality"), F.lit("no claim of the item names it").alias("explanation"))
    return audit.report_markdown(rows, missing, ("item_id",))


def grounded(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.answers(m.questions(spark, d), m.documents(spark, d))


def grounded_answers(spark: SparkSession, d: str) -> DataFrame:
    return grounded(spark, d).select(F.col("query_id").alias("conv_id"), "answer", bar("evidence").alias("evidence"))


def recent_answers(spark: SparkSession, d: str) -> DataFrame:
    """Each order priority asks for its latest changes; commits are the orders."""
    orders = load_table(spark, d, "orders")
    asked = orders.select(F.col("o_orderpriority").alias("query_id")).distinct().withColumn("text", F.concat(F.lit("What are the latest commits of "), "query_id"))
    docs = orders.select(F.concat(F.lit("commit:"), F.col("o_orderkey").cast("string")).alias("doc_id"), F.lit("commit").alias("kind"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    return retrieval.answers(asked, docs).select(F.col("query_id").alias("question_id"), "answer", bar("evidence").alias("evidence"))


def citation_check(spark: SparkSession, d: str) -> DataFrame:
    """Answers of conversations with an odd id cite an unknown document, too."""
    a = grounded(spark, d)
    cited = F.when(F.col("query_id") % 2 == 1, F.concat("evidence", F.array(F.lit(-1).cast("long")))).otherwise(F.col("evidence"))
    rows = a.select("query_id", "answer", cited.alias("cited"), F.col("evidence").alias("allowed"))
    return retrieval.check_citations(rows).select(F.col("query_id").alias("conv_id"), "n_cited", "valid")


def links(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return graph.link_graph(m.page_imports(spark, d), m.page_files(spark, d))


def link_nodes(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d)["nodes"].select("kind", "natural_key", "n_evidence")


def link_edges(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d)["edges"].select("type", "from_key", "to_key")


def link_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d)["diagnostics"].select("code", "path", "n")


def graph_page(spark: SparkSession, d: str) -> DataFrame:
    g = links(spark, d)
    return graph.page(g["nodes"], g["edges"], ("FILE", "m"), 100)


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.summary(links(spark, d)["nodes"])


def evidence_lookup(spark: SparkSession, d: str) -> DataFrame:
    ev = load_table(spark, d, "pages").select(stable_id("ev", F.col("page_id"), F.lit("page")).alias("evidence_id"), "page_id", "url")
    wanted = [r[0] for r in spark.range(3).select(stable_id("ev", F.col("id") * 4 + 3, F.lit("page"))).collect()]  # the three ids asked for
    return graph.evidence_lookup(ev, wanted)


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("published_at"))


def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return views.latest_snapshot(snapshots(spark, d), "o_custkey").select("o_custkey", F.col("snapshot_id").alias("o_orderkey"), day("published_at").alias("o_orderdate"))


def snapshot_as_of(spark: SparkSession, d: str) -> DataFrame:
    return views.latest_snapshot(snapshots(spark, d), "o_custkey", as_of=at(SNAPSHOT_CUTOFF)).select("o_custkey", F.col("snapshot_id").alias("o_orderkey"), day("published_at").alias("o_orderdate"))


def inventory(spark: SparkSession, d: str) -> DataFrame:
    return views.inventory(snapshots(spark, d), "o_custkey", [F.desc("published_at"), F.col("snapshot_id")], 5).select("o_custkey", F.col("snapshot_id").alias("o_orderkey"), F.col("rn").cast("long").alias("rn"), "truncated")


def architecture(spark: SparkSession, d: str) -> DataFrame:
    out = views.architecture(hotspots(spark, d), co_change_pairs(spark, d), module_candidates(spark, d))
    return out.withColumn("rank", F.col("rank").cast("long"))


def new_commits(spark: SparkSession, d: str) -> DataFrame:
    orders = load_table(spark, d, "orders")
    return append_new(orders.where(F.col("o_orderdate") < at(KNOWN_BEFORE)), orders, ["o_orderkey"]).select("o_orderkey")


def ref_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = load_table(spark, d, "events")
    return views.latest(e, ("user_id", "event_type"), [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


def idempotent_writes(spark: SparkSession, d: str) -> DataFrame:
    e = load_table(spark, d, "events").withColumn("fp", F.sha2("props", 256))
    return governance.idempotent_writes(e, ["user_id", "event_type"], ["ts", "event_id"], "fp", "event_id")


def retained(spark: SparkSession, d: str) -> dict[str, governance.Stored]:
    """Orders are reports, line items claims, the odd ones assessed; priorities are unreported changes. Events are answers, the next event is feedback.

    Tables of reports are partitioned by year, those of answers by week.
    """
    to = facts.folder(spark, "retained")
    orders = load_table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").alias("created_at"), "o_orderpriority").withColumn("year", F.year("created_at"))
    lines = load_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim_id"), "l_linenumber").join(orders.select("report_id", "year"), "report_id")
    events = load_table(spark, d, "events").withColumn("week", F.weekofyear("ts"))
    written = {
        "reports": (orders.drop("o_orderpriority"), "year"),
        "claims": (lines.select("claim_id", "report_id", "year"), "year"),
        "assessments": (lines.where("l_linenumber % 2 = 1").select("claim_id", F.lit("VERIFIED").alias("status"), "year"), "year"),
        "unreported": (orders.select("report_id", F.col("o_orderpriority").alias("path"), "year"), "year"),
        "answers": (events.where("event_id % 2 = 0").select(F.col("event_id").alias("answer_id"), F.col("ts").alias("created_at"), "week"), "week"),
        "feedback": (events.where("event_id % 2 = 1").select((F.col("event_id") - 1).alias("answer_id"), "user_id", "week"), "week"),
    }
    for name, (df, by) in written.items():
        df.repartition(by).write.partitionBy(by).parquet(f"{to}/{name}")
    root = lambda name, cutoff: governance.Stored(f"{to}/{name}", written[name][1], at="created_at", cutoff=at(cutoff))
    below = lambda name, parent, key: governance.Stored(f"{to}/{name}", written[name][1], parent=parent, parent_key=key, on=key)
    return {
        "reports": root("reports", RETAIN_FROM), "claims": below("claims", "reports", "report_id"), "assessments": below("assessments", "claims", "claim_id"),
        "unreported": below("unreported", "reports", "report_id"), "answers": root("answers", ANSWERS_FROM), "feedback": below("feedback", "answers", "answer_id"),
    }


def retention_preview(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each table a retention run removes."""
    gone = governance.expiring(spark, retained(spark, d))
    return views.run_summary(**gone).select(F.col("what").alias("table"), F.col("n").alias("n_rows"))


def retention_purge(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each table a retention run leaves on disk."""
    tables = retained(spark, d)
    governance.purge(spark, tables)
    return views.run_summary(**{n: spark.read.parquet(t.path) for n, t in tables.items()}).select(F.col("what").alias("table"), F.col("n").alias("n_remaining"))


def audit_export(spark: SparkSession, d: str) -> DataFrame:
    e = governance.newest_events(load_table(spark, d, "events"), "ts", "event_id")
    cell = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("="), "event_type")).otherwise(F.col("event_type"))
    return e.select("event_id", spreadsheet_safe(cell).alias("cell"))


def tenant_visibility(spark: SparkSession, d: str) -> DataFrame:
    """The user of a region is a member of its nations' workspaces."""
    members = load_table(spark, d, "nation").select(F.col("n_nationkey").alias("workspace_id"), F.concat(F.lit("u"), F.col("n_regionkey").cast("string")).alias("user_id"))
    cust = load_table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("workspace_id"))
    orders = load_table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return views.tenant_visibility(cust, members, "u1").join(orders, "c_custkey").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_orders"))


def run_ledger(spark: SparkSession, d: str) -> DataFrame:
    ev = load_table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("state"), F.col("o_orderkey").alias("seq"))
    return views.run_ledger(ev, "o_custkey", ("F",)).select("o_custkey", "state", F.col("seq").alias("o_orderkey"))


def feedback_latest(spark: SparkSession, d: str) -> DataFrame:
    e = load_table(spark, d, "events").select(F.col("event_type").alias("answer_id"), "user_id", (F.col("event_id") % 4 - 1).alias("rating"), F.col("ts").alias("created_at"))
    answers = e.select("answer_id").distinct().where("answer_id != 'error'")
    return views.record_feedback(answers, e)[0].select("answer_id", "user_id", "rating")


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "part").select("p_partkey", stable_id("node", F.lit("repo"), F.lit("FILE"), F.col("p_brand"), F.col("p_partkey")).alias("id"))


def limiter_admit(spark: SparkSession, d: str) -> DataFrame:
    return governance.admit(load_table(spark, d, "events"), "user_id", "ts", "event_id", 1, 3600.0)


def streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = load_table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def stream_commit_dedup(spark: SparkSession, d: str) -> DataFrame:
    to = facts.folder(spark, "stream")
    commits = streamed(spark, d, "orders").select("o_orderkey", "o_custkey")
    jobs.append_stream(commits, f"{to}/table", f"{to}/checkpoint", ["o_orderkey"]).awaitTermination()
    return spark.read.parquet(f"{to}/table")


def stream_ref_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Three runs of a stream from one checkpoint; the last one has few keys, so that few buckets are written anew."""
    to, e = facts.folder(spark, "stream"), load_table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    run = F.when(F.col("user_id") % 50 == 1, F.lit(2)).otherwise(F.col("event_id") % 2)
    for i in range(3):
        e.where(run == i).write.mode("append").parquet(f"{to}/in")
        refs = spark.readStream.schema(e.schema).parquet(f"{to}/in")
        jobs.upsert_stream(refs, f"{to}/table", f"{to}/checkpoint", ["user_id", "event_type"], "ts", "event_id").awaitTermination()
    return buckets.newest(spark, f"{to}/table").select("user_id", "event_type", "event_id")


def fed(spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over the events gives when they come in three runs from one checkpoint, every tenth event one run late.

    A last row, without a user, lets the watermark pass all others.
    """
    to, e = facts.folder(spark, "stream"), load_table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", F.sha2("props", 256).alias("fp"))
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    third = (last - first) / 3
    in_time = F.when(F.col("ts") < F.lit(first + third), 0).when(F.col("ts") < F.lit(last - third), 1).otherwise(2)
    run = F.least(F.lit(2), in_time + F.when(F.col("event_id") % 10 == 3, 1).otherwise(0))
    for i in range(3):
        rows = e.where(run == i)
        if i == 2:
            rows = rows.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit("").alias("event_type"), F.lit(-1).cast("long").alias("event_id"), F.lit(last + 9 * third).cast("timestamp_ntz").alias("ts"), F.lit("").alias("fp")))
        rows.write.mode("append").parquet(f"{to}/in")
        stream = build(spark.readStream.schema(e.schema).parquet(f"{to}/in"))
        stateful.append_to(stream, f"{to}/table", f"{to}/checkpoint")
    return spark.read.parquet(f"{to}/table").where("event_id >= 0")


#: Longer than a third of the events' time, by which late ones are late.
LATENESS = "11 days"


def stream_first_writes(spark: SparkSession, d: str) -> DataFrame:
    """Requests are the events, keys user and kind of event: how often each first write came back, and how often it was contradicted."""
    out = fed(spark, d, lambda s: stateful.first_writes(s, ["user_id", "event_type"], "ts", "event_id", "fp", "event_id", LATENESS))
    n = lambda outcome: F.count_if(F.col("outcome") == outcome)
    return out.groupBy("user_id", "event_type", F.col("resource").cast("long").alias("first_event_id")).agg(n("replayed").alias("n_replays"), n("conflict").alias("n_conflicts"))


def stream_admissions(spark: SparkSession, d: str) -> DataFrame:
    """One event of a user in any hour."""
    return fed(spark, d, lambda s: stateful.admit_stream(s, ["user_id"], "ts", "event_id", 1, 3600.0, LATENESS)).select("user_id", "event_id", "admitted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        file_change_stats, hotspots, co_change_pairs, co_change_pairs_parts, module_candidates, risk_scores, impact_all, impact_selected,
        score_eval, term_sets, claim_split, claim_offsets, claim_types, claim_assessment, unreported_changes, report_markdown,
        grounded_answers, recent_answers, citation_check, link_nodes, link_edges, link_diagnostics, graph_page, graph_summary, evidence_lookup,
        latest_snapshot, snapshot_as_of, inventory, architecture, new_commits, ref_upsert, idempotent_writes, retention_preview,
        retention_purge, audit_export, tenant_visibility, run_ledger, feedback_latest, stable_ids, limiter_admit, stream_commit_dedup, stream_ref_upsert,
        stream_first_writes, stream_admissions,
    )
}
QUERIES |= facts.QUERIES

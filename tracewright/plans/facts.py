"""Queries of the graph, of scoped audits, of readers and of snapshots over facts derived from the given tables, and their SQL."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.ids import decode_cursor, encode_cursor, request_fingerprint
from tracewright.functions.paths import language, normalised_repository
from tracewright.functions.text import redact
from tracewright.operators import audit, graph, history, retrieval, scoring, views
from tracewright.plans import driver_map as m
from tracewright.sources import readers, sinks, snapshots
from tracewright.sources.readers import load_table

#: Whose impact is asked for, and the size up to which the first of two snapshots holds parts.
SELECTED, SMALL = "00000007", 25
SHAS = ("a" * 40, "b" * 40)
#: When the scopes of the reports begin.
SCOPE_FROM = "1994-01-01"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Where that setting is absent a local session (a test, say) takes a temporary folder; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def facts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Facts of one snapshot: a part is a file below its brand, which declares a symbol (every fifth twice) and imports one module."""
    p = load_table(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.concat_ws("/", "p_brand", F.concat(F.col("p_partkey").cast("string"), F.lit(".ts"))).alias("path"))
    p = p.withColumns({"repository_id": F.lit("r"), "snapshot_id": F.lit("s")})
    n = F.col("p_size").cast("int")
    span = F.struct(n.alias("start_line"), F.lit(0).alias("start_column"), (n + 1).alias("end_line"), F.lit(1).alias("end_column"))
    p = p.withColumn("span", span).withColumn("symbol", F.concat(F.lit("s"), n.cast("string")))
    ids = ["repository_id", "snapshot_id", "path"]
    symbols = p.select(*ids, F.col("symbol").alias("name"), F.lit("function").alias("kind"), (n % 2 == 0).alias("exported"), "span", "p_size")
    symbols = symbols.unionByName(symbols.where("p_size % 5 = 0")).drop("p_size")
    local = F.when(n % 2 == 0, F.col("symbol")).when(n % 3 == 0, F.lit("nowhere"))
    following = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat(F.lit("../"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string")).alias("sibling"))
    kind = F.col("p_partkey") % 4
    module = F.when(kind == 0, "./missing").when(kind == 1, F.concat(F.lit("lib"), n.cast("string"))).when(kind == 2, "./style.css").otherwise(F.coalesce("sibling", F.lit("./missing")))
    return {
        "files": p.select(*ids, F.lit("typescript").alias("language"), F.sha2("path", 256).alias("content_sha256")),
        "symbols": symbols,
        "exports": p.select(*ids, local.alias("local_name"), "span"),
        "imports": p.join(following, "p_partkey", "left").select(*ids, module.alias("module"), "span", F.lit(0).alias("ordinal")),
        "diagnostics": p.where("p_size = 1").select(*ids, F.lit("SYNTAX").alias("code"), F.concat(F.lit("line "), n.cast("string")).alias("message"), "span"),
    }


def structure(spark: SparkSession, d: str, most_evidence: int | None = None) -> dict[str, DataFrame]:
    return graph.structural_graph(**facts(spark, d), most_evidence=most_evidence)


def structural_nodes(spark: SparkSession, d: str) -> DataFrame:
    return structure(spark, d)["nodes"].select("node_id", "kind", "natural_key", F.size("evidence_ids").cast("long").alias("n_evidence"))


def structural_facts(spark: SparkSession, d: str) -> DataFrame:
    """Ids, properties and evidence of nodes and edges as they are stored."""
    g = structure(spark, d)
    nodes = g["nodes"].select("kind", F.col("node_id").alias("id"), F.col("properties").alias("about"), F.array_join("evidence_ids", "|").alias("evidence"))
    return nodes.unionByName(g["edges"].select("kind", F.col("edge_id").alias("id"), F.concat_ws(">", "from_node", "to_node").alias("about"), F.col("evidence_id").alias("evidence")))


#: Pieces of evidence that a node is shown with.
SHOWN = 3


def node_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How much evidence each node has, and the first pieces of it, without any node's evidence as a whole."""
    g = structure(spark, d, SHOWN)
    n = g["node_evidence"].groupBy("node_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    return g["nodes"].join(n, "node_id").select("kind", "node_id", "n_evidence", F.array_join("evidence_ids", "|").alias("first_evidence"))


def source_imports(spark: SparkSession, d: str) -> DataFrame:
    """Source files made of the pages, read back as bytes: how often each module is imported, and that contents equal their digests.

    A line imports a page's section and a numbered part of its host; what its comments and strings import does not count.
    """
    to = folder(spark, "sources")
    p = load_table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"))
    part = F.concat(F.lit("./part"), (F.col("page_id") % 50).cast("string"))
    line = F.concat(
        F.lit('import page from "./'), "host", F.lit("\"; // import x from './no1'\nconst s = \"import y from './no2'\"; /* require('./no3') */ const t = require('"), part, F.lit("'); const u = `require('./no4')`;")
    )
    p.where("host != ''").select(line.alias("value")).write.option("maxRecordsPerFile", 500).text(to)
    files = readers.read_sources(spark, to, "*.txt").select(F.col("path"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("content_sha256"))
    found = graph.link_facts(files.where(F.sha2(F.encode("text", "UTF-8"), 256) == F.col("content_sha256")))
    return found.groupBy("module").agg(F.count(F.lit(1)).alias("n"))


def structural_edges(spark: SparkSession, d: str) -> DataFrame:
    g = structure(spark, d)
    ends = {side: g["nodes"].select(F.col("node_id").alias(f"{side}_node"), F.col("natural_key").alias(f"{side}_key")) for side in ("from", "to")}
    return g["edges"].join(ends["from"], "from_node").join(ends["to"], "to_node").select("kind", "from_key", "to_key", "confidence")


def structural_evidence(spark: SparkSession, d: str) -> DataFrame:
    return graph.summary(structure(spark, d)["evidence"])


def structural_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return structure(spark, d)["diagnostics"].select("code", "path", "message")


def import_relations(spark: SparkSession, d: str) -> DataFrame:
    """Imports between files; those of modules dangle, as only files are given, and are dropped."""
    g = structure(spark, d)
    return graph.import_relations(g["edges"], g["nodes"].where("kind = 'FILE'")).select("source", "target", "weight", F.array_join("evidence", "|").alias("evidence"))


def structural_page(spark: SparkSession, d: str) -> DataFrame:
    """The first 1,000 nodes with the imports between them."""
    g = structure(spark, d)
    edges = graph.import_relations(g["edges"], g["nodes"]).select(F.col("source").alias("from_key"), F.col("target").alias("to_key"))
    return graph.page(g["nodes"], edges)


#: Nodes of a page and of a stored run, and the nodes that the third page passes over.
PAGE_NODES, RUN_NODES, PASSED = 150, 1000, 330


def stored_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first page of all nodes, the one that its cursor leads to, and one by offset, each read from the runs that hold it."""
    to = folder(spark, "nodes")
    graph.store_nodes(structure(spark, d)["nodes"].select("kind", "natural_key"), to, RUN_NODES)
    first = graph.read_page(spark, to, None, PAGE_NODES)
    pages = [first, graph.read_page(spark, to, first.cursor, PAGE_NODES), graph.read_page(spark, to, None, PAGE_NODES, PASSED)]
    return reduce(DataFrame.unionByName, (p.nodes.withColumn("page", F.lit(i).cast("long")) for i, p in enumerate(pages)))


def observed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of three tables and bytes of a manifest, counted in the passes that write them, and whether they are over their bounds."""
    to, files = folder(spark, "observed"), manifest(spark, d)
    got = {name: sinks.write_counted(load_table(spark, d, name), f"{to}/{name}", most={"rows": 1000}) for name in ("orders", "customer", "nation")}
    got["manifest"] = sinks.write_counted(files, f"{to}/manifest", {"bytes": F.sum("size")}, {"bytes": 100_000_000})
    return spark.createDataFrame([(n, g["rows"], g.get("bytes", 0), g["over"]) for n, g in got.items()], "what string, n long, bytes long, over boolean")


def supplier_history(spark: SparkSession, d: str) -> DataFrame:
    """commit = order, path = supplier, when the order was made."""
    at = load_table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("authored_at"))
    return m.supplier_changes(spark, d).join(at, "commit")


def bar(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "|")


def file_evidence(spark: SparkSession, d: str) -> DataFrame:
    return history.file_evidence(supplier_history(spark, d), tasks=m.line_tasks(spark, d)).select("path", bar("evidence").alias("evidence"))


def pair_evidence(spark: SparkSession, d: str) -> DataFrame:
    ch, n = supplier_history(spark, d), m.line_tasks(spark, d)
    return history.pair_evidence(ch, history.co_changes(ch, tasks=n), tasks=n).select("left_path", "right_path", "commit_count", bar("evidence").alias("evidence"))


def module_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The first commits of each module, by path and time."""
    return history.module_evidence(m.parts(spark, d), m.changes(spark, d), tasks=m.line_tasks(spark, d)).select("module", bar("evidence").alias("evidence"))


def impact_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What a change of one supplier touches, with the commits and imports that say so."""
    ch, n = supplier_history(spark, d), m.line_tasks(spark, d)
    of = F.concat(F.lit("import:"), "source")
    rel = m.touching(scoring.relations(history.pair_evidence(ch, history.co_changes(ch, tasks=n), tasks=n), m.supplier_imports(spark, d).withColumn("evidence", F.array(of))), SELECTED)
    # Ranking and gathering evidence both read the relations: they are made once.
    to = folder(spark, "relations")
    rel.write.parquet(to)
    rel = spark.read.schema(rel.schema).parquet(to)
    chosen = F.broadcast(spark.range(1).select(F.lit(SELECTED).alias("selected_path")))  # one row
    return scoring.impact(rel, chosen).select("path", "score", F.array_join("evidence", "|").alias("evidence"))


def scoped_changes(spark: SparkSession, d: str) -> DataFrame:
    """A report per nation over a scope of its own length; all of its changes, with the commit's message where there is one."""
    nation = load_table(spark, d, "nation")
    begin = F.lit(SCOPE_FROM).cast("timestamp_ntz")
    end = F.expr(f"timestamp_ntz'{SCOPE_FROM}' + make_interval(0, 0, 0, cast(n_nationkey as int) * 30 + 824)")
    reports = nation.select(F.concat(F.lit("rep"), F.col("n_nationkey").cast("string")).alias("report_id"), F.col("n_nationkey").cast("long").alias("repository_id"), begin.alias("scope_from"), end.alias("scope_to"))
    customers = load_table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("repository_id"))
    orders = load_table(spark, d, "orders").join(customers, "o_custkey").withColumn("commit", F.col("o_orderkey").cast("string"))
    changes = orders.select("repository_id", "commit", F.col("o_orderpriority").alias("path"), F.col("o_orderdate").cast("timestamp_ntz").alias("authored_at"))
    commits = orders.where("o_orderkey % 3 != 0").select("repository_id", "commit", F.concat(F.lit("status "), "o_orderstatus").alias("message"))
    scoped = audit.in_scope(changes, reports)
    by_report = commits.join(reports.select("report_id", "repository_id"), "repository_id")
    return audit.candidates(scoped, by_report, ("report_id",)).select("report_id", "doc_id", "text")


def report_view(spark: SparkSession, d: str) -> DataFrame:
    """Claims with the assessments that there are, which is every second claim's; a report with one outstanding is pending."""
    keys = ("conv_id", "turn")
    claims = audit.split_reports(m.reports(spark, d), keys)[0]
    done = claims.where("ordinal % 2 = 0").select(*keys, "ordinal", F.concat(F.lit("AS_"), "claim_type").alias("status"))
    return audit.view(claims, done, keys).select(*keys, F.col("ordinal").cast("long").alias("ordinal"), "status", "pending")


def commit_churn(spark: SparkSession, d: str) -> DataFrame:
    """Numstat lines are the line items; every seventh order is a merge, and binary lines have no counts."""
    path = F.concat(F.lit("f"), F.col("l_partkey").cast("string"))
    lines = load_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), path.alias("old_path"), F.when(F.col("l_partkey") % 2 == 0, F.concat(path, F.lit(".new"))).alias("new_path"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_quantity").cast("long")).alias("added"), F.when(F.col("l_suppkey") % 3 == 0, F.lit(1).cast("long")).alias("deleted"))
    parents = F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("x"), F.lit("y"))).when(F.col("o_orderkey") % 7 == 1, F.array(F.lit("x")))
    commits = load_table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), parents.alias("parent_shas"), F.col("o_orderdate").alias("authored_at"))
    return readers.commit_changes(lines, commits).select("commit", F.size("files").cast("long").alias("n_files"), "churn")


def published(spark: SparkSession, d: str) -> str:
    root, p = folder(spark, "published"), load_table(spark, d, "part").select("p_partkey", "p_size")
    for i, rows in enumerate((p.where(F.col("p_size") <= SMALL), p)):
        at = F.lit(f"2024-01-0{i + 1} 00:00:00").cast("timestamp")
        snapshots.publish_snapshot(spark, root, "r", f"s{i}", SHAS[i], {"files": rows}, at)
    return root


def snapshot_newest(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.read_snapshot(spark, published(spark, d), "files").select("p_partkey", "p_size")


def snapshot_by_sha(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.read_snapshot(spark, published(spark, d), "files", SHAS[0]).select("p_partkey", "p_size")


def retrieval_documents(spark: SparkSession, d: str) -> DataFrame:
    """Modules are nations, hotspots suppliers; the newest 200 orders are the commits."""
    mods = load_table(spark, d, "nation").select(F.col("n_name").alias("module"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("description"))
    ch = supplier_history(spark, d)
    hot = ch.groupBy("path").agg(F.count(F.lit(1)).alias("commit_count"))
    commits = load_table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("commit"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("message"), F.col("o_orderdate").alias("authored_at"))
    return retrieval.retrieval_documents(mods, hot, commits).select("doc_id", "kind", "text")


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """A part is a file; its key gives the suffix and whether it is a symbolic link, its size the bytes."""
    ends = F.array(*map(F.lit, (".ts", ".md", ".JS", ".py", ".tsx")))
    path = F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.get(ends, (F.col("p_partkey") % 5).cast("int")))
    return load_table(spark, d, "part").select("p_brand", path.alias("path"), F.when(F.col("p_partkey") % 11 == 0, "120000").otherwise("100644").alias("mode"), (F.col("p_size").cast("long") * 40_000).alias("size"))


def source_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = manifest(spark, d)
    taken, skipped = readers.select_sources(rows)
    states = taken.select("path", F.lit("candidate").alias("state")).unionByName(skipped.select("path", F.lit("skipped").alias("state")))
    return readers.with_analyzed(rows, taken).join(states, "path", "left").select("path", F.coalesce("state", F.lit("other")).alias("state"), "analyzed")


def volume_guard(spark: SparkSession, d: str) -> DataFrame:
    return readers.volume_guard(manifest(spark, d), ("p_brand",), most_bytes=85_000_000).select("p_brand", "n_files", "n_bytes", "over")


def commit_dump(spark: SparkSession, d: str) -> DataFrame:
    """A log export of the orders, every tenth record cut short, read back: what is read and how much is set aside."""
    sha = lambda c: F.sha1(F.col(c).cast("string"))
    full = F.concat_ws("\x00", sha("o_orderkey"), sha("o_custkey"), F.lit("An Author"), F.lit("a@example.org"), F.lit("2024-01-02T03:04:05+00:00"), F.concat(F.lit(" Message "), F.col("o_orderkey").cast("string"), F.lit("\n")))
    to = folder(spark, "log")
    load_table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 10 == 0, sha("o_orderkey")).otherwise(full).alias("value")).write.option("lineSep", "\x1e").text(to)
    good, bad = readers.read_commit_dump(spark, to)
    return good.select("commit", F.size("parent_shas").cast("long").alias("n_parents"), "author", "message").unionByName(bad.select(F.lit("rejected").alias("commit"), F.lit(0).cast("long").alias("n_parents"), F.lit("").alias("author"), F.col("value").alias("message")))


def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 9 == 0, "tree").otherwise("blob")
    sha = F.when(F.col("p_partkey") % 10 == 0, "zz").otherwise(F.sha1(F.col("p_partkey").cast("string")))
    value = F.concat(F.lit("100644 "), kind, F.lit(" "), sha, F.lit("    "), F.when(kind == "tree", "-").otherwise(F.col("p_size").cast("int").cast("string")), F.lit("\tsrc/"), F.col("p_partkey").cast("string"))
    good, bad = readers.read_manifest(load_table(spark, d, "part").select(value.alias("value")))
    return good.select("path", "blob_sha", "size").unionByName(bad.select(F.col("value").alias("path"), F.lit("rejected").alias("blob_sha"), F.lit(0).cast("long").alias("size")))


def ref_rows(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 6 == 0, F.concat(F.lit("bad..name"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("feature/"), F.col("c_custkey").cast("string")))
    lines = load_table(spark, d, "customer").select(F.concat_ws(" ", F.sha1(F.col("c_custkey").cast("string")), name).alias("value"))
    good, bad = readers.read_refs(lines)
    return good.unionByName(bad.select(F.lit("rejected").alias("name"), F.col("value").alias("head_sha")))


def part_functions(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints, cursors, languages, repository addresses and redacted logs of each part."""
    p = load_table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("int").alias("p_size"))
    url = F.concat(F.lit("https://example.org/"), F.regexp_replace("p_brand", "#", ""), F.lit("/n"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".git").when(F.col("p_partkey") % 3 == 1, "/").otherwise("?x=1"))
    log = F.concat(F.lit("first line\n token "), "p_brand", F.lit(" of "), F.col("p_partkey").cast("string"), F.lit(" \n"))
    ends = F.array(*map(F.lit, ("a.ts", "b.jsx", "c.tsx", "d.md")))
    return p.select(
        "p_partkey", request_fingerprint("p_brand", "p_size").alias("fingerprint"), encode_cursor(F.col("p_partkey")).alias("cursor"), decode_cursor(encode_cursor(F.col("p_partkey"))).alias("decoded"),
        language(F.get(ends, (F.col("p_partkey") % 4).cast("int"))).alias("language"), normalised_repository(url, "example.org").alias("repository"), redact(log, F.array("p_brand")).alias("redacted"),
    )


def newest_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = load_table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("workspace_id"), F.col("o_orderdate").alias("created_at"))
    return views.newest_first(rows, "1-URGENT", tie="o_orderkey").select("o_orderkey")


QUERIES = {
    f.__name__: f
    for f in (
        structural_nodes, structural_facts, node_evidence, source_imports, structural_edges, structural_evidence, structural_diagnostics, import_relations, structural_page, stored_pages, observed_counts, file_evidence,
        pair_evidence, module_evidence, impact_evidence, scoped_changes, report_view, commit_churn, snapshot_newest, snapshot_by_sha, retrieval_documents,
        source_selection, volume_guard, commit_dump, manifest_rows, ref_rows, part_functions, newest_orders,
    )
}

"""Structural graph: nodes, edges, evidence and diagnostics from fact tables, and its page and lookup views.

Facts, per file of a snapshot: files (path, language, content_sha256), symbols (path, name, kind, exported, span),
exports (path, local_name, span), imports (path, module, span, ordinal), diagnostics (path, code, message, span).
`part` names the columns that identify a snapshot; stable ids are made of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.ids import span_text, stable_id
from tracewright.functions.paths import base_candidates, import_base, import_class, import_specifiers, suffix
from tracewright.operators.history import first_evidence
from tracewright.sources.buckets import remove


def link_facts(files: DataFrame, part: tuple[str, ...] = ()) -> DataFrame:
    """part, path, module, ordinal: import specifiers found in source texts (path, text), as functions.paths.import_specifiers() finds them."""
    found = files.select(*part, "path", F.posexplode(import_specifiers(F.col("text"))).alias("ordinal", "module"))
    return found


def resolve(imports: DataFrame, files: DataFrame, part: tuple[str, ...] = ()) -> DataFrame:
    """imports with `resolved`, the first candidate that is a file of the snapshot, and `target_class`.

    Resolution runs once per distinct (path, module) and joins candidates to known paths by equality. A base is made once, as a
    column, since each candidate is spelled from it.
    """
    asked = imports.where(F.col("module").startswith(".")).select(*part, "path", "module").distinct()
    based = asked.withColumn("__base", import_base(F.col("path"), F.col("module"))).withColumn("__end", suffix(F.col("__base")))
    tried = based.select(*part, "path", "module", F.posexplode(base_candidates(F.col("__base"), F.col("__end"))).alias("pos", "candidate"))
    known = files.select(*part, F.col("path").alias("candidate")).distinct()
    hit = tried.join(known, [*part, "candidate"]).groupBy(*part, "path", "module").agg(F.min_by("candidate", "pos").alias("resolved"))
    out = imports.join(hit, [*part, "path", "module"], "left")
    return out.withColumn("target_class", import_class(F.col("module"), F.col("resolved")))


def target_key(path: Column, module: Column, resolved: Column, kind: Column) -> Column:
    """Natural key of an import's target: a path, asset:<path> or external:<specifier>; null if unresolved."""
    asset = F.concat(F.lit("asset:"), F.coalesce(import_base(path, module), module))
    return F.when(kind == "resolved", resolved).when(kind == "asset", asset).when(kind == "external", F.concat(F.lit("external:"), module))


def link_graph(imports: DataFrame, files: DataFrame, part: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """nodes (kind, natural_key, n_evidence), edges (type, from_key, to_key) and diagnostics (code, path, module, n) of import facts."""
    r = resolve(imports, files, part).withColumn("to_key", target_key(F.col("path"), F.col("module"), F.col("resolved"), F.col("target_class")))
    file_nodes = files.select(*part, F.lit("FILE").alias("kind"), F.col("path").alias("natural_key")).distinct().withColumn("n_evidence", F.lit(1).cast("long"))
    outside = r.where(F.col("target_class").isin("asset", "external")).groupBy(*part, F.lit("MODULE").alias("kind"), F.col("to_key").alias("natural_key")).agg(F.count(F.lit(1)).alias("n_evidence"))
    edges = r.where("to_key is not null").select(*part, F.lit("IMPORTS").alias("type"), F.col("path").alias("from_key"), "to_key").distinct()
    missing = r.where("target_class = 'unresolved'").groupBy(*part, F.lit("UNRESOLVED_IMPORT").alias("code"), "path").agg(F.count(F.lit(1)).alias("n"))
    return {"nodes": file_nodes.unionByName(outside), "edges": edges, "diagnostics": missing}


def check_input(files: DataFrame, part: tuple[str, ...], sha: str) -> DataFrame:
    """The snapshots to reject: a sha that is no hexadecimal text, or a path that occurs twice."""
    bad = files.where(~F.coalesce(F.col(sha).rlike("(?i)^[0-9a-f]+$"), F.lit(False))).select(*part, F.lit("SHA").alias("reason"))
    twice = files.groupBy(*part, "path").count().where("count > 1").select(*part, F.lit("DUPLICATE_PATH").alias("reason"))
    return bad.unionByName(twice).distinct()


def structural_graph(files: DataFrame, symbols: DataFrame, exports: DataFrame, imports: DataFrame, diagnostics: DataFrame, part: tuple[str, ...] = ("repository_id", "snapshot_id"), most_evidence: int | None = None) -> dict[str, DataFrame]:
    """nodes, edges, evidence, diagnostics and node_evidence with stable ids; every fact cites evidence, equal facts merge.

    A node's evidence_ids are all of its evidence in order, which for a module is as long as it has importers. With most_evidence they are the first
    so many, cut in each task before a node's rows meet, so that no task holds a node's whole evidence; node_evidence (part, node_id, evidence_id) has
    all of it as rows either way.
    """
    ids = [F.col(c) for c in part]
    node = lambda kind, key: stable_id("node", *ids, F.lit(kind), key)
    ranged = lambda df, kind: df.withColumn("evidence_id", stable_id("ev", *ids, F.col("path"), span_text(F.col("span")), kind if isinstance(kind, Column) else F.lit(kind)))
    partial = diagnostics.select(*part, "path").distinct().withColumn("bad", F.lit(True))
    f = files.join(partial, [*part, "path"], "left").withColumn("evidence_id", stable_id("ev", *ids, F.col("path"), F.col("content_sha256"), F.lit("file"))).withColumn("node_id", node("FILE", F.col("path")))
    props = F.to_json(F.struct("language", "content_sha256", F.when(F.col("bad"), "PARTIAL").otherwise("COMPLETE").alias("parse_status")))
    out_nodes = f.select(*part, "node_id", F.lit("FILE").alias("kind"), F.col("path").alias("natural_key"), props.alias("properties"), F.array("evidence_id").alias("evidence_ids"))

    s = ranged(symbols, "symbol")
    key = F.concat(F.col("path"), F.lit("#"), F.col("kind"), F.lit(":"), F.col("name"), F.lit(":"), F.col("span.start_line").cast("string"), F.lit(":"), F.col("span.start_column").cast("string"))
    s = s.withColumn("natural_key", key).withColumn("symbol_id", node("SYMBOL", F.col("natural_key"))).withColumn("file_id", node("FILE", F.col("path")))
    props = F.to_json(F.struct("name", F.col("kind").alias("symbol_kind"), "exported", "path", "span"))
    symbol_nodes = merged(s.withColumn("node_id", F.col("symbol_id")), F.max(props), part, most_evidence).withColumn("kind", F.lit("SYMBOL"))

    e = ranged(exports.where("local_name is not null"), "export").withColumn("file_id", node("FILE", F.col("path")))
    exported = e.join(s.select(*part, "path", F.col("name").alias("local_name"), "symbol_id"), [*part, "path", "local_name"])

    i = resolve(ranged(imports, "import"), files, part).withColumn("to_key", target_key(F.col("path"), F.col("module"), F.col("resolved"), F.col("target_class")))
    i = i.withColumn("file_id", node("FILE", F.col("path"))).withColumn("to_id", F.when(F.col("target_class") == "resolved", node("FILE", F.col("to_key"))).otherwise(node("MODULE", F.col("to_key"))))
    asset = F.col("target_class") == "asset"
    props = F.to_json(F.struct(F.col("module").alias("specifier"), (~asset).alias("external"), F.when(asset, True).alias("asset")))
    later = F.struct("path", "ordinal")
    used = i.where(F.col("target_class").isin("asset", "external")).withColumn("node_id", F.col("to_id")).withColumn("natural_key", F.col("to_key"))
    module_nodes = merged(used, F.max_by(props, later), part, most_evidence).withColumn("kind", F.lit("MODULE"))
    cited = f.select(*part, "node_id", "evidence_id").unionByName(s.select(*part, F.col("symbol_id").alias("node_id"), "evidence_id")).unionByName(used.select(*part, "node_id", "evidence_id")).distinct()
    nodes = out_nodes.unionByName(symbol_nodes).unionByName(module_nodes)

    def edges(df: DataFrame, kind: str, to: str, order: Column) -> DataFrame:
        one = df.groupBy(*part, F.col("file_id").alias("from_node"), F.col(to).alias("to_node")).agg(F.max_by("evidence_id", order).alias("evidence_id"))
        return one.select(*part, stable_id("edge", *ids, F.lit(kind), F.col("from_node"), F.col("to_node")).alias("edge_id"), F.lit(kind).alias("kind"), "from_node", "to_node", F.lit(1.0).alias("confidence"), "evidence_id")

    found = i.where("to_key is not null")
    all_edges = edges(s, "DECLARES", "symbol_id", F.col("span")).unionByName(edges(exported, "EXPORTS", "symbol_id", F.col("span"))).unionByName(edges(found, "IMPORTS", "to_id", later))

    d = ranged(diagnostics, F.col("code")).select(*part, "code", "message", "path", "span", "evidence_id")
    lost = i.where("target_class = 'unresolved'").select(*part, F.lit("UNRESOLVED_IMPORT").alias("code"), F.concat(F.lit("Relative import could not be resolved: "), "module").alias("message"), "path", "span", "evidence_id")
    spans = [x.select(*part, "evidence_id", F.lit("source_range").alias("kind"), "path", "span") for x in (s, exported, i, d)]
    evidence = f.select(*part, "evidence_id", F.lit("source_file").alias("kind"), "path", F.lit(None).cast(symbols.schema["span"].dataType).alias("span"))
    for x in spans:
        evidence = evidence.unionByName(x)
    return {"nodes": nodes, "edges": all_edges, "evidence": evidence.dropDuplicates([*part, "evidence_id"]), "diagnostics": d.unionByName(lost), "node_evidence": cited}


def merged(rows: DataFrame, properties: Column, part: tuple[str, ...], most: int | None) -> DataFrame:
    """part, node_id, natural_key, properties, evidence_ids of the facts (with evidence_id) about each node."""
    keys = [*part, "node_id", "natural_key"]
    if most is None:
        return rows.groupBy(*keys).agg(properties.alias("properties"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    first = first_evidence(rows.select(*keys, "evidence_id"), keys, "evidence_id", [F.col("evidence_id")], most, "evidence_ids")
    return rows.groupBy(*keys).agg(properties.alias("properties")).join(first, keys)


def import_relations(edges: DataFrame, nodes: DataFrame, part: tuple[str, ...] = ("repository_id", "snapshot_id")) -> DataFrame:
    """part, source, target, weight, evidence of the IMPORTS edges by natural keys; an edge that lacks a node at either end is dropped."""
    end = lambda side, name: nodes.select(*part, F.col("node_id").alias(f"{side}_node"), F.col("natural_key").alias(name))
    found = edges.where("kind = 'IMPORTS'").join(end("from", "source"), [*part, "from_node"]).join(end("to", "target"), [*part, "to_node"])
    return found.select(*part, "source", "target", F.col("confidence").alias("weight"), F.array(F.concat(F.lit("evidence:"), "evidence_id")).alias("evidence"))


def page(nodes: DataFrame, edges: DataFrame, after: tuple[str, str] | None = None, limit: int = 1000) -> DataFrame:
    """kind, node_key, n_edges (edges with both ends on the page) of the nodes after a (kind, key), in that order."""
    limit = min(limit, 1000)
    rows = nodes.select("kind", F.col("natural_key").alias("node_key"))
    if after:
        rows = rows.where(F.struct("kind", "node_key") > F.struct(F.lit(after[0]).alias("kind"), F.lit(after[1]).alias("node_key")))
    rows = rows.orderBy("kind", "node_key").limit(limit)
    on_page = F.broadcast(rows.select("node_key"))  # at most 1000 rows
    inside = edges.join(on_page.withColumnRenamed("node_key", "from_key"), "from_key", "left_semi").join(on_page.withColumnRenamed("node_key", "to_key"), "to_key", "left_semi")
    n = inside.groupBy(F.col("from_key").alias("node_key")).agg(F.count(F.lit(1)).alias("n_edges"))
    return rows.join(n, "node_key", "left").select("node_key", "kind", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"))


#: Nodes of a stored run, on average.
RUN = 1 << 18


def store_nodes(nodes: DataFrame, path: str, run: int = RUN) -> None:
    """Write nodes (kind, natural_key, ...) sorted by (kind, natural_key) as runs of about `run` nodes, and an index of the runs.

    The index (run, n, first, last), last and first being (kind, natural_key), lets a page be read from the run or two that hold it.
    """
    spark = nodes.sparkSession
    nodes.write.parquet(f"{path}/staged")  # counting, sampling and sorting read it
    nodes = spark.read.schema(nodes.schema).parquet(f"{path}/staged")
    runs = max(1, -(-nodes.count() // run))
    dealt = nodes.repartitionByRange(runs, "kind", "natural_key").withColumn("run", F.spark_partition_id())
    dealt.sortWithinPartitions("kind", "natural_key").write.partitionBy("run").parquet(f"{path}/rows")
    key = F.struct("kind", "natural_key")
    spark.read.parquet(f"{path}/rows").groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last")).coalesce(1).write.parquet(f"{path}/index")
    remove(spark, f"{path}/staged")


@dataclass(frozen=True)
class Page:
    nodes: DataFrame
    #: The (kind, natural_key) after which the next page begins; None on the last page.
    cursor: tuple[str, str] | None
    #: The stored runs that were read.
    runs: list[int]


def read_page(spark: SparkSession, path: str, after: tuple[str, str] | None = None, limit: int = 1000, offset: int = 0) -> Page:
    """The nodes after a (kind, natural_key) in that order, at most `limit` (1000), from stored runs; `offset` nodes of them are passed over.

    One node more than asked for is looked at, which tells whether there is a next page. The driver holds the index's rows of a page.
    """
    limit = min(limit, 1000)
    key = F.struct("kind", "natural_key")
    beyond = lambda c: c > F.struct(F.lit(after[0]).alias("kind"), F.lit(after[1]).alias("natural_key")) if after else F.lit(True)
    index = spark.read.parquet(f"{path}/index").where(beyond(F.col("last"))).withColumn("whole", beyond(F.col("first")))
    # Nodes of runs that begin after the cursor count in full, those of the run that the cursor is in not at all.
    before = F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)).over(Window.orderBy("first")) - F.when(F.col("whole"), F.col("n")).otherwise(0)
    ahead = index.withColumn("before", before)  # a row per run
    # Without a cursor whole runs are passed over; after one the count in its run is not known.
    passed = F.lit(after is None) & (F.col("before") + F.col("n") <= offset)
    chosen = ahead.where(F.col("before") <= offset + limit).select("run", "n", passed.alias("passed")).collect()
    skipped = sum(r.n for r in chosen if r.passed)
    runs = sorted(r.run for r in chosen if not r.passed)
    if not runs:
        return Page(spark.read.parquet(f"{path}/rows").where(F.lit(False)).drop("run"), None, [])
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/run={r}" for r in runs)).drop("run").where(beyond(key))
    rows = rows.orderBy("kind", "natural_key").offset(offset - skipped).limit(limit + 1)
    last = rows.select("kind", "natural_key").orderBy("kind", "natural_key").collect()  # limit + 1 keys
    return Page(rows.limit(limit), tuple(last[limit - 1]) if len(last) > limit else None, runs)


def first_diagnostics(diagnostics: DataFrame, limit: int = 250) -> DataFrame:
    """The diagnostics that a page shows: the first by (path, code, message), at most 250."""
    return diagnostics.orderBy("path", "code", "message").limit(min(limit, 250))


def evidence_lookup(evidence: DataFrame, ids: list[str], published: DataFrame | None = None) -> DataFrame:
    """The evidence rows of ids, of published snapshots only."""
    found = evidence.where(F.col("evidence_id").isin(ids))
    return found.join(published.select("snapshot_id"), "snapshot_id", "left_semi") if published is not None else found


def summary(df: DataFrame, kind: str = "kind", part: tuple[str, ...] = ()) -> DataFrame:
    """part, kind, n: counts per kind of node or edge."""
    return df.groupBy(*part, kind).agg(F.count(F.lit(1)).alias("n"))

"""The engine's inputs as derived from the given tables; nothing else knows these tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.dealing import dealt, tasks_for
from tracewright.sources.readers import load_table

LINK = r'href="(/[^"]*)"'


def line_tasks(spark: SparkSession, d: str) -> int | None:
    """How many tasks the line items, and what is made of them, are dealt over."""
    return tasks_for(spark, load_table(spark, d, "lineitem").count())


def changes(spark: SparkSession, d: str) -> DataFrame:
    """commit = order, path = brand/type/part, commit_churn = the order's quantity; a row per line item, which the operators make distinct."""
    lines, n = load_table(spark, d, "lineitem"), line_tasks(spark, d)
    churn = dealt(lines.select("l_orderkey", "l_quantity"), n, "l_orderkey").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("commit_churn"))
    # By its file's size Spark takes a table of millions of rows for a small one, and a task then holds all of it.
    spread = lambda df, key: dealt(df, n, key).hint("merge") if n else df
    located = dealt(lines.select("l_orderkey", "l_partkey"), n, "l_partkey").join(spread(parts(spark, d), "p_partkey"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "path")
    rows = dealt(located, n, "l_orderkey").join(churn.hint("merge") if n else churn, "l_orderkey")
    orders = load_table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("authored_at"))
    return rows.join(spread(orders, "l_orderkey"), "l_orderkey").select(F.col("l_orderkey").alias("commit"), "path", "authored_at", "commit_churn")


def parts(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("path"))


def supplier_changes(spark: SparkSession, d: str) -> DataFrame:
    """The dense variant: path = zero-padded supplier."""
    rows = load_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.lpad(F.col("l_suppkey").cast("string"), 8, "0").alias("path"))
    return dealt(rows, line_tasks(spark, d), "commit").distinct()


def supplier_imports(spark: SparkSession, d: str) -> DataFrame:
    """source, target: a supplier and the next one of its nation."""
    s = load_table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    key = lambda c: F.lpad(F.col(c).cast("string"), 8, "0")
    later = s.select(F.col("s_suppkey").alias("k2"), F.col("s_nationkey").alias("n2"))
    pairs = s.join(later, (F.col("s_nationkey") == F.col("n2")) & (F.col("s_suppkey") < F.col("k2"))).groupBy("s_suppkey").agg(F.min("k2").alias("k2"))
    return pairs.select(key("s_suppkey").alias("source"), key("k2").alias("target"))


def touching(rel: DataFrame, path: str) -> DataFrame:
    """The relations of one path, which are all that its impact depends on: no others need be sorted and joined."""
    return rel.where((F.col("source") == path) | (F.col("target") == path))


def reports(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The first user turn of each conversation."""
    first = reports(spark, d).groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select(F.col("conv_id").alias("query_id"), "text")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "documents").select("doc_id", F.lit("document").alias("kind"), "text", F.lit(None).cast("timestamp_ntz").alias("at"))


def page_paths(spark: SparkSession, d: str) -> DataFrame:
    """page_id, url, host, path (host/flattened path), section (host/section.ts, a section being the first segment of the page's path), links (array of site-relative specifiers)."""
    p = load_table(spark, d, "pages")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    rest = F.regexp_extract("url", r"^https?://[^/?#]+(/[^?#]*)?", 1)
    flat = F.replace(F.regexp_replace(rest, "^/+|/+$", ""), F.lit("/"), F.lit("~"))
    section = F.regexp_extract(rest, "^/+([^/]*)", 1)
    links = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda h: F.concat(F.lit("./"), F.replace(F.regexp_replace(h, "^/+", ""), F.lit("/"), F.lit("~"))))
    path = F.concat(host, F.lit("/"), F.when(flat == "", "index.ts").otherwise(flat))
    section = F.concat(host, F.lit("/"), F.when(section == "", "index").otherwise(section), F.lit(".ts"))
    return p.select("page_id", "url", host.alias("host"), path.alias("path"), section.alias("section"), links.alias("links")).where("host != ''")


def page_files(spark: SparkSession, d: str) -> DataFrame:
    """Every page is a file, and so is every section, which the links name."""
    return page_paths(spark, d).select(F.explode(F.array("path", "section")).alias("path")).distinct()


def page_imports(spark: SparkSession, d: str) -> DataFrame:
    return page_paths(spark, d).select("path", F.explode("links").alias("module"))

"""Readers of repository history exports, validation and volume guards.

Every reader returns (good, rejected): malformed rows are set aside, not fatal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.paths import is_source, valid_object_id, valid_ref
from tracewright.functions.text import strip

#: Lengths to which authors and messages are cut, and the longest path.
AUTHOR, MESSAGE, PATH = 500, 10_000, 1_000


def load_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table of a folder; JSON and CSV take an explicit schema."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(f"{folder}/{name}.{fmt}")


def validate(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(good, F.lit(False))
    return df.where(ok), df.where(~ok)


def read_commit_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """commits (commit, parent_shas, author, author_email, authored_at, message) of log exports: records end in 1E, fields in 00."""
    raw = spark.read.option("lineSep", "\x1e").text(path).withColumn("f", F.split("value", "\x00"))
    at = lambda i: F.get("f", F.lit(i))
    parents = F.filter(F.split(F.coalesce(at(1), F.lit("")), r"\s+"), lambda p: p != "")
    rows = raw.where(strip(F.col("value")) != "").select("value", F.size("f").alias("n"), strip(at(0)).alias("commit"), parents.alias("parent_shas"), F.substring(at(2), 1, AUTHOR).alias("author"), F.substring(at(3), 1, AUTHOR).alias("author_email"), F.try_to_timestamp(strip(at(4))).alias("authored_at"), strip(F.substring(at(5), 1, MESSAGE)).alias("message"))
    good, bad = validate(rows, (F.col("n") >= 6) & valid_object_id(F.col("commit")) & F.col("authored_at").isNotNull() & F.forall("parent_shas", valid_object_id))
    return good.drop("value", "n"), bad.select("value")


def read_manifest(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (mode, blob_sha, size, path) of tree listings (value): `mode type sha size<tab>path`; blobs only, paths up to 1000 characters."""
    p = r"^(\d{6}) (\w+) ([0-9a-f]+)\s+(\d+|-)\t(.*)$"
    get = lambda i: F.regexp_extract("value", p, i)
    rows = listing.select("value", get(1).alias("mode"), get(2).alias("type"), get(3).alias("blob_sha"), get(4).try_cast("long").alias("size"), get(5).alias("path"))
    good, bad = validate(rows, (F.col("mode") != "") & valid_object_id(F.col("blob_sha")) & F.length("path").between(1, PATH) & (F.col("size").isNotNull() | (F.col("type") != "blob")))
    return good.where("type = 'blob'").drop("value", "type"), bad.select("value")


def read_refs(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """refs (name, head_sha), in order of name, of lines `sha<blank>name`."""
    rows = listing.select("value", F.substring_index("value", " ", 1).alias("head_sha"), F.regexp_replace("value", r"^\S+\s+", "").alias("name"))
    good, bad = validate(rows, valid_object_id(F.col("head_sha")) & valid_ref(F.col("name")))
    return good.select("name", "head_sha").orderBy("name"), bad.select("value")


def read_sources(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, content, sha256 of files below path; rows whose content has another length are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.where(F.length("content") == F.col("length")).select("path", F.col("length").alias("size"), "content", F.sha2("content", 256).alias("sha256"))


def commit_changes(numstat: DataFrame, commits: DataFrame, part: tuple[str, ...] = ()) -> DataFrame:
    """part, commit, authored_at, files, churn of commits that are no merges; numstat: (part, commit, old_path, new_path, added, deleted)."""
    lines = numstat.withColumn("path", F.coalesce("new_path", "old_path")).where(F.length("path") <= PATH)
    churn = F.sum(F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0)))
    per = lines.groupBy(*part, "commit").agg(F.sort_array(F.collect_set("path")).alias("files"), churn.cast("long").alias("churn"))
    single = commits.where(F.size(F.coalesce("parent_shas", F.array().cast("array<string>"))) <= 1).select(*part, "commit", "authored_at")
    out = single.join(per, [*part, "commit"], "left")
    return out.withColumn("files", F.coalesce("files", F.array().cast("array<string>"))).withColumn("churn", F.coalesce("churn", F.lit(0).cast("long")))


def exploded(commits: DataFrame, part: tuple[str, ...] = ()) -> DataFrame:
    """commit_changes() as rows (part, commit, path, authored_at, commit_churn)."""
    return commits.select(*part, "commit", F.explode("files").alias("path"), "authored_at", F.col("churn").alias("commit_churn"))


def select_sources(manifest: DataFrame, most_bytes: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(candidates, skipped as oversized) of a manifest (path, mode, size)."""
    rows = manifest.where(is_source(F.col("path"), F.col("mode")))
    return rows.where(F.col("size") <= most_bytes), rows.where(F.col("size") > most_bytes)


def volume_guard(manifest: DataFrame, part: tuple[str, ...], most_files: int = 10_000, most_bytes: int = 100_000_000) -> DataFrame:
    """part, n_files, n_bytes, over: repositories over a limit are flagged; the job goes on."""
    out = manifest.groupBy(*part).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").cast("long").alias("n_bytes"))
    return out.withColumn("over", (F.col("n_files") > most_files) | (F.col("n_bytes") > most_bytes))


def with_analyzed(manifest: DataFrame, analysed: DataFrame, part: tuple[str, ...] = ()) -> DataFrame:
    """manifest with `analyzed`: whether the path is among the analysed files."""
    seen = analysed.select(*part, "path").distinct().withColumn("__a", F.lit(True))
    return manifest.join(seen, [*part, "path"], "left").withColumn("analyzed", F.col("__a").isNotNull()).drop("__a")

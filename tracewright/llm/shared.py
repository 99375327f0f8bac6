"""Shared-folder tables and connected components for the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
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


#: Lets Spark delete a query's shuffle files when the query ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, so that its lineage ends here.

    The shuffle files of the write go with its end: nothing reads them again.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once all that was made of them is written, too."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges as (id, component): the smallest id reachable.

    Alternates the large-star and small-star steps until the edges are stars. The rounds grow with the
    logarithm of the longest path, so max_rounds is far beyond any graph; using them up is an error.
    Minima are aggregated (with partial sums in each task) and written before they are joined, so that
    both sides of a join come straight from a shuffle and Spark can split a node of very high degree.
    Only nodes that have an edge appear. Null ends and self-loops are dropped.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(e.select(hi.alias("u"), lo.alias("v")).distinct(), "cc")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        star = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v"), "star")
        low = cut(star.groupBy("u").agg(F.min("v").alias("m")), "low")
        own = low.select("u", F.col("m").alias("v"))
        last, e = e, cut(star.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct(), "cc")
        discard(last, least, star, low)
        # Stars already: every node has one edge down, to a node that has none.
        down = e.groupBy("u").agg(F.count("v").alias("n"))
        if down.where("n > 1").isEmpty() and e.select(F.col("v").alias("u")).distinct().join(down, "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots).groupBy("id").agg(F.min("component").alias("component"))

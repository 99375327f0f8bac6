"""Immutable snapshots and incremental history tables on Parquet.

A snapshot's tables are written first, each attempt into partitions of its own. Then its manifest entry, a file named after repository and
commit, is created if there is none yet: of several writers of one commit one wins, and the rows of the others are never
read, as readers join the manifest. An entry that is not complete is ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.sources.buckets import file_system

ENTRY = "repository_id string, snapshot_id string, attempt string, commit_sha string, published long"
PLACE = ["repository_id", "snapshot_id", "attempt"]


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """repository_id, snapshot_id, attempt, commit_sha, published_at of what is published."""
    try:
        rows = spark.read.schema(ENTRY).option("mode", "DROPMALFORMED").json(f"{root}/snapshots")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], ENTRY)
    return rows.where("published is not null").withColumn("published_at", F.timestamp_micros("published")).drop("published")


def entry(root: str, repository_id: str, commit_sha: str) -> str:
    return f"{root}/snapshots/{hashlib.sha256(chr(31).join((repository_id, commit_sha)).encode()).hexdigest()}.json"


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that is not there yet; False if it is."""
    fs, p = file_system(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "AlreadyExists" not in str(e):
            raise
        return False
    out.write(text.encode())
    out.close()
    return True


def publish_snapshot(spark: SparkSession, root: str, repository_id: str, snapshot_id: str, commit_sha: str, tables: dict[str, DataFrame], published_at: Column | None = None) -> bool:
    """Write the tables of one snapshot and, last, its manifest entry. False if the commit is published, by then or meanwhile."""
    fs, p = file_system(spark, entry(root, repository_id, commit_sha))
    if fs.exists(p):
        return False
    place = dict(zip(PLACE, (repository_id, snapshot_id, uuid.uuid4().hex), strict=True))
    for name, df in tables.items():
        df.withColumns({c: F.lit(v) for c, v in place.items()}).write.mode("append").partitionBy(*PLACE).parquet(f"{root}/{name}")
    at = spark.range(1).select(F.unix_micros((published_at if published_at is not None else F.current_timestamp()).cast("timestamp"))).first()[0]
    return create(spark, entry(root, repository_id, commit_sha), json.dumps(place | {"commit_sha": commit_sha, "published": at}) + "\n")


def read_snapshot(spark: SparkSession, root: str, name: str, commit_sha: str | None = None) -> DataFrame:
    """A table's rows of each repository's newest published snapshot, or of one commit."""
    m = manifest(spark, root)
    if commit_sha:
        m = m.where(F.col("commit_sha") == commit_sha)
    w = Window.partitionBy("repository_id").orderBy(F.desc("published_at"), "snapshot_id")
    newest = m.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*PLACE)
    return spark.read.parquet(f"{root}/{name}").join(newest, PLACE, "left_semi").drop("attempt")


def append_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of incoming whose key is not in existing, one for each key."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """One row per key of both: the one observed last."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return existing.unionByName(incoming).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")

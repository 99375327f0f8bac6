"""Tables of one row per key in buckets: an upsert rewrites the buckets that it touches, and no other.

A row's bucket is the hash of its key. Version n of a table is its manifest, root/manifest/v=<n>, which names for each bucket the
version whose rows it holds, below root/rows/v=<m>/bucket=<b>. An upsert reads the buckets of its keys, writes them anew
under its own version and its manifest last; the newest manifest that is complete is the table. So a failed upsert changes nothing
that is read, and the same version written again changes nothing either. The versions that the last but one manifest alone
names are deleted, so that a reader of the last one is not disturbed.

The driver holds one manifest: a number per bucket. A bucket is written by one task: choose their number so that a bucket fits.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions whose manifest is complete, oldest first."""
    fs, p = file_system(spark, f"{root}/manifest")
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    done = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("v=")) for n in done)


def manifest(spark: SparkSession, root: str, version: int) -> dict[int, int]:
    """bucket to the version that holds its rows."""
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{root}/manifest/v={version}").collect()}


def folder(root: str, version: int, bucket: int) -> str:
    return f"{root}/rows/v={version}/bucket={bucket}"


def newest(spark: SparkSession, root: str) -> DataFrame:
    """The table's rows."""
    held = versions(spark, root)
    if not held:
        raise ValueError(f"there is no table at {root}")
    return spark.read.parquet(*(folder(root, v, b) for b, v in sorted(manifest(spark, root, held[-1]).items())))


def last_of(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """bucket, and the row of each key that is last by (at, tie), summed up in the tasks before it is shuffled."""
    whole = F.max_by(F.struct(*rows.drop("bucket").columns), F.struct(F.col(at), F.col(tie))).alias("x")
    return rows.groupBy("bucket", *(F.col(k).alias(f"__{k}") for k in keys)).agg(whole).select("bucket", "x.*")


def upsert(root: str, batch: DataFrame, keys: list[str], at: str, tie: str, version: int, buckets: int = BUCKETS) -> list[int]:
    """Put the rows of batch into the table as its version `version`, the last of each key by (at, tie); the buckets rewritten.

    Nothing is done for a version that is there already, or older than one that is, nor for a batch without rows. `buckets` is the table's for good.
    """
    spark = batch.sparkSession
    held = versions(spark, root)
    if held and version <= held[-1]:
        return []
    before = manifest(spark, root, held[-1]) if held else {}
    number = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    incoming = last_of(batch.withColumn("bucket", number), keys, at, tie)
    changed = sorted(r.bucket for r in incoming.select("bucket").distinct().collect())  # one number per bucket
    if not changed:
        return []
    rows = incoming
    if stored := [folder(root, before[b], b) for b in changed if b in before]:
        rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*stored).withColumn("bucket", number))
    last_of(rows.repartition("bucket"), keys, at, tie).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/rows/v={version}")
    now = before | dict.fromkeys(changed, version)
    spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/v={version}")
    if len(held) > 1:
        for b, v in manifest(spark, root, held[-2]).items():
            if before.get(b) != v:
                remove(spark, folder(root, v, b))
        remove(spark, f"{root}/manifest/v={held[-2]}")
    return changed

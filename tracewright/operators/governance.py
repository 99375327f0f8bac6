"""Retention over several levels of tables, idempotent writes and admission."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.sources.buckets import remove


@dataclass(frozen=True)
class Stored:
    """A table on Parquet under a retention rule, partitioned by the column `by`.

    A root has the time of its rows in `at` and expires before `cutoff`; another table's rows go with the parent's row whose `parent_key`
    their column `on` holds.
    """

    path: str
    by: str
    at: str | None = None
    cutoff: Column | None = None
    parent: str | None = None
    parent_key: str | None = None
    on: str | None = None


def expiring(spark: SparkSession, tables: dict[str, Stored]) -> dict[str, DataFrame]:
    """The rows of each table that go, parents before children in `tables`. Rows without a time or a parent's key stay."""
    out: dict[str, DataFrame] = {}
    for name, t in tables.items():
        rows = spark.read.parquet(t.path)
        out[name] = rows.where(F.col(t.at) < t.cutoff) if t.parent is None else rows.join(out[t.parent].select(F.col(t.parent_key).alias(t.on)).distinct(), t.on, "left_semi")
    return out


def partition_path(t: Stored, value: object) -> str:
    text = "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)
    if not re.fullmatch(r"[\w.-]+", text):
        raise ValueError(f"values of {t.by} must be plain words or numbers: {text}")
    return f"{t.path}/{t.by}={text}"


def purge(spark: SparkSession, tables: dict[str, Stored]) -> dict[str, list[str]]:
    """Delete what expires, children before parents; the partitions rewritten or removed of each table.

    Only partitions that lose rows are written anew, each swapped in when it is complete; the files of others stay. Parents go last, so that a run
    that broke off can be run again. The driver holds a table's partition values. The audit trail is not among the tables.
    """
    gone, touched = expiring(spark, tables), {}
    for name, t in reversed(tables.items()):
        lost = [r[0] for r in gone[name].select(t.by).distinct().collect()]
        touched[name] = sorted(map(str, lost))
        if not lost:
            continue
        some = F.col(t.by).isin([x for x in lost if x is not None])
        hit = spark.read.parquet(t.path).where(F.coalesce(some, F.lit(False)) | F.col(t.by).isNull() if None in lost else some)
        if t.parent is None:
            kept = hit.where(~(F.col(t.at) < t.cutoff) | F.col(t.at).isNull())
        else:
            kept = hit.join(gone[t.parent].select(F.col(t.parent_key).alias(t.on)).distinct(), t.on, "left_anti")
        left = {r[0] for r in kept.select(t.by).distinct().collect()}
        if left:
            kept.select(hit.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(t.by).parquet(t.path)
        for value in lost:
            if value not in left:
                remove(spark, partition_path(t, value))
    return touched


def idempotent_writes(requests: DataFrame, keys: list[str], order: list[str], fingerprint: str, resource: str) -> DataFrame:
    """keys, first_<resource>, n_replays, n_conflicts: the first write of a key counts; later ones with its fingerprint are replays, others conflicts."""
    first = requests.groupBy(*keys).agg(F.min(F.struct(*order, F.col(fingerprint).alias("__f"), F.col(resource).alias("__v"))).alias("f")).select(*keys, F.col("f.__f").alias("__fp"), F.col("f.__v").alias(f"first_{resource}"))
    rows = requests.join(first, keys)
    same = F.col(fingerprint).eqNullSafe(F.col("__fp"))
    return rows.groupBy(*keys, f"first_{resource}").agg((F.count_if(same) - 1).alias("n_replays"), F.count_if(~same).alias("n_conflicts"))


def admit(events: DataFrame, key: str, at: str, event: str, limit: int, seconds: float = 60.0) -> DataFrame:
    """key, event, admitted: at most `limit` admitted events of a key in any `seconds`; rejected ones do not count.

    An admission depends on earlier ones, so each key is walked in order; rows of a key arrive sorted,
    in batches, and only the admitted times of the last window are kept.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    rows = events.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("__t"), event).repartition(key).sortWithinPartitions(key, "__t", event)
    span = int(seconds * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, window = None, deque()
        for pdf in batches:
            admitted = []
            for k, t in zip(pdf[key], pdf["__t"], strict=True):
                if k != current:
                    current, window = k, deque()
                while window and window[0] <= t - span:
                    window.popleft()
                admitted.append(ok := len(window) < limit)
                if ok:
                    window.append(t)
            yield pd.DataFrame({key: pdf[key], event: pdf[event], "admitted": admitted})

    return rows.mapInPandas(run, f"{key} {kinds[key]}, {event} {kinds[event]}, admitted boolean")


def newest_events(events: DataFrame, by: str, tie: str, limit: int = 10_000) -> DataFrame:
    """The newest audit events, at most 10,000."""
    return events.orderBy(F.desc(by), tie).limit(min(limit, 10_000))


def latest_state(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")

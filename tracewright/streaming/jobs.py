"""Incremental ingest as streams: commit deduplication and branch heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tracewright.sources.buckets import BUCKETS, upsert
from tracewright.sources.snapshots import append_new


def dedup_commits(stream: DataFrame, keys: list[str], at: str, lateness: str = "1 day") -> DataFrame:
    """First sight of each key within the watermark; state is bounded by `lateness`."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def append_stream(stream: DataFrame, table: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Append the rows of each batch whose key the Parquet table at `table` lacks: history without a bound."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        append_new(existing(spark, table, batch), batch, keys).write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(stream: DataFrame, root: str, checkpoint: str, keys: list[str], at: str, tie: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the last row of each key in the bucketed table at root: a batch rewrites the buckets of its keys; sources.buckets.newest() reads it."""

    def put(batch: DataFrame, number: int) -> None:
        upsert(root, batch, keys, at, tie, number, buckets)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def existing(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The Parquet table at path, or no rows like `like`'s."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], like.schema)

"""How many tasks rows are dealt over, so that what a task holds does not grow with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task, on average, beyond which they are dealt over more tasks.
ROWS = 1 << 17


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Tasks for so many rows, or None if Spark's own number, which may be as few as there are cores, keeps them below ROWS each."""
    if rows <= ROWS * spark.sparkContext.defaultParallelism:
        return None
    return max(-(-rows // ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """df by hash of keys over so many tasks, which are not merged again; as it is for None."""
    return df.repartition(tasks, *keys) if tasks else df

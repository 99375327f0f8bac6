"""Sinks: audit exports and report documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracewright.functions.text import spreadsheet_safe
from tracewright.operators.governance import newest_events


def export_audit(events: DataFrame, path: str, fmt: str = "json", limit: int = 10_000, by: str = "created_at", tie: str = "id") -> None:
    """The newest events as JSON lines, or as CSV whose cells no spreadsheet takes for formulas."""
    rows = newest_events(events, by, tie, limit)
    if fmt == "csv":
        rows = rows.select(*(spreadsheet_safe(F.col(c).cast("string")).alias(c) for c in rows.columns))
        rows.write.option("header", True).csv(path)
    elif fmt == "json":
        rows.write.json(path)
    else:
        raise ValueError("fmt must be json or csv")


def write_reports(documents: DataFrame, path: str, key: str = "report_id") -> None:
    """One text file a report below path/<key>=<value>; documents: (key, body)."""
    documents.select(key, F.col("body").alias("value")).repartition(key).write.partitionBy(key).text(path)


def write_counted(df: DataFrame, path: str, measures: dict[str, Column] | None = None, most: dict[str, int] | None = None) -> dict[str, int | bool]:
    """Write df as Parquet and return its rows, further measures, and whether one is over its bound: all in the pass that writes."""
    seen = Observation()
    named = {"rows": F.count(F.lit(1))} | (measures or {})
    df.observe(seen, *(c.alias(n) for n, c in named.items())).write.mode("overwrite").parquet(path)
    got = {n: seen.get[n] for n in named}
    return got | {"over": any((got[n] or 0) > bound for n, bound in (most or {}).items())}

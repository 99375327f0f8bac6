"""Snapshot selection, repository pages, ledgers and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: tuple[str, ...], order: list[Column]) -> DataFrame:
    """One row per key: the first by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def latest_snapshot(snapshots: DataFrame, key: str = "repository_id", sha: str | None = None, as_of: Column | None = None) -> DataFrame:
    """The newest published snapshot of each repository; of one sha, or published by as_of, on request."""
    rows = snapshots.where("published_at is not null")
    if sha:
        rows = rows.where(F.col("commit_sha") == sha)
    if as_of is not None:
        rows = rows.where(F.col("published_at") <= as_of)
    return latest(rows, (key,), [F.desc("published_at"), F.col("snapshot_id")])


def inventory(rows: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """rows with rn (the first `limit` of each key) and truncated (whether the key has more); one row beyond the limit tells."""
    w = Window.partitionBy(key)
    ranked = rows.withColumn("rn", F.row_number().over(w.orderBy(*order))).where(F.col("rn") <= limit + 1)
    return ranked.withColumn("truncated", F.max("rn").over(w) > limit).where(F.col("rn") <= limit)


def architecture(hotspots: DataFrame, pairs: DataFrame, modules: DataFrame, top_files: int = 20, top_pairs: int = 100) -> DataFrame:
    """section, key, value, rank: top hotspots, top co-change pairs and all modules; empty without modules."""

    def ranked(df: DataFrame, section: str, key: Column, value: Column, most: int | None) -> DataFrame:
        rows = df.select(key.alias("key"), value.cast("double").alias("value"))
        if most:
            rows = rows.orderBy(F.desc("value"), "key").limit(most)  # a bounded top-n, ranked in one task
        return rows.select(F.lit(section).alias("section"), "key", "value", F.row_number().over(Window.orderBy(F.desc("value"), "key")).alias("rank"))

    parts = ranked(hotspots, "hotspot", F.col("path"), F.col("score"), top_files)
    parts = parts.unionByName(ranked(pairs, "pair", F.concat_ws("|", "left_path", "right_path"), F.col("confidence"), top_pairs))
    mods = modules.select(F.lit("module").alias("section"), F.col("module").alias("key"), F.col("confidence").alias("value"), F.lit(0).alias("rank"))
    present = modules.limit(1).select(F.lit(1).alias("__one"))
    return parts.unionByName(mods).crossJoin(F.broadcast(present)).drop("__one")  # one row or none


def run_ledger(events: DataFrame, key: str = "run_id", terminal: tuple[str, ...] = ("SUCCEEDED", "FAILED")) -> DataFrame:
    """The state of each run by events (key, state, seq): the first terminal event is final, else the last event counts."""
    done = F.col("state").isin(*terminal)
    order = F.struct((~done).alias("open"), F.when(done, F.col("seq")).otherwise(-F.col("seq")).alias("at"))
    return events.groupBy(key).agg(F.min_by(F.struct("state", "seq"), order).alias("x")).select(key, "x.state", "x.seq")


def record_feedback(answers: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(latest rating of each (answer_id, user_id), rejected rows: unknown answers and ratings outside -1 to 1)."""
    ok = F.coalesce(F.col("rating").between(-1, 1), F.lit(False))
    known = feedback.where(ok).join(answers.select("answer_id"), "answer_id", "left_semi")
    orphans = feedback.join(answers.select("answer_id"), "answer_id", "left_anti").unionByName(feedback.where(~ok).join(answers.select("answer_id"), "answer_id", "left_semi"))
    return latest(known, ("answer_id", "user_id"), [F.desc("created_at"), F.desc("rating")]), orphans


def tenant_visibility(rows: DataFrame, memberships: DataFrame, user: str, on: str = "workspace_id") -> DataFrame:
    """The rows of the workspaces that the user is a member of."""
    return rows.join(memberships.where(F.col("user_id") == user).select(on).distinct(), on, "left_semi")


def newest_first(rows: DataFrame, workspace: str | None = None, by: str = "created_at", tie: str = "id") -> DataFrame:
    """A tenant's rows, newest first; a presentation sort."""
    rows = rows if workspace is None else rows.where(F.col("workspace_id") == workspace)
    return rows.orderBy(F.desc(by), tie)


def run_summary(**tables: DataFrame) -> DataFrame:
    """what, n: the number of rows of each table, in one job."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out

"""Risk and impact ranking, and the evaluation of scores against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.dealing import dealt
from tracewright.operators.history import share, with_max


def risk(hotspots: DataFrame, part: tuple[str, ...] = ()) -> DataFrame:
    """part, path, score, hotspot, change_frequency, relative_churn, rationale of hotspots (path, commit_count, churn, score)."""
    both = with_max(hotspots, part, mc="commit_count", mh="churn")
    f, c = share(F.col("commit_count"), F.col("mc")), share(F.col("churn"), F.col("mh"))
    out = both.select(*part, "path", F.col("score").alias("hotspot"), f.alias("change_frequency"), c.alias("relative_churn"))
    score = F.lit(0.55) * F.col("hotspot") + F.lit(0.25) * F.col("change_frequency") + F.lit(0.2) * F.col("relative_churn")
    why = F.format_string("Relative risk combines hotspot (%.2f), change frequency (%.2f), and churn (%.2f).", "hotspot", "change_frequency", "relative_churn")
    return out.withColumn("score", score).withColumn("rationale", why)


def relations(co_changes: DataFrame, imports: DataFrame | None = None, part: tuple[str, ...] = ()) -> DataFrame:
    """part, source, target, kind, weight, evidence of co-change pairs and import edges (source, target).

    Evidence is commit:<commit> of the pairs' evidence, and the imports' own; none where the inputs have none.
    """
    none = F.array().cast("array<string>")
    of = lambda df, x: x if "evidence" in df.columns else none
    commits = F.transform("evidence", lambda c: F.concat(F.lit("commit:"), c.cast("string")))
    out = co_changes.select(*part, F.col("left_path").alias("source"), F.col("right_path").alias("target"), F.lit("co_change").alias("kind"), F.col("confidence").alias("weight"), of(co_changes, commits).alias("evidence"))
    if imports is not None:
        out = out.unionByName(imports.select(*part, "source", "target", F.lit("imports").alias("kind"), F.lit(1.0).alias("weight"), of(imports, F.col("evidence")).alias("evidence")))
    return out


def impact(rel: DataFrame, selected: DataFrame | None = None, part: tuple[str, ...] = (), limit: int = 20, backward: float = 0.9, tasks: int | None = None) -> DataFrame:
    """part, selected_path, path, score, n_reasons, reasons, evidence, rank: neighbours of every path, or of `selected` (part, selected_path).

    Relations count forward at their weight and backward at 0.9 of it, self-loops forward only; scores
    are sums, capped at 1, to six places (sums of doubles depend on their order beyond). Evidence is that of all
    relations of the two, co-changes first, and is gathered for the neighbours that are left only; relations without
    that column give none. `tasks` deals the relations over so many tasks.
    """
    if "evidence" not in rel.columns:
        rel = rel.withColumn("evidence", F.array().cast("array<string>"))
    way = lambda a, b, weight: F.struct(F.col(a).alias("selected_path"), F.col(b).alias("path"), weight.alias("weight"))
    ahead, back = way("source", "target", F.col("weight")), way("target", "source", F.col("weight") * backward)
    # Both ways of a relation from one pass over the relations, which would be made again for the second.
    rows = rel.select(*part, "kind", "evidence", F.inline(F.when(F.col("source") != F.col("target"), F.array(ahead, back)).otherwise(F.array(ahead))))
    if selected is not None:
        rows = rows.join(selected, [*part, "selected_path"], "left_semi")
    rows = dealt(rows, tasks, *part, "selected_path")
    reason = F.format_string("%s (%.2f)", F.replace("kind", F.lit("_"), F.lit(" ")), "weight")
    keyed = F.struct((-F.col("weight")).alias("w"), reason.alias("reason"))
    keys = [*part, "selected_path", "path"]
    total = rows.groupBy(*keys).agg(F.round(F.least(F.lit(1.0), F.sum("weight")), 6).alias("score"), F.count(F.lit(1)).alias("n_reasons"), F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["reason"]).alias("reasons"))
    w = Window.partitionBy(*part, "selected_path").orderBy(F.desc("score"), "path")
    best = total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    cited = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("kind", "evidence"))), lambda x: x["evidence"])))
    evidence = rows.where(F.size("evidence") > 0).select(*keys, "kind", "evidence").join(best.select(*keys), keys, "left_semi").groupBy(*keys).agg(cited.alias("evidence"))
    out = best.join(evidence, keys, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    return out.select(*keys, "score", "n_reasons", "reasons", "evidence", "rank")


def evaluate(scored: DataFrame, part: tuple[str, ...] = ()) -> DataFrame:
    """part, model_brier, constant_brier, useful of (score, label) rows; rows that lack one are left out, none at all gives nulls."""
    s, y = F.col("score"), F.col("label").cast("double")
    out = scored.where(s.isNotNull() & y.isNotNull()).groupBy(*part).agg(F.avg((s - y) * (s - y)).alias("model_brier"), F.avg(y).alias("p"))
    constant = F.col("p") * (1 - F.col("p"))
    return out.select(*part, "model_brier", constant.alias("constant_brier"), (F.col("model_brier") < constant).alias("useful"))

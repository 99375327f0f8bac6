"""Delivery audit: reports to claims, claims to evidence and status, changes that no claim cites, report views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import claim_status, claim_type, located_claims
from tracewright.operators.retrieval import best_matches, top

MOST_CLAIMS, MOST_CHARACTERS, EVIDENCE = 100, 100_000, 5


def split_reports(reports: DataFrame, keys: tuple[str, ...] = ("report_id",), most: int = MOST_CLAIMS) -> tuple[DataFrame, DataFrame]:
    """(claims, rejected) of reports (keys, text). claims: keys, ordinal, claim, start_offset, end_offset, claim_type.

    Rejected are blank texts, texts over 100,000 characters and texts without a claim.
    """
    located = F.when((F.length("text") <= MOST_CHARACTERS) & F.col("text").rlike(r"\S"), located_claims(F.col("text")))
    read = reports.select(*keys, "text", F.slice(located, 1, most).alias("x"))
    claims = read.where("size(x) > 0").select(*keys, F.posexplode("x").alias("ordinal", "c"))
    claims = claims.select(*keys, "ordinal", F.col("c.claim").alias("claim"), F.col("c.start").alias("start_offset"), F.col("c.end").alias("end_offset"), claim_type(F.col("c.claim")).alias("claim_type"))
    return claims, read.where("x is null or size(x) = 0").select(*keys, "text")


def in_scope(changes: DataFrame, reports: DataFrame, on: str = "repository_id", days: int = 30) -> DataFrame:
    """changes joined to the reports (report_id, on, scope_from, scope_to) whose inclusive scope holds them; from > to holds none.

    Time is cut into bins of `days`. A scope has a row for each bin that it touches, a change one, and the two are joined by
    repository and bin; the exact bounds are tested on what meets. So a repository's changes meet the reports of their time only, and
    its rows are spread over many keys.
    """
    bin_of = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (86_400 * days))
    scopes = reports.where("scope_from <= scope_to").select("report_id", on, "scope_from", "scope_to", F.explode(F.sequence(bin_of("scope_from"), bin_of("scope_to"))).alias("__bin"))
    met = changes.withColumn("__bin", bin_of("authored_at")).join(scopes, [on, "__bin"])
    return met.where("authored_at between scope_from and scope_to").drop("scope_from", "scope_to", "__bin")


def candidates(changes: DataFrame, commits: DataFrame, on: tuple[str, ...] = ("repository_id",), most: int | None = None) -> DataFrame:
    """Evidence of changes (commit, path): doc_id change:<commit>:<path>, path, kind, text = path and commit message.

    Changes are taken once per (commit, path). most keeps the newest rows of each `on` (off by default).
    """
    rows = changes.dropDuplicates([*on, "commit", "path"]).join(commits.select(*on, "commit", "message"), [*on, "commit"], "left")
    if most:
        rows = top(rows, most, on, [F.desc("authored_at"), F.col("commit"), F.col("path")]).drop("rank")
    text = F.concat_ws(" ", "path", F.coalesce("message", F.lit("")))
    return rows.withColumn("doc_id", F.concat(F.lit("change:"), "commit", F.lit(":"), "path")).withColumn("kind", F.lit("repository_change")).withColumn("text", text)


def assess(claims: DataFrame, evidence: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """on, query_id, status, confidence, evidence (array), rationale, limitations of claims (on, query_id, text, claim_type).

    evidence: (on, doc_id, kind, text). Confidence is unrounded.
    """
    best = best_matches(claims, evidence.select(*on, "doc_id", "text"), EVIDENCE, on=on).groupBy(*on, "query_id").agg(F.max("score").alias("best"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("found"))
    ci = best_matches(claims, evidence.where("kind = 'ci_run'").select(*on, "doc_id", "text"), 1, on=on).select(*on, "query_id").withColumn("ci", F.lit(True))
    rows = claims.join(best, [*on, "query_id"], "left").join(ci, [*on, "query_id"], "left")
    kind = F.col("claim_type")
    none = F.array().cast(best.schema["found"].dataType)
    rows = rows.withColumn("status", claim_status(kind, F.col("best"), F.col("ci"))).withColumn("evidence", F.when(kind == "deployment", none).otherwise(F.coalesce("found", none)))
    outside = F.col("status") == "EXTERNAL_EVIDENCE_REQUIRED"
    # The texts of rationales and limitations.
    why = (
        F.when(outside & (kind == "deployment"), "Repository evidence cannot establish deployment state.")
        .when(outside, "Repository changes do not prove that tests passed.")
        .when(F.col("status") == "VERIFIED", "Repository evidence strongly overlaps the claim terms.")
        .when(F.col("status") == "PARTIALLY_VERIFIED", "Repository evidence supports only part of the claim.")
        .otherwise("No repository evidence matched the material claim terms.")
    )
    limits = (
        F.when(outside & (kind == "deployment"), F.array(F.lit("No trusted deployment provider evidence was connected.")))
        .when(outside, F.array(F.lit("No trusted CI evidence was connected.")))
        .when(F.size("evidence") == 0, F.array(F.lit("The selected commit and file-change scope was searched.")))
        .otherwise(F.array().cast("array<string>"))
    )
    return rows.select(*on, "query_id", "status", F.when(outside, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("confidence"), "evidence", why.alias("rationale"), limits.alias("limitations"))


def unreported(changes: DataFrame, cited: DataFrame, keys: tuple[str, ...] = ("report_id",)) -> DataFrame:
    """keys, path, n_changes, churn, materiality, evidence, explanation of the paths in changes that cited (keys, path) lacks.

    Materiality is churn by the largest churn of any path of the report, cited or not.
    """
    paths = changes.groupBy(*keys, "path").agg(F.sum("churn").cast("long").alias("churn"), F.count(F.lit(1)).alias("n_changes"))
    top_churn = paths.groupBy(*keys).agg(F.max("churn").alias("mx"))
    newest = top(changes, 5, (*keys, "path"), [F.desc("authored_at"), F.col("commit")])
    ids = newest.groupBy(*keys, "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "commit", "path"))), lambda x: F.concat(F.lit("change:"), x["commit"].cast("string"), F.lit(":"), x["path"].cast("string"))).alias("evidence"))
    rows = paths.join(top_churn, list(keys)).join(cited.select(*keys, "path").distinct(), [*keys, "path"], "left_anti").join(ids, [*keys, "path"])
    text = F.format_string("Observed in %d scoped commit(s) but not cited by a claim.", "n_changes")
    return rows.select(*keys, "path", "n_changes", "churn", F.coalesce(F.try_divide("churn", "mx"), F.lit(0.0)).alias("materiality"), "evidence", text.alias("explanation"))


def view(claims: DataFrame, assessments: DataFrame, keys: tuple[str, ...] = ("report_id",)) -> DataFrame:
    """claims with their assessment, or nulls, and per report whether any is pending."""
    joined = claims.join(assessments, [*keys, "ordinal"], "left")
    pending = joined.groupBy(*keys).agg(F.bool_or(F.col("status").isNull()).alias("pending"))
    return joined.join(pending, list(keys))


def report_markdown(claims: DataFrame, missing: DataFrame, keys: tuple[str, ...] = ("report_id",)) -> DataFrame:
    """keys, body: a Markdown document per report of claims (ordinal, claim, status, confidence, evidence, limitations) and
    unreported changes (path, materiality, explanation)."""
    listed = lambda c, sep: F.when(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0, F.array_join(F.col(c).cast("array<string>"), sep)).otherwise("none")
    section = F.concat_ws(
        "\n",
        F.format_string("### %d. %s", F.col("ordinal") + 1, "claim"), F.lit(""),
        F.concat(F.lit("Status: "), F.coalesce("status", F.lit("PENDING"))),
        F.format_string("Confidence: %.2f", F.coalesce("confidence", F.lit(0.0))),
        F.concat(F.lit("Evidence: "), listed("evidence", ", ")), F.concat(F.lit("Limitations: "), listed("limitations", "; ")), F.lit(""),
    )
    body = claims.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", section.alias("s")))), lambda x: x["s"]), "\n").alias("claims"))
    line = F.format_string("- `%s` (%.2f): %s", F.col("path").cast("string"), "materiality", "explanation")
    rest = missing.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("materiality")).alias("m"), "path", line.alias("s")))), lambda x: x["s"]), "\n").alias("missing"))
    head = F.concat_ws("\n", F.concat(F.lit("# Delivery audit "), F.concat_ws("/", *keys)), F.lit(""), F.lit("## Claims"), F.lit(""))
    return body.join(rest, list(keys), "left").select(*keys, F.concat_ws("\n", head, "claims", F.lit("## Unreported changes"), F.lit(""), F.coalesce("missing", F.lit(""))).alias("body"))

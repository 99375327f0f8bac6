"""Terms, claims, statuses and answers: text functions as Column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The term pattern and the two stop lists, of the audit and of retrieval; keyword lists of claim types and recency.
TERM = "[a-zA-Z0-9_-]{3,}"
AUDIT_STOP = ("and", "the", "for", "with", "from", "that", "this", "into", "was", "were")
RETRIEVAL_STOP = ("and", "the", "for", "from", "that", "this", "what", "where", "which", "with")
DEPLOYMENT_WORDS = ("deploy", "deployed", "deployment", "production", "released", "live")
TEST_WORDS = ("test", "tests", "tested", "ci", "coverage", "passing")
RECENCY_WORDS = ("latest", "newest", "recent", "recently")
CHANGE_WORDS = ("change", "changed", "changes", "commit", "commits", "update", "updates")
# Fixed value: a claim is a run without line or sentence ends, with the ends that follow it or the text's end.
CLAIM = r"(?d)[^\n.!?]+(?:[.!?]+|$)"
REFUSAL = "Insufficient repository evidence to answer this question."
ANSWER = "Relevant repository evidence: "


def strings(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def words(text: Column) -> Column:
    """Distinct lower-cased words of three characters and more, in order of appearance; empty for null."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0)), F.lower))


def terms(text: Column, stop: tuple[str, ...] = AUDIT_STOP) -> Column:
    return F.array_except(words(text), strings(stop))


def strip(text: Column, more: str = "") -> Column:
    """text without white space, and characters of `more` (a character class body), at its ends."""
    return F.regexp_replace(text, rf"^[\s{more}]+|[\s{more}]+$", "")


def cleaned(claim: Column) -> Column:
    """A raw claim without its list marker and outer white space."""
    return strip(F.regexp_replace(strip(claim), r"^[-*•]+", ""))


def raw_claims(text: Column) -> Column:
    """The raw claims of a text. One trailing newline does not open a line of its own."""
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n$", ""), F.lit(CLAIM), F.lit(0))


def located_claims(text: Column) -> Column:
    """Array of (claim, start, end): cleaned non-empty claims with 0-based offsets of the cleaned text, by a fold with a cursor."""
    begin = F.struct(F.lit(1).alias("cursor"), F.array().cast("array<struct<claim:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, raw: Column) -> Column:
        at = F.call_function("locate", raw, text, acc["cursor"])
        clean = cleaned(raw)
        start = at - 1 + F.call_function("instr", raw, clean) - 1
        item = F.struct(clean.alias("claim"), start.cast("int").alias("start"), (start + F.length(clean)).cast("int").alias("end"))
        return F.struct((at + F.length(raw)).cast("int").alias("cursor"), F.when(clean == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(item))).alias("out"))

    return F.aggregate(raw_claims(text), begin, step, lambda acc: acc["out"])


def claim_type(text: Column) -> Column:
    w = words(text)
    return F.when(F.arrays_overlap(w, strings(DEPLOYMENT_WORDS)), "deployment").when(F.arrays_overlap(w, strings(TEST_WORDS)), "test").otherwise("repository_change")


def claim_status(kind: Column, best: Column, has_ci: Column) -> Column:
    """EXTERNAL_EVIDENCE_REQUIRED, VERIFIED (best >= 0.6), PARTIALLY_VERIFIED (>= 0.25) or NO_SUPPORTING_EVIDENCE."""
    outside = (kind == "deployment") | ((kind == "test") & ~F.coalesce(has_ci, F.lit(False)))
    best = F.coalesce(best, F.lit(0.0))
    return F.when(outside, "EXTERNAL_EVIDENCE_REQUIRED").when(best >= 0.6, "VERIFIED").when(best >= 0.25, "PARTIALLY_VERIFIED").otherwise("NO_SUPPORTING_EVIDENCE")


def asks_for_recent_changes(text: Column) -> Column:
    w = terms(text, RETRIEVAL_STOP)
    return F.arrays_overlap(w, strings(RECENCY_WORDS)) & F.arrays_overlap(w, strings(CHANGE_WORDS))


#: Fixed value: characters of a document that an answer quotes.
QUOTED = 220


def answer(texts: Column) -> Column:
    """Extractive answer from the selected documents' texts, or the refusal if there are none."""
    facts = F.array_join(F.transform(texts, lambda t: strip(F.substring(t, 1, QUOTED))), "; ")
    return F.when(F.size(F.coalesce(texts, F.array().cast("array<string>"))) > 0, F.concat(F.lit(ANSWER), facts)).otherwise(REFUSAL)


def spreadsheet_safe(cell: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a quote in front."""
    return F.when(cell.rlike("^[=+@-]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def redact(text: Column, secrets: Column, most: int = 300) -> Column:
    """text with each of `secrets` (array) replaced, cut to its last line and `most` characters."""
    clean = F.aggregate(secrets, text, lambda t, s: F.when(s == "", t).otherwise(F.replace(t, s, F.lit("[REDACTED]"))))
    return F.substring(F.element_at(F.split(strip(clean), "\n"), -1), 1, most)

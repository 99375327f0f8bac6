"""Stable ids, fingerprints and cursors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 24 hex digits of the SHA-256 of the parts, joined by the unit separator; null counts as None."""
    text = F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(text, 256), 1, 24))


def span_text(span: Column) -> Column:
    """The span (start_line, start_column, end_line, end_column) as ids spell it."""
    return F.format_string("SourceSpan(start_line=%d, start_column=%d, end_line=%d, end_column=%d)", span["start_line"], span["start_column"], span["end_line"], span["end_column"])


def request_fingerprint(*fields: str) -> Column:
    """SHA-256 of the fields as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def encode_cursor(offset: Column) -> Column:
    return F.base64(F.encode(offset.cast("string"), "UTF-8"))


def decode_cursor(cursor: Column) -> Column:
    """The offset, or null if the cursor is no such text."""
    raw = F.decode(F.try_to_binary(cursor, F.lit("base64")), "UTF-8")
    return F.when(raw.rlike("^[0-9]+$"), raw.try_cast("long"))

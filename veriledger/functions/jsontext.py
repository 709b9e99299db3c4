"""Model responses: JSON that may stand alone, in a fence, or inside prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCED_JSON, FENCED, BRACES = r"(?s)```json\s*(.*?)\s*```", r"(?s)```\s*(.*?)\s*```", r"(?s)(\{.*\})"


def strip_stray_escapes(c: Column) -> Column:
    """A backslash before a quote, left by a doubly escaped response, goes."""
    return F.regexp_replace(c, r"""\\(["'])""", "$1")


def parse_json_response(c: Column) -> Column:
    """The first candidate that parses, as VARIANT; null if none does."""
    found = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (FENCED_JSON, FENCED, BRACES)]
    return F.coalesce(F.try_parse_json(F.trim(c)), *[F.try_parse_json(f) for f in found])

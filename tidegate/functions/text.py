"""Sentences: splitting, and leaving out those that mention a term."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sentences(text: Column) -> Column:
    """Parts that end with a full stop, question or exclamation mark before a space; decimals and short abbreviations don't end one."""
    kept = F.regexp_replace(text, r"\b(dr|mr|ms|vs|no|approx|e\.g|i\.e)\.", "$1\u0001")
    parts = F.split(kept, r"(?<=[.?!])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def without(parts: Column, terms: str) -> Column:
    """Those that don't match a pattern, ignoring case."""
    return F.filter(parts, lambda s: ~F.lower(s).rlike(terms))


def scrubbed(text: Column) -> Column:
    """Numbers of six digits or more, and mail addresses, as marks."""
    return F.regexp_replace(F.regexp_replace(text, r"[\w.]+@[\w.]+", "[mail]"), r"\d{6,}", "[number]")

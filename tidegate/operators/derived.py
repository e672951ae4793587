"""Rows made from other rows of the same entity and time: sums of components, corrections, support gates, pairs in one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def component_totals(rows: DataFrame, key: list[str], item: str, value: str, parts: list[str], total: str) -> DataFrame:
    """key, value: the direct total if there is one, else the sum of the parts' smallest values where all are there."""
    wide = rows.filter(F.col(item).isin([*parts, total])).groupBy(*key).pivot(item, [*parts, total]).agg(F.min(value))
    summed = F.lit(0.0)
    for p in parts:
        summed = summed + F.col(p)
    return wide.select(*key, F.coalesce(total, summed).alias("value"), F.col(total).isNull().alias("derived")).filter("value IS NOT NULL")


def corrected(rows: DataFrame, key: list[str], item: str, value: str, what: str, by: str, divisor: float) -> DataFrame:
    """key, value: rows of one item less another's at the same key over a divisor, never below zero."""
    a = rows.filter(F.col(item) == what).groupBy(*key).agg(F.max(value).alias("a"))
    b = rows.filter(F.col(item) == by).groupBy(*key).agg(F.max(value).alias("b"))
    return a.join(b, key, "left").select(*key, F.greatest(F.col("a") - F.coalesce(F.col("b") / divisor, F.lit(0.0)), F.lit(0.0)).alias("value"))


def supported(rows: DataFrame, key: list[str], item: str, gated: str, by: str) -> DataFrame:
    """All rows but those of a gated item without a supporting item at the same key."""
    support = rows.filter(F.col(item) == by).select(*key).distinct()
    return rows.filter(F.col(item) != gated).unionByName(rows.filter(F.col(item) == gated).join(support, key, "left_semi"))


def pairs_in_text(rows: DataFrame, text: str, names: tuple[str, str], lo: float, hi: float) -> DataFrame:
    """'A/B' as two rows, if both are plausible and A is the larger."""
    a, b = (F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\s*$", k).try_cast("double") for k in (1, 2))
    both = rows.withColumns({"_a": a, "_b": b}).filter(F.col("_a").between(lo, hi) & F.col("_b").between(lo, hi) & (F.col("_a") > F.col("_b")))
    made = F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(c).alias("value")) for n, c in zip(names, ("_a", "_b"))]))
    return both.withColumn("_m", made).select(*[c for c in rows.columns if c != text], "_m.*")


def qualitative(text: Column) -> Column:
    """negative before pending before positive, by the words of a result."""
    t = F.lower(text)
    return F.when(t.rlike("not detected|negative|no growth"), "negative").when(t.rlike("pending|in progress"), "pending").when(t.rlike("detected|positive|growth"), "positive").otherwise("other")

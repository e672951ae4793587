"""Declarative label rules over relative-time events, compiled to columns.

A rule is a tree of any_of and all_of over leaves; a leaf asks whether an item occurs, or passes a threshold, in a closed window of
hours. All leaves become conditional aggregates of one grouped pass, whatever the number of rules; the tree is algebra over them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TESTS = {"lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def leaves(node: dict) -> Iterator[dict]:
    for k in ("any_of", "all_of"):
        if k in node:
            for child in node[k]:
                yield from leaves(child)
            return
    yield node


def leaf_test(leaf: dict) -> Column:
    """On an event row (item, value, hours)."""
    lo, hi = leaf["window_hours"]
    here = (F.col("item") == leaf["item"]) & F.col("hours").between(float(lo), float(hi))
    if "lab_threshold" in leaf:
        op, bound = leaf["lab_threshold"]
        return here & F.expr(f"value {TESTS[op]} {float(bound)}D")
    return here & (F.col("value").isNull() | (F.col("value") >= 1))


def holds(node: dict) -> Column:
    if "any_of" in node:
        parts = [holds(c) for c in node["any_of"]]
        out = parts[0]
        for p in parts[1:]:
            out = out | p
        return out
    if "all_of" in node:
        parts = [holds(c) for c in node["all_of"]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out
    return F.col(f"leaf_{node['id']}")


def fired(node: dict) -> list[Column]:
    """Ids of leaves that fire; those below an all_of count only where it holds."""
    if "any_of" in node:
        return [x for c in node["any_of"] for x in fired(c)]
    if "all_of" in node:
        return [F.when(holds(node), x) for c in node["all_of"] for x in fired(c)]
    return [F.when(holds(node), F.lit(node["id"]))]


def evaluated(cases: DataFrame, events: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """case_id, label, y, fired for each case and rule. events: case_id, item, value, hours."""
    every = {leaf["id"]: leaf for r in rules.values() for leaf in leaves(r)}
    lo, hi = min(x["window_hours"][0] for x in every.values()), max(x["window_hours"][1] for x in every.values())
    near = events.filter(F.col("item").isin(sorted({x["item"] for x in every.values()})) & F.col("hours").between(float(lo), float(hi)))
    flags = near.groupBy("case_id").agg(*[F.coalesce(F.bool_or(leaf_test(x)), F.lit(False)).alias(f"leaf_{i}") for i, x in every.items()])
    wide = cases.select("case_id").join(flags, "case_id", "left").select("case_id", *[F.coalesce(f"leaf_{i}", F.lit(False)).alias(f"leaf_{i}") for i in every])
    each = [F.struct(F.lit(n).alias("label"), holds(r).alias("y"), F.array_join(F.array_sort(F.array_compact(F.array(*fired(r)))), ",").alias("fired")) for n, r in rules.items()]
    return wide.select("case_id", F.explode(F.array(*each)).alias("r")).select("case_id", "r.*")


def available(labels: DataFrame, bins: DataFrame, least_share: float) -> DataFrame:
    """Sets negatives to null in bins where too few cases have a source at all; positives are never touched.

    labels: case_id, label, y. bins: case_id, bin, has_source.
    """
    share = bins.groupBy("bin").agg(F.avg(F.col("has_source").cast("double")).alias("share"))
    thin = bins.join(share, "bin").select("case_id", (F.col("share") < least_share).alias("thin"))
    return labels.join(thin, "case_id").select("case_id", "label", F.when(F.col("thin") & ~F.col("y"), None).otherwise(F.col("y")).alias("y"))


def excluded(labels: DataFrame, drop: str, when: str) -> DataFrame:
    """Takes label ``drop`` away from cases where label ``when`` holds."""
    other = labels.filter((F.col("label") == when) & F.col("y")).select("case_id", F.lit(True).alias("_other"))
    out = labels.join(other, "case_id", "left")
    return out.select("case_id", "label", F.when(F.col("label") == drop, F.col("y") & ~F.coalesce("_other", F.lit(False))).otherwise(F.col("y")).alias("y"))


def pattern(labels: DataFrame, priority: list[str]) -> DataFrame:
    """case_id, pattern: the first label in order that holds, else all_negative."""
    wide = labels.groupBy("case_id").agg(*[F.bool_or((F.col("label") == n) & F.col("y")).alias(f"p_{i}") for i, n in enumerate(priority)])
    return wide.select("case_id", F.coalesce(*[F.when(F.col(f"p_{i}"), F.lit(n)) for i, n in enumerate(priority)], F.lit("all_negative")).alias("pattern"))

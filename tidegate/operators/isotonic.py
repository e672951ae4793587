"""Isotonic regression by pools that merge: range partitions pool their own adjacent violators, then pools meet in order.

Pooling within a range is a state that pooling over all rows may pass through, so that the order of the merges doesn't change the
result. Of N rows with outcomes 0 and 1, the pools of all ranges are few: adjacent ones have different shares, and only so many
fractions have small denominators (about N**(2/3) of them in all). They pass one task for each label as a sorted stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.sources.shared import written

#: Steps of all labels that are held on each executor, 24 bytes each; beyond, rows meet the steps by a join in order.
HELD = 1_000_000
POOL = "key string, low double, high double, s double, n double"


def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pools (key, low, high, s, n) sorted by key and low: those that no adjacent one has to join. One key's pools are held."""
    key, stack = None, []

    def out() -> pa.RecordBatch:
        low, high, s, n = zip(*stack)
        return pa.RecordBatch.from_arrays([pa.array([key] * len(stack), pa.string()), *(pa.array(c, pa.float64()) for c in (low, high, s, n))], ["key", "low", "high", "s", "n"])

    for b in batches:
        for k, low, high, s, n in zip(*(b.column(c).to_pylist() for c in ("key", "low", "high", "s", "n"))):
            if k != key:
                if stack:
                    yield out()
                key, stack = k, []
            # shares that are equal join too: a run of them is one step
            while stack and stack[-1][2] * n >= s * stack[-1][3]:
                a, _, t, m = stack.pop()
                low, s, n = a, s + t, n + m
            stack.append((low, high, s, n))
    if stack:
        yield out()


def steps(rows: DataFrame, label: str, x: str, y: str) -> DataFrame:
    """key (the label as text), low, high, value of each step of y's isotonic regression on x, label by label."""
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x))
    each = known.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("\0")).alias("key"), F.col(x).cast("double").alias("low")).agg(F.sum(F.col(y).cast("double")).alias("s"), F.count("*").cast("double").alias("n"))
    each = each.select("key", "low", F.col("low").alias("high"), "s", "n")
    parts = each.repartitionByRange("key", "low").sortWithinPartitions("key", "low").mapInArrow(pooled, POOL)
    whole = parts.repartition("key").sortWithinPartitions("key", "low").mapInArrow(pooled, POOL)
    return whole.select("key", "low", "high", (F.col("s") / F.col("n")).alias("value"))


def applied(rows: DataFrame, label: str, x: str, table: DataFrame, name: str, eps: float = 1e-6) -> DataFrame:
    """Adds name: the step's value, on a line between the ends of two steps, the first or last beyond them, within eps of 0 and 1.

    Null for labels without steps and for unknown x. table: steps(), which is written.
    """
    table = written(table, "steps")
    if table.count() <= HELD:
        ends: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        got = table.orderBy("key", "low").toPandas()
        for key, part in got.groupby("key"):
            ends[key] = (part[["low", "high"]].to_numpy().ravel(), np.clip(np.repeat(part["value"].to_numpy(), 2), eps, 1 - eps))

        @F.pandas_udf("double")
        def value(k: pd.Series, v: pd.Series) -> pd.Series:
            out = np.full(len(k), np.nan)
            for key, at in k.groupby(k).groups.items():
                if key in ends:
                    at = k.index.get_indexer(at)
                    out[at] = np.interp(v.to_numpy(np.float64)[at], *ends[key])
            return pd.Series(out).where(~np.isnan(out), None)

        return rows.withColumn(name, value(F.coalesce(F.col(label).cast("string"), F.lit("\0")), F.col(x).cast("double")))
    # both in one order: a row knows the step that begins before it and the one that ends after it
    item = F.struct("low", "high", "value")
    both = rows.select(F.struct("*").alias("_row"), F.coalesce(F.col(label).cast("string"), F.lit("\0")).alias("_k"), F.col(x).cast("double").alias("_x"), F.lit(None).cast(table.select(item).schema[0].dataType).alias("_s"))
    both = both.unionByName(table.select(F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.col("key").alias("_k"), F.col("low").alias("_x"), item.alias("_s")))
    order = Window.partitionBy("_k").orderBy(F.col("_x").asc_nulls_first(), F.col("_s").isNull())
    before = F.last("_s", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy("_k").orderBy(F.col("_x").desc_nulls_last(), F.col("_s").isNull().desc())
    after = F.last("_s", True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    cut = lambda v: F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(eps)), F.lit(1 - eps)))
    told = both.withColumns({"_b": before, "_a": after}).filter("_row IS NOT NULL")
    a, b = cut(F.col("_b.value")), cut(F.col("_a.value"))
    line = a + (b - a) * (F.col("_x") - F.col("_b.high")) / (F.col("_a.low") - F.col("_b.high"))
    got = F.when(F.col("_x").isNull(), None).when(F.col("_b").isNull(), b).when(F.col("_a").isNull() | (F.col("_x") <= F.col("_b.high")), a).otherwise(line)
    return told.select("_row.*", got.alias(name))

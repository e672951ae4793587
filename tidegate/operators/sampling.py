"""Exact stratified samples by portable hashes, allocation by largest remainder, weights, rater order and consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.expressions import portable_hash
from tidegate.operators import ranks


def allocated(sizes: DataFrame, stratum: str, total: int) -> DataFrame:
    """stratum, size, take: shares of total in proportion, rounded by largest remainder, never more than the stratum has."""
    whole = Window.partitionBy()
    q = sizes.withColumn("quota", F.lit(total) * F.col("size") / F.sum("size").over(whole)).withColumn("base", F.floor("quota"))
    left = F.lit(total) - F.sum("base").over(whole)
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("quota") - F.col("base"), 9)), stratum))
    return q.select(stratum, "size", F.least(F.col("size"), F.col("base") + F.when(rank <= left, 1).otherwise(0)).cast("long").alias("take"))


def drawn(frame: DataFrame, stratum: str, key: str, takes: DataFrame, seed: int) -> DataFrame:
    """The first rows of each stratum by hash, with inclusion probability and weight."""
    h = portable_hash(F.lit(str(seed)), F.col(key).cast("string"))
    placed = ranks.ranked(frame.withColumn("_h", h), [stratum], ["_h", key]).drop("_size", "_h")
    picked = placed.join(takes.select(stratum, "size", "take"), stratum).filter(F.col("_rank") <= F.col("take"))
    return picked.withColumn("inclusion_prob", F.col("take") / F.col("size")).withColumn("weight", F.col("size") / F.col("take")).drop("_rank")


def effective_size(rows: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    w = F.col(weight)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("sum_weight"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"))


def consensus(ratings: DataFrame) -> DataFrame:
    """ratings (case_id, rater, y): agreed value, third's word, majority, or pending where none is to be had."""
    c = ratings.groupBy("case_id").agg(F.count(F.when(F.col("y") == 1, 1)).alias("yes"), F.count(F.when(F.col("y") == 0, 1)).alias("no"))
    n = F.col("yes") + F.col("no")
    status = F.when(n < 2, "pending").when((F.col("yes") == 0) | (F.col("no") == 0), "agreed").when(F.col("yes") == F.col("no"), "pending").otherwise("majority")
    return c.withColumn("status", status).select("case_id", "status", F.when(F.col("status") != "pending", (F.col("yes") > F.col("no")).cast("int")).alias("y"))


def assignments(cases: DataFrame, raters: list[str], batch: int, seed: int) -> DataFrame:
    """Each rater's own order of all cases, in batches. Raters are a short list."""
    each = cases.select("case_id").withColumn("rater", F.explode(F.array(*map(F.lit, raters))))
    h = portable_hash(F.lit(str(seed)), F.col("rater"), F.col("case_id").cast("string"))
    placed = ranks.ranked(each.withColumn("_h", h), ["rater"], ["_h", "case_id"]).withColumn("place", F.col("_rank").cast("int"))
    return placed.withColumn("batch", F.floor((F.col("place") - 1) / batch).cast("int")).drop("_h", "_rank", "_size")


def weighted_prevalence(rows: DataFrame, by: list[str], y: str, weight: str) -> DataFrame:
    w = F.when(F.col(y).isNotNull(), F.col(weight))
    return rows.groupBy(*by).agg(F.count(y).alias("n"), (F.sum(w * F.col(y)) / F.sum(w)).alias("prevalence"))

"""Rank statistics over range partitions: Spearman's correlation, and Kendall's tau-b by counting inversions with ties.

Pairs that disagree are inversions between two total orders of the distinct (x, y) cells: by x then y, and by y then x; ties are none.
The cells are dealt by range in both orders. An inversion lies within a range of the first order, where its task counts it; or in
different ranges of the first and within one of the second, where that task counts it by ranges of the first; or in different ranges of
both, and follows from how many rows each two ranges share. No rows are paired, and a value or a group with a third of all rows spreads
over the ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.expressions import logit
from tidegate.operators import metrics, ranks
from tidegate.sources.shared import Scratch

#: Cells of a range on average, and ranges of each order, at most: the table of shared rows has at most the square of these, and a
#: little more for groups at their edges.
CELLS, RANGES = 50_000, 1_024


def inversions(key: np.ndarray, weight: np.ndarray) -> float:
    """Weight of the pairs of which the earlier has the greater key, by merging sorted runs from the shortest up."""
    n = len(key)
    if n < 2:
        return 0.0
    key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    total, run = 0.0, 1
    key, weight = key.copy(), weight.astype(np.float64).copy()
    while run < n:
        # runs side by side: a number for each pair of runs before the key keeps them apart in one sort
        pair = np.arange(n) // (2 * run)
        right = (np.arange(n) // run) % 2 == 1
        place = pair * (int(key.max()) + 1) + key
        order = np.lexsort((right, place))  # equal keys: the left run first, no inversion
        left_weight = np.where(right, 0.0, weight)[order]
        before = np.cumsum(left_weight)
        of_pair = np.bincount(pair, np.where(right, 0.0, weight))
        ends = np.cumsum(of_pair)
        sorted_pair, sorted_right = pair[order], right[order]
        greater = ends[sorted_pair] - before
        total += float((weight[order] * greater)[sorted_right].sum())
        key, weight = key[order], weight[order]
        run *= 2
    return total


def kendall(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, tau: tau-b of known x and y in each group; null if either is constant."""
    keep = Scratch(rows.sparkSession)
    key = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in by])) if by else F.lit("[]")
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key.alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cells = keep(known.groupBy("g", "x", "y").agg(F.count("*").cast("double").alias("n")), "cells")
    n = min(RANGES, -(-cells.count() // CELLS) or 1)
    first = keep(cells.repartitionByRange(n, "g", "x", "y").withColumn("a", F.spark_partition_id()), "first")
    second = keep(first.repartitionByRange(n, "g", "y", "x").withColumn("b", F.spark_partition_id()), "second")

    def within(order: list[str], of: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part = pd.concat(list(batches), ignore_index=True)
            out = [(g, inversions(p.sort_values(order)[of].to_numpy(), p.sort_values(order)["n"].to_numpy())) for g, p in part.groupby("g")]
            yield pd.DataFrame(out, columns=["g", "d"])

        return run

    def by_part(part: str, order: list[str], of: str):
        run = within(order, of)

        def apply(p: pd.DataFrame) -> pd.DataFrame:
            return next(run(iter([p])))

        return second.groupBy(part).applyInPandas(apply, "g string, d double")

    same_first = by_part("a", ["x", "y"], "y")  # equal x come in order of y: no inversion
    same_second = by_part("b", ["y", "x"], "a")  # by ranges of the first order: pairs within one aren't counted twice
    apart: dict[str, float] = {}
    shared = second.groupBy("g", "a", "b").agg(F.sum("n").alias("n")).toPandas()
    for g, p in shared.groupby("g"):
        table = np.zeros((p["a"].max() + 1, p["b"].max() + 1))
        table[p["a"], p["b"]] = p["n"]
        above = np.cumsum(table[::-1], 0)[::-1] - table  # later ranges of the first order
        before = np.cumsum(above, 1) - above  # of these, earlier ones of the second
        apart[g] = float((table * before).sum())
    counts = second.groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("both"))
    ties = lambda c: second.groupBy("g", c).agg(F.sum("n").alias("n")).groupBy("g").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(f"tied_{c}"))
    local = same_first.unionByName(same_second).groupBy("g").agg(F.sum("d").alias("d"))
    far = rows.sparkSession.createDataFrame(list(apart.items()), "g string, far double")
    joined = counts.join(ties("x"), "g").join(ties("y"), "g").join(local, "g").join(far, "g")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    against = F.col("d") + F.col("far")
    agree = pairs - F.col("tied_x") - F.col("tied_y") + F.col("both") - against
    tau = F.try_divide(agree - against, F.sqrt(pairs - F.col("tied_x")) * F.sqrt(pairs - F.col("tied_y")))
    told = joined.select(F.col("g").alias("_key"), F.col("n").cast("long").alias("n"), tau.alias("tau"))
    names = (rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()).withColumn("_g", key)
    return names.join(told, F.col("_g") == F.col("_key")).select(*by, "n", "tau")


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, rho: correlation of average ranks of known x and y in each group; null if either is constant."""
    cells = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_n"))
    ranked = cells
    for c in ("_x", "_y"):
        tied = ranks.tied(cells, by, c, F.sum("_n")).select(*[F.col(k).alias(f"_by_{k}") for k in by], F.col(c).alias("_v"), F.col("rank").alias(f"_r{c}"))
        on = F.col(c) == F.col("_v")
        for k in by:
            on = on & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
        ranked = ranked.join(tied, on).drop("_v", *[f"_by_{k}" for k in by])
    n, a, b = F.col("_n"), F.col("_r_x"), F.col("_r_y")
    # ranks less the middle one: their mean is zero
    s = ranked.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(n * a * b).alias("_ab"), F.sum(n * a * a).alias("_aa"), F.sum(n * b * b).alias("_bb"))
    middle = F.col("n") * (F.col("n") + 1) * (F.col("n") + 1) / 4.0
    spread = F.sqrt(F.col("_aa") - middle) * F.sqrt(F.col("_bb") - middle)
    return s.select(*by, "n", F.when(spread > 0, (F.col("_ab") - middle) / spread).alias("rho"))


def pairwise_auroc(rows: DataFrame, pairs: list[tuple[str, str]], entity: str, label: str, y: str, p: str) -> DataFrame:
    """pair, n1, n0, auroc: how well logit p of a less that of b tells label a from label b, among entities with exactly one of them.

    rows has one row for each entity and label. An entity counts in every pair that it has both labels known of.
    """
    item = F.struct(F.col(y).cast("long").alias("y"), F.col(p).alias("p"))
    known = rows.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).filter(F.col(label).isin(sorted({x for pair in pairs for x in pair})))
    each = known.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct(F.col(label), item))).alias("m"))
    listed = F.array(*[F.struct(F.lit(f"{a}/{b}").alias("pair"), F.try_element_at("m", F.lit(a)).alias("a"), F.try_element_at("m", F.lit(b)).alias("b")) for a, b in pairs])
    both = each.select(F.inline(listed)).filter(F.col("a.y") != F.col("b.y"))
    return metrics.auroc(both.select("pair", F.col("a.y").alias("y"), (logit(F.col("a.p")) - logit(F.col("b.p"))).alias("s")), ["pair"], "y", "s")

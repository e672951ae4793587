"""Agreement of raters as a report: kappas of any pair with intervals, repeated cases, consensus, circularity, and the queue of disputes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.operators import inference, metrics, resample, sampling
from tidegate.operators.disclose import SMALL


def categorical_kappa(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, n, agree, kappa of two raters' categories; null where chance alone agrees. Rows without either don't count."""
    cells = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    # one row for each category: how often either rater gave it
    item = lambda c, x, y: F.struct(c.alias("c"), x.alias("x"), y.alias("y"))
    none = F.lit(0).cast("long")
    sides = cells.select(*by, F.inline(F.array(item(F.col("_a"), F.col("_n"), none), item(F.col("_b"), none, F.col("_n")))))
    chance = sides.groupBy(*by, "c").agg((F.sum("x") * F.sum("y")).alias("_p")).groupBy(*by).agg(F.sum("_p").alias("_e"))
    seen = cells.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("_o"))
    same = F.lit(True)
    named = chance
    for c in by:
        named = named.withColumnRenamed(c, f"_by_{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    e, o = F.col("_e") / (F.col("n") * F.col("n")), F.col("_o") / F.col("n")
    return seen.join(named, same).select(*by, "n", o.alias("agree"), F.when(e < 1, (o - e) / (1 - e)).alias("kappa"))


def of_two(ratings: DataFrame, a: object, b: object, case: str, label: str, rater: str, value: str, keep: list[str] | None = None) -> DataFrame:
    """case, label, a, b (and kept columns, the same in all of a case's rows): the two raters' values where both gave one."""
    kept = [F.any_value(c).alias(c) for c in keep or []]
    sides = [F.max(F.when(F.col(rater) == x, F.col(value))).alias(n) for x, n in ((a, "a"), (b, "b"))]
    return ratings.filter(F.col(rater).isin(a, b)).groupBy(case, label).agg(*sides, *kept).filter("a IS NOT NULL AND b IS NOT NULL")


def binary_report(pairs: DataFrame, by: list[str], case: str, stratum: str | None = None, weight: str | None = None, replicates: int = metrics.REPLICATES, seed: int = 0, k: int = SMALL) -> DataFrame:
    """by, n, n_positive (by either), kappa, pabak, agree, low, high: of pairs (a, b) of zeros and ones, cases drawn within strata.

    All is null where the pairs, those positive by either, or the others are fewer than k; with a weight, kappa and its companions are
    weighted, and the interval is of the unweighted one.
    """
    counts = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if((F.col("a") == 1) | (F.col("b") == 1)).alias("n_positive"))
    point = metrics.kappa(pairs, by, "a", "b", weight).drop("n", "prevalence", "bias").withColumn("agree", (F.col("pabak") + 1) / 2)
    rows = pairs if stratum else pairs.withColumn("_all", F.lit(""))
    drawn = resample.interval(resample.replicated(rows, by, stratum or "_all", case, resample.kappa("a", "b"), replicates, seed), by, least=0.9).drop("reps", "p_below")
    out = counts.join(point, by, "left").join(drawn, by, "left") if by else counts.crossJoin(point).crossJoin(drawn)  # one row each
    shown = (F.col("n") >= k) & (F.col("n_positive") >= k) & (F.col("n") - F.col("n_positive") >= k)
    hide = lambda c, ok: F.when(ok, F.col(c)).alias(c)
    return out.select(*by, hide("n", F.col("n") >= k), hide("n_positive", shown), *[hide(c, shown) for c in ("kappa", "pabak", "agree", "low", "high")])


def pair_kappas(ratings: DataFrame, case: str, label: str, rater: str, value: str) -> DataFrame:
    """label, a, b, n, agree, kappa of each two raters of zeros and ones. A case's ratings of a label are a few, and meet in an array."""
    item = F.struct(F.col(rater).alias("r"), F.col(value).cast("long").alias("v"))
    each = ratings.filter(F.col(value).isNotNull()).groupBy(case, label).agg(F.sort_array(F.collect_list(item)).alias("x"))
    two = F.flatten(F.transform("x", lambda p, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda q: F.struct(p["r"].alias("a"), q["r"].alias("b"), p["v"].alias("x"), q["v"].alias("y")))))
    rows = each.select(label, F.explode(two).alias("p")).select(label, "p.*").filter("a <> b")
    return categorical_kappa(rows.withColumnsRenamed({"a": "ra", "b": "rb"}), [label, "ra", "rb"], "x", "y").withColumnsRenamed({"ra": "a", "rb": "b"})


def intrarater(ratings: DataFrame, duplicates: DataFrame, case: str, label: str, rater: str, value: str) -> DataFrame:
    """label, rater, n, agree, kappa of a rater's two readings of a case: duplicates (case, copy) tells which case was shown again as what."""
    first = duplicates.select(F.col(case).alias("_c"), F.col("copy").alias("_k"))
    again = ratings.select(F.col(case).alias("_kc"), F.col(label).alias("_kl"), F.col(rater).alias("_kr"), F.col(value).alias("_kv"))
    both = ratings.join(first, F.col(case) == F.col("_c")).join(again, (F.col("_k") == F.col("_kc")) & (F.col(label) == F.col("_kl")) & (F.col(rater) == F.col("_kr")))
    return categorical_kappa(both.select(label, rater, F.col(value).alias("x"), F.col("_kv").alias("y")), [label, rater], "x", "y")


def disputes(ratings: DataFrame, a: object, b: object, case: str, label: str, rater: str, value: str) -> DataFrame:
    """case, labels: what the two main raters differ on, for a third. Record level: not to be published."""
    two = of_two(ratings, a, b, case, label, rater, value).filter("a <> b")
    return two.groupBy(case).agg(F.array_join(F.sort_array(F.collect_list(F.col(label).cast("string"))), ", ").alias("labels"))


def waterfilled(cells: DataFrame, cell: str, cap: str, share: str, total: int) -> DataFrame:
    """cell, take: total dealt in proportion to shares, never above a cell's cap; what a full cell leaves goes to the others.

    Cells fill in the order of cap over share: one is full if its cap is at most its part of what the ones before it leave. Rounded by
    largest remainder, ties by cell. Cells are a few.
    """
    live = cells.filter((F.col(cap) > 0) & (F.col(share) > 0)).select(F.col(cell).alias("_cell"), F.col(cap).cast("long").alias("_cap"), F.col(share).cast("double").alias("_share"))
    order = Window.orderBy(F.col("_cap") / F.col("_share"), "_cell")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    r = live.withColumn("_n", F.least(F.lit(total).cast("long"), F.sum("_cap").over(whole)))
    left = F.col("_n") - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    r = r.withColumn("_full", F.col("_cap") * F.sum("_share").over(after) <= F.col("_share") * left)
    # a cell after one that isn't full isn't full either
    r = r.withColumn("_full", F.bool_and("_full").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rest = F.col("_n") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(whole), F.lit(0))
    r = r.withColumn("_quota", F.when(~F.col("_full"), rest * F.col("_share") / F.sum(F.when(~F.col("_full"), F.col("_share"))).over(whole)))
    r = r.withColumn("_base", F.floor(F.round("_quota", 9))).withColumn("_rest", rest - F.sum("_base").over(whole))
    rank = F.row_number().over(Window.orderBy(F.col("_full"), F.desc(F.round(F.col("_quota") - F.col("_base"), 9)), "_cell"))
    r = r.withColumn("take", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_base") + F.when(rank <= F.col("_rest"), 1).otherwise(0)).cast("long"))
    return cells.join(r.select("_cell", "take"), F.col(cell) == F.col("_cell"), "left").select(cell, F.coalesce("take", F.lit(0).cast("long")).alias("take"))


def circularity(rows: DataFrame, label: str, entity: str, score: str, comparator: str, y: str, replicates: int = 1000, seed: int = 0, k: int = SMALL) -> DataFrame:
    """label, n, with_comparator, with_label (AUROC of a score against either), difference, low, high, leak (it follows the comparator
    more than the label), sure (the whole interval says so). Both are drawn alike; null where there are fewer than k rows or one outcome."""
    known = rows.filter(F.col(score).isNotNull() & F.col(comparator).isNotNull() & F.col(y).isNotNull()).withColumn("_all", F.lit(""))
    n = known.groupBy(label).agg(F.count("*").alias("n"))
    points = [metrics.auroc(known, [label], c, score).select(label, F.col("auroc").alias(name)) for c, name in ((comparator, "with_comparator"), (y, "with_label"))]
    draws = [resample.replicated(known, [label], "_all", entity, resample.auroc(c, score), replicates, seed) for c in (y, comparator)]
    told = resample.interval(resample.difference(*draws, [label]), [label]).select(label, "low", "high")
    out = n.join(points[0], label, "left").join(points[1], label, "left").join(told, label, "left").withColumn("difference", F.col("with_comparator") - F.col("with_label"))
    shown = (F.col("n") >= k) & F.col("difference").isNotNull()
    hide = lambda c: F.when(shown, c)
    names = ("with_comparator", "with_label", "difference", "low", "high")
    return out.select(label, F.when(F.col("n") >= k, F.col("n")).alias("n"), *[hide(F.col(c)).alias(c) for c in names], hide(F.col("difference") > 0).alias("leak"), hide(F.col("low") > 0).alias("sure"))


def report(ratings: DataFrame, cases: DataFrame, main: tuple[object, object], case: str, label: str, rater: str, value: str, stratum: str, weight: str, replicates: int = metrics.REPLICATES, seed: int = 0, k: int = SMALL, least_kappa: float = 0.6, least_prevalence: float = 0.1) -> DataFrame:
    """label with: the two main raters' agreement (and weighted to the frame by ``cases``' weights), Fleiss' kappa, how consensus came
    about, prevalence by consensus, and whether the gate passes. ratings (case, label, rater, value) of cases (case, stratum, weight) only.
    """
    known = ratings.join(cases.select(F.col(case).alias("_case"), stratum, weight), F.col(case) == F.col("_case")).drop("_case")
    two = of_two(known, *main, case, label, rater, value, [stratum, weight])
    plain = binary_report(two, [label], case, stratum, None, replicates, seed, k)
    weighted = metrics.kappa(two, [label], "a", "b", weight).select(label, F.col("kappa").alias("_kw"))
    many = inference.fleiss(known, label, case, value).select(label, F.col("kappa").alias("_kf"))
    # one consensus for each case and label
    each = known.select(F.struct(case, label).alias("case_id"), F.col(rater).alias("rater"), F.col(value).alias("y"))
    agreed = sampling.consensus(each).select("case_id.*", "status", "y").join(cases.select(F.col(case).alias("_case"), F.col(weight).alias("_w")), F.col(case) == F.col("_case"))
    count = lambda s: F.when(F.count_if(F.col("status") == s) >= k, F.count_if(F.col("status") == s)).alias(f"n_{s}")
    how = agreed.groupBy(label).agg(*[count(s) for s in ("agreed", "majority", "pending")], F.count("y").alias("_g"), (F.sum(F.when(F.col("y").isNotNull(), F.col("_w")) * F.col("y")) / F.sum(F.when(F.col("y").isNotNull(), F.col("_w")))).alias("_p"))
    out = plain.join(weighted, label, "left").join(many, label, "left").join(how, label, "left")
    shown: Column = F.col("kappa").isNotNull()
    prevalence = F.when(F.col("_g") >= k, F.col("_p"))
    gate = F.coalesce((F.col("kappa") >= least_kappa) & (prevalence >= least_prevalence), F.lit(False))
    return out.select(
        *plain.columns, F.when(shown, F.col("_kw")).alias("kappa_weighted"), F.when(shown, F.col("_kf")).alias("fleiss"), "n_agreed", "n_majority", "n_pending", prevalence.alias("prevalence"), gate.alias("passes")
    )

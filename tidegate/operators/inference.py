"""Inference over predictions, sites and raters: intervals of site means, gains, gates, audits and agreement."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.expressions import log_loss


def t_quantile(q: float, df: int) -> float:
    """By bisection of the distribution's integral."""
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def below(t: float) -> float:
        # in the angle, the density is a power of the cosine: smooth on a bounded range
        x = np.linspace(0, math.atan(t / math.sqrt(df)), 4_001)
        return 0.5 + scale * math.sqrt(df) * float(np.trapezoid(np.cos(x) ** (df - 1), x))

    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < q else (low, mid)
    return low


def site_mean(values: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """n sites, mean, se, df, low, high of a t interval over one value for each site; fewer than two sites have no interval."""
    r = values.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se")).first()
    n, mean, se = r["n"], r["mean"], r["se"]
    known = n >= 2 and se is not None
    t = t_quantile((1 + level) / 2, n - 1) if known else None
    row = (n, mean, se if known else None, n - 1 if known else None, mean - t * se if known else None, mean + t * se if known else None)
    return values.sparkSession.createDataFrame([row], "n long, mean double, se double, df long, low double, high double")


def interaction(rows: DataFrame, delta: str, early: str, by: list[str]) -> DataFrame:
    """by, n_early, n_late, and the mean difference of a delta between early and late rows; null if one side is empty."""
    e = F.expr(early)
    out = rows.filter(F.col(delta).isNotNull() & e.isNotNull()).groupBy(*by).agg(F.count_if(e).alias("n_early"), F.count_if(~e).alias("n_late"), F.avg(F.when(e, F.col(delta))).alias("_a"), F.avg(F.when(~e, F.col(delta))).alias("_b"))
    return out.select(*by, "n_early", "n_late", (F.col("_a") - F.col("_b")).alias("difference"))


def gain_ratio(rows: DataFrame, window: str, delta: str, full: float, fraction: float) -> DataFrame:
    """window, gain, ratio to the full window's gain, and whether it is the first to reach a fraction of it."""
    gains = rows.groupBy(window).agg(F.avg(delta).alias("gain"))
    whole = gains.filter(F.col(window) == full).select(F.col("gain").alias("_full"))
    ratio = gains.crossJoin(F.broadcast(whole)).withColumn("ratio", F.when(F.col("_full") != 0, F.col("gain") / F.col("_full")))  # a row for each window and one
    first = ratio.filter(F.col("ratio") >= fraction).agg(F.min(window).alias("_first"))
    return ratio.crossJoin(F.broadcast(first)).select(window, "gain", "ratio", F.coalesce(F.col(window) == F.col("_first"), F.lit(False)).alias("first"))


def variant_gap(rows: DataFrame, a: str, b: str, y: str, exposed: str, by: list[str]) -> DataFrame:
    """by, n, gap of the mean losses of two variants, and the same without exposed rows."""
    gap = log_loss(F.col(y), F.col(a)) - log_loss(F.col(y), F.col(b))
    clean = ~F.coalesce(F.expr(exposed), F.lit(False))
    return rows.filter(F.col(y).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(gap).alias("gap"), F.count_if(clean).alias("n_clean"), F.avg(F.when(clean, gap)).alias("gap_clean"))


def agreement(a: Column, b: Column) -> dict[str, Column]:
    """Sums that tell kappa of two booleans."""
    return {"n": F.count_if(a.isNotNull() & b.isNotNull()), "both": F.count_if(a & b), "a1": F.count_if(a & b.isNotNull()), "b1": F.count_if(b & a.isNotNull()), "none": F.count_if(~a & ~b)}


def kappas(rows: DataFrame, pairs: dict[str, tuple[Column, Column]], by: list[str], low: float = 0.6) -> DataFrame:
    """by, pair, n, agree, kappa, low: of each pair of boolean columns; kappa is null where chance alone agrees."""
    parts = []
    for name, (a, b) in pairs.items():
        s = rows.groupBy(*by).agg(*[c.alias(k) for k, c in agreement(a, b).items()])
        agree = (F.col("both") + F.col("none")) / F.col("n")
        chance = (F.col("a1") * F.col("b1") + (F.col("n") - F.col("a1")) * (F.col("n") - F.col("b1"))) / (F.col("n") * F.col("n"))
        s = s.filter("n > 0").withColumns({"agree": agree, "_c": chance}).withColumn("kappa", F.when(F.col("_c") < 1, (F.col("agree") - F.col("_c")) / (1 - F.col("_c"))))
        parts.append(s.select(*by, F.lit(name).alias("pair"), "n", "agree", "kappa", F.coalesce(F.col("kappa") < low, F.lit(False)).alias("low")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gates(rows: DataFrame, family: str, kappa: str, prevalence: str, least_kappa: float = 0.6, least_prevalence: float = 0.1) -> DataFrame:
    """family, labels, passing, primary: at least half of the labels have kappa and prevalence enough; unknown isn't enough."""
    ok = F.coalesce((F.col(kappa) >= least_kappa) & (F.col(prevalence) >= least_prevalence), F.lit(False))
    out = rows.groupBy(family).agg(F.count("*").alias("labels"), F.count_if(ok).alias("passing"))
    return out.withColumn("primary", 2 * F.col("passing") >= F.col("labels"))


def fleiss(ratings: DataFrame, label: str, case: str, value: str) -> DataFrame:
    """label, cases, kappa of Fleiss over cases with several ratings, as many as most of them have; null where chance alone agrees."""
    each = ratings.filter(F.col(value).isNotNull()).groupBy(label, case).agg(F.count("*").alias("m"), F.sum(F.col(value).cast("long")).alias("k")).filter("m > 1")
    usual = each.groupBy(label, "m").agg(F.count("*").alias("c")).groupBy(F.col(label).alias("_l")).agg(F.max(F.struct("c", "m")).alias("u"))
    same = each.join(usual, F.col(label) == F.col("_l")).filter(F.col("m") == F.col("u.m"))
    k, m = F.col("k"), F.col("m")
    within = (k * (k - 1) + (m - k) * (m - k - 1)) / (m * (m - 1))
    s = same.groupBy(label).agg(F.count("*").alias("cases"), F.avg(within).alias("_o"), (F.sum(k) / F.sum(m)).alias("_p"))
    e = F.col("_p") * F.col("_p") + (1 - F.col("_p")) * (1 - F.col("_p"))
    return s.select(label, "cases", F.when(e < 1, (F.col("_o") - e) / (1 - e)).alias("kappa"))


def rater_pairs(ratings: DataFrame, case: str, label: str, rater: str, value: str) -> DataFrame:
    """label, a, b, n, agree of each two raters: a case's ratings are a few, and meet in an array."""
    each = ratings.filter(F.col(value).isNotNull()).groupBy(case, label).agg(F.sort_array(F.collect_list(F.struct(F.col(rater).alias("r"), F.col(value).alias("v")))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda p, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda q: F.struct(p["r"].alias("a"), q["r"].alias("b"), (p["v"] == q["v"]).alias("same")))))
    return each.select(label, F.explode(pairs).alias("p")).groupBy(label, "p.a", "p.b").agg(F.count("*").alias("n"), F.avg(F.col("p.same").cast("double")).alias("agree"))

"""Paired differences by site, stratum and grade, and labels under other readings. A delta below zero is a gain of the second model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.operators import concordance, resample


def by_site(deltas: DataFrame, site: str, delta: str) -> DataFrame:
    """site, n, delta of rows with a known delta; rows without a site are one."""
    return deltas.filter(F.col(delta).isNotNull()).groupBy(site).agg(F.count("*").alias("n"), F.avg(delta).alias("delta"))


def over_sites(deltas: DataFrame, site: str, delta: str) -> DataFrame:
    """sites, every_site (each gains), mean and se with a site as one value, and pooled, with a row as one. One row."""
    s = by_site(deltas, site, delta)
    return s.agg(
        F.count("*").alias("sites"), F.bool_and(F.col("delta") < 0).alias("every_site"), F.avg("delta").alias("mean"), (F.stddev_samp("delta") / F.sqrt(F.count("*"))).alias("se"),
        F.try_divide(F.sum(F.col("delta") * F.col("n")), F.sum("n")).alias("pooled"),
    )


def by_stratum(deltas: DataFrame, stratum: str, delta: str, least: int = 1) -> DataFrame:
    """stratum, n, delta, against_first: mean delta of each stratum, and less that of the first by its order; null below ``least`` rows."""
    s = deltas.filter(F.col(delta).isNotNull()).groupBy(stratum).agg(F.count("*").alias("n"), F.avg(delta).alias("_m"))
    s = s.withColumn("delta", F.when(F.col("n") >= least, F.col("_m")))
    first = s.agg(F.min_by("delta", stratum).alias("_first"))
    return s.crossJoin(first).select(stratum, "n", "delta", (F.col("delta") - F.col("_first")).alias("against_first"))  # first is one row


def strata_rule(deltas: DataFrame, stratum: str, site: str, entity: str, delta: str, need: int = 2, least: int = 11, replicates: int = 2000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(stratum, n, delta, low, high, gains), and one row (strata, gaining, met): a stratum gains if its interval, of rows drawn within
    sites, lies below zero; the rule is met if ``need`` strata of those with ``least`` rows or more gain."""
    point = by_stratum(deltas, stratum, delta, least)
    told = resample.interval(resample.replicated(deltas.filter(F.col(stratum).isNotNull()), [stratum], site, entity, resample.mean(delta), replicates, seed), [stratum]).select(stratum, "low", "high")
    shown = F.col("delta").isNotNull()
    each = point.join(told, stratum, "left").select(stratum, "n", "delta", *[F.when(shown, F.col(c)).alias(c) for c in ("low", "high")], F.coalesce(shown & (F.col("high") < 0), F.lit(False)).alias("gains"))
    return each, each.agg(F.count("delta").alias("strata"), F.count_if("gains").alias("gaining"), (F.count_if("gains") >= need).alias("met"))


def by_grade(deltas: DataFrame, grade: str, delta: str) -> DataFrame:
    """grade, n, delta."""
    return deltas.filter(F.col(grade).isNotNull() & F.col(delta).isNotNull()).groupBy(grade).agg(F.count("*").alias("n"), F.avg(delta).alias("delta"))


def graded(deltas: DataFrame, grade: str, delta: str, site: str, heavy: float) -> DataFrame:
    """slope of the delta over the grade, within_site (both less their site's means), light and heavy means (below and from ``heavy``),
    their difference, and spearman. One row; null where it can't be told."""
    known = deltas.filter(F.col(grade).isNotNull() & F.col(delta).isNotNull()).select(F.col(site).alias("s"), F.col(grade).cast("double").alias("x"), F.col(delta).alias("d"))
    x, d = F.col("x"), F.col("d")
    # sums by site tell what is within sites: no row meets its site's mean
    s = known.groupBy("s").agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in {"x": x, "d": d, "xx": x * x, "xd": x * d, "nh": (x >= heavy).cast("long"), "dh": F.when(x >= heavy, d).otherwise(0.0)}.items()])
    total = s.agg(
        *[F.sum(c).alias(f"t_{c}") for c in ("n", "x", "d", "xx", "xd", "nh", "dh")],
        F.sum(F.col("xd") - F.col("x") * F.col("d") / F.col("n")).alias("w_xd"), F.sum(F.col("xx") - F.col("x") * F.col("x") / F.col("n")).alias("w_xx"),
    )
    rho = concordance.spearman(known, [], "x", "d").select(F.col("rho").alias("spearman"))
    ratio = lambda a, b: F.when(F.expr(b) > 1e-12, F.expr(a) / F.expr(b))
    light, heavy_mean = ratio("t_d - t_dh", "t_n - t_nh"), ratio("t_dh", "t_nh")
    out = total.select(
        ratio("t_xd - t_x * t_d / t_n", "t_xx - t_x * t_x / t_n").alias("slope"), ratio("w_xd", "w_xx").alias("within_site"), light.alias("light"), heavy_mean.alias("heavy"), (heavy_mean - light).alias("difference")
    )
    return out.join(rho, F.lit(True), "left")  # one row each


def variants(rows: DataFrame, entity: str, readings: dict[str, Column]) -> DataFrame:
    """variant, n, positive: entities with a value, and with a true one, of each reading (an aggregate of an entity's rows)."""
    out = rows.groupBy(entity).agg(*[c.alias(n) for n, c in readings.items()])
    return out.unpivot(entity, list(readings), "variant", "y").filter("y IS NOT NULL").groupBy("variant").agg(F.count("*").alias("n"), F.count_if("y").alias("positive"))

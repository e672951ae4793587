"""Summaries of cases and classes: shares with their most frequent classes, modes, bands, binned values, forms, correlated columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.operators import ranks


def class_shares(rows: DataFrame, site: str, cls: str) -> DataFrame:
    """site (null: pooled), cls, n, share of the site's rows."""
    counts = rows.groupingSets([[F.col(site), F.col(cls)], [F.col(cls)]], site, cls).agg(F.count("*").alias("n"))
    return counts.select(site, cls, "n", (F.col("n") / F.sum("n").over(Window.partitionBy(site))).alias("share"))


def top_class_shares(rows: DataFrame, site: str, cls: str, k: int) -> DataFrame:
    """The same with the k most frequent classes of all rows by name, ties by name, and the rest as 'other'."""
    top = rows.filter(F.col(cls).isNotNull()).groupBy(cls).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), cls).limit(k).select(F.col(cls).alias("_top"))
    named = rows.join(F.broadcast(top), F.col(cls) == F.col("_top"), "left")  # k rows
    return class_shares(named.select(site, F.coalesce("_top", F.lit("other")).alias(cls)), site, cls)


def modes(rows: DataFrame, site: str, bin: str, least: float = 0.05) -> DataFrame:
    """site, bin, share: bins with a share above ``least`` that exceed the bin before and aren't below the next; one without rows counts 0."""
    h = rows.groupBy(site, bin).agg(F.count("*").alias("n"))
    w = Window.partitionBy(site).orderBy(bin)
    side = lambda f, step: F.when(f(bin).over(w) == F.col(bin) + step, f("n").over(w)).otherwise(0)
    r = h.withColumns({"_before": side(F.lag, -1), "_after": side(F.lead, 1), "share": F.col("n") / F.sum("n").over(Window.partitionBy(site))})
    return r.filter((F.col("share") > least) & (F.col("n") > F.col("_before")) & (F.col("n") >= F.col("_after"))).select(site, bin, "share")


def near_shares(rows: DataFrame, site: str, hours: str, within: dict[str, float]) -> DataFrame:
    """site, n, and the share of known hours within each number of hours of zero, either way."""
    known = rows.filter(F.col(hours).isNotNull())
    return known.groupBy(site).agg(F.count("*").alias("n"), *[F.avg((F.abs(hours) <= h).cast("double")).alias(c) for c, h in within.items()])


def any_all_shares(rows: DataFrame, case: str, site: str, condition: Column) -> DataFrame:
    """site, any_share, all_share: of cases with a row, and with all rows, that meet a condition. A case has one site."""
    each = rows.groupBy(case).agg(F.any_value(site).alias(site), F.bool_or(condition).alias("_any"), F.bool_and(condition).alias("_all"))
    return each.groupBy(site).agg(F.avg(F.col("_any").cast("double")).alias("any_share"), F.avg(F.col("_all").cast("double")).alias("all_share"))


def bands(rows: DataFrame, site: str, band: Column, x: Column) -> DataFrame:
    """site (null: pooled), band, n, share: mean of x in each band."""
    b = rows.select(F.col(site), band.alias("band"), x.cast("double").alias("_x"))
    return b.groupingSets([[F.col(site), F.col("band")], [F.col("band")]], site, "band").agg(F.count("*").alias("n"), F.avg("_x").alias("share"))


def binned_values(rows: DataFrame, case: str, item: str, hours: Column, value: str, width_h: float) -> DataFrame:
    """case, item, bin, n, median, low, high of known values in bins of so many hours."""
    v = rows.filter(F.col(value).isNotNull()).select(case, item, F.floor(hours / width_h).alias("bin"), F.col(value).alias("_v"))
    return v.groupBy(case, item, "bin").agg(F.count("*").alias("n"), F.median("_v").alias("median"), F.min("_v").alias("low"), F.max("_v").alias("high"))


def form_checks(forms: DataFrame, checks: dict[str, Column], minutes: str) -> DataFrame:
    """forms, how many meet each check, quartiles of the minutes. One row; unknown isn't met."""
    counts = forms.agg(F.count("*").alias("forms"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    q = ranks.quantiles(forms.withColumn("_one", F.lit(1)), ["_one"], minutes, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).select("q25", "q50", "q75")
    return counts.join(q, F.lit(True), "left")  # one row each


def top_correlated(rows: DataFrame, feature: str, label: str, x: str, y: str, k: int, protected: list[str] | None = None) -> DataFrame:
    """feature, corr, rank, protected: the k features with the highest absolute correlation with any label, ties by feature; protected
    ones stay besides, without taking a place. rows: a value x of each entity and feature beside its labels' y. Features are columns of a
    matrix: some thousands."""
    a, b = F.col("_x"), F.col("_y")
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(feature, label, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    # corr itself raises on a constant column
    each = known.groupBy(feature, label).agg(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("_c"))
    best = each.groupBy(feature).agg(F.round(F.max(F.abs("_c")), 9).alias("corr")).withColumn("protected", F.col(feature).cast("string").isin(protected or []))
    free = best.filter("NOT protected AND corr IS NOT NULL").orderBy(F.desc("corr"), feature).limit(k)
    free = free.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("corr"), feature)).cast("long"))  # k rows
    kept = best.filter("protected").withColumn("rank", F.lit(None).cast("long"))
    return free.unionByName(kept).select(feature, "corr", "rank", "protected")

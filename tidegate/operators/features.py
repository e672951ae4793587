"""Features per entity from gated events: one grouped pass of conditional aggregates, then a fixed order of columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.operators import ranks
from tidegate.operators.gate import checked


@dataclass(frozen=True)
class Feature:
    """kind: latest, age, first, ever, recent, count, sum, dose, distinct. fill: value for entities without rows, None for unknown."""

    name: str
    kind: str
    domain: str
    key: str | None = None
    window_h: float | None = None
    fill: float | None = None


def aggregate(f: Feature) -> Column:
    rows = F.col("domain") == f.domain
    if f.key is not None:
        rows &= F.col("key") == f.key
    if f.window_h is not None:
        rows &= F.col("hours_since_event") <= f.window_h
    order = F.struct("t_event", "t_avail", "event_id")
    match f.kind:
        case "latest":
            return F.max_by("value", F.when(rows & F.col("value").isNotNull(), order))
        case "age":
            return F.max_by("hours_since_event", F.when(rows & F.col("value").isNotNull(), order))
        case "first":
            return F.min_by("value", F.when(rows & F.col("value").isNotNull(), order))
        case "ever" | "recent":
            return F.max(F.when(rows, 1.0))
        case "count":
            return F.count(F.when(rows, 1)).cast("double")
        case "sum":
            return F.sum(F.when(rows, F.col("value")))
        case "distinct":
            return F.count_distinct(F.when(rows, F.col("key"))).cast("double")
        case "dose":
            return F.sum(F.when(F.col("domain") == f.domain, dose_share(f.window_h)))
    raise ValueError(f.kind)


def dose_share(window_h: float) -> Column:
    """The part of an ended interval's quantity that falls in the hours before t0; a running one counts nothing."""
    start, end = F.col("hours_since_event"), F.timestamp_diff("MICROSECOND", F.col("t_end"), F.col("t0")) / F.lit(3.6e9)
    length = start - end
    inside = F.greatest(F.lit(0.0), F.least(start, F.lit(window_h)) - end)
    share = F.when(length > 0, inside / length).otherwise(F.when(start <= window_h, 1.0).otherwise(0.0))
    return F.when(~F.col("ongoing") & F.col("quantity").isNotNull(), share * F.col("quantity")).otherwise(0.0)


def matrix(gated: DataFrame, index: DataFrame, features: list[Feature], missing: bool = True) -> DataFrame:
    """A row for each entity of the index: features in order, each unknown-able one with its __miss indicator.

    Raises for frames that haven't passed the gate.
    """
    wide = checked(gated).groupBy("entity_id").agg(*[aggregate(f).alias(f.name) for f in features])
    out = index.select("entity_id").join(wide, "entity_id", "left")
    cols = ["entity_id"]
    for f in features:
        cols.append(F.coalesce(f.name, F.lit(f.fill)).alias(f.name) if f.fill is not None else F.col(f.name))
        if missing and f.fill is None:
            cols.append(F.col(f.name).isNull().cast("int").alias(f"{f.name}__miss"))
    return out.select(*cols)


def long_form(wide: DataFrame, features: list[Feature]) -> DataFrame:
    """entity_id, feature, value, kind, domain, window_h."""
    names = [f.name for f in features]
    rows = wide.select("entity_id", *[F.col(n).cast("double") for n in names]).unpivot("entity_id", names, "feature", "value")
    of = wide.sparkSession.createDataFrame([(f.name, f.kind, f.domain, None if f.window_h is None else float(f.window_h)) for f in features], "feature string, kind string, domain string, window_h double")
    return rows.join(F.broadcast(of), "feature")  # the registry is a list in code


def missingness(wide: DataFrame, features: list[Feature]) -> DataFrame:
    return long_form(wide, features).groupBy("feature").agg(F.count("*").alias("n"), F.avg(F.col("value").isNull().cast("double")).alias("missing"))


def shares(flags: DataFrame, site: str, columns: list[str]) -> DataFrame:
    """site (null: all), flag, n, n_true, share, by rollup."""
    rows = flags.select(site, *[F.col(c).cast("int") for c in columns]).unpivot(site, columns, "flag", "v")
    out = rows.rollup("flag", site).agg(F.count("v").alias("n"), F.sum("v").alias("n_true"))
    return out.filter("flag IS NOT NULL").select("flag", F.col(site).alias("site"), "n", "n_true", (F.col("n_true") / F.col("n")).alias("share"))


def binned(rows: DataFrame, metric: str, site: str, bins: str) -> DataFrame:
    """n and mean of a metric per site and bin, and per bin over all sites (null site)."""
    out = rows.groupingSets([[F.col(site), F.col(bins)], [F.col(bins)]], site, bins).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"))
    return out.select(F.col(site).alias("site"), F.col(bins).alias("bin"), "n", "mean")


def quantiles(rows: DataFrame, by: str, value: str, qs: tuple[float, ...] = (0.25, 0.5, 0.75), least: int = 11) -> DataFrame:
    """Linear quantiles of groups with enough rows; others get none."""
    names = {f"q{round(100 * q)}": q for q in qs}
    known = ranks.quantiles(rows, [by], value, names)
    groups = rows.select(F.col(by).alias("_g")).distinct()
    out = groups.join(known, F.col("_g").eqNullSafe(F.col(by)), "left")
    return out.select(F.col("_g").alias(by), F.coalesce("n", F.lit(0)).alias("n"), *[F.when(F.col("n") >= least, F.col(q)).alias(q) for q in names])

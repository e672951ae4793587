"""Window operators: earlier extremes, sustained runs, new starts, qualifying days, rank bins, temporal holdouts, folds, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.operators import ranks

from tidegate.functions.expressions import hours_between


def prior_extremes(rows: DataFrame, key: tuple[str, ...] = ("entity_id",), order: tuple[str, ...] = ("t_event", "event_id")) -> DataFrame:
    """Adds prior_min and prior_max over strictly earlier rows."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"prior_min": F.min("value").over(w), "prior_max": F.max("value").over(w)})


def sustained_low(rows: DataFrame, below: float, least_h: float, gap_h: float) -> DataFrame:
    """entity_id, onset, until, n of runs of low values with small gaps that last long enough. Any other value between ends a run."""
    w = Window.partitionBy("entity_id").orderBy("t_event", "event_id")
    low = F.col("value") < below
    r = rows.filter("value IS NOT NULL").withColumn("low", low)
    breaks = ~F.lag("low", 1, False).over(w) | (hours_between(F.lag("t_event").over(w), "t_event") > gap_h)
    r = r.withColumn("new", F.when(F.col("low"), F.coalesce(breaks, F.lit(True)).cast("int")).otherwise(0)).withColumn("run", F.sum("new").over(w))
    out = r.filter("low").groupBy("entity_id", "run").agg(F.min("t_event").alias("onset"), F.max("t_event").alias("until"), F.count("*").alias("n"))
    return out.filter(hours_between("onset", "until") >= least_h).drop("run")


def new_starts(rows: DataFrame, washout_h: float, key: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """Rows with no row of the same key in the hours before them."""
    w = Window.partitionBy(*key).orderBy("t_event", "event_id")
    return rows.withColumn("gap_h", hours_between(F.lag("t_event").over(w), "t_event")).filter(F.col("gap_h").isNull() | (F.col("gap_h") >= washout_h))


def day_islands(days: DataFrame, least: int, bridge: int = 1) -> DataFrame:
    """days (entity_id, agent, day): runs of at least some days. A gap of ``bridge`` days is filled within one agent, then agents unite."""
    w = Window.partitionBy("entity_id", "agent").orderBy("day")
    d = days.distinct().withColumn("next", F.lead("day").over(w))
    upto = F.when(F.datediff("next", "day").between(2, bridge + 1), F.date_sub("next", 1)).otherwise(F.col("day"))
    filled = d.select("entity_id", F.explode(F.sequence("day", upto)).alias("day")).distinct()
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy("day"))
    islands = filled.withColumn("island", F.date_sub("day", rank)).groupBy("entity_id", "island").agg(F.min("day").alias("first_day"), F.count("*").alias("days"))
    return islands.filter(F.col("days") >= least).drop("island")


def rank_bins(rows: DataFrame, site: str, order: tuple[str, ...], bins: int) -> DataFrame:
    """bin = floor(rank0 * bins / n) per site: sizes differ from ntile's."""
    r = ranks.ranked(rows, [site], list(order))
    return r.withColumn("bin", F.floor((F.col("_rank") - 1) * bins / F.col("_size")).cast("int")).drop("_rank", "_size")


def tenths(rows: DataFrame, site: str, order: tuple[str, ...]) -> DataFrame:
    return ranks.ranked(rows, [site], list(order)).withColumn("tenth", ranks.ntile(10)).drop("_rank", "_size")


def late_holdout(rows: DataFrame, site: str, seconds: str, fraction: float, embargo_s: float) -> DataFrame:
    """role test from the site's late quantile on, train before it less the embargo, else none."""
    cut = ranks.quantiles(rows, [site], seconds, {"cut": 1 - fraction}).drop("n")
    role = F.when(F.col(seconds) >= F.col("cut"), "test").when(F.col(seconds) < F.col("cut") - embargo_s, "train").otherwise("none")
    return rows.join(cut, site).withColumn("role", role).drop("cut")


def leave_one_out(rows: DataFrame, site: str) -> DataFrame:
    """A row for each fold and row: eval for the fold's site, dev otherwise. Sites are few: folds repeat the rows as often."""
    folds = F.collect_set(site)
    sites = rows.agg(F.sort_array(folds).alias("folds"))
    out = rows.join(F.broadcast(sites)).withColumn("fold", F.explode("folds")).drop("folds")
    return out.withColumn("role", F.when(F.col(site) == F.col("fold"), "eval").otherwise("dev"))


def cumulative_risk(rows: DataFrame, site: str) -> DataFrame:
    """Coverage and mean risk of the most confident rows up to each: rows (id, risk, conf), within a site."""
    r = ranks.ranked(rows.select(site, "id", F.col("risk").cast("double").alias("risk"), "conf"), [site], [F.desc("conf"), "id"], ("risk",))
    return r.select(site, "id", (F.col("_rank") / F.col("_size")).alias("coverage"), (F.col("_sum_risk") / F.col("_rank")).alias("risk"))


def top_values(rows: DataFrame, site: str, value: str, k: int) -> DataFrame:
    """The k most frequent values per site; what is left is counted as 'other'."""
    n = rows.groupBy(site, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(site).orderBy(F.desc("n"), value)
    # k rows of each partition are all that the ranks see; the others' number is a difference of sums
    top = n.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).select(site, F.col(value).cast("string").alias("label"), "n")
    all_of = rows.groupBy(site).agg(F.count("*").alias("_all")).withColumnRenamed(site, "_s")
    shown = top.groupBy(site).agg(F.sum("n").alias("_top"))
    rest = shown.join(all_of, F.col(site).eqNullSafe(F.col("_s"))).select(site, F.lit("other").alias("label"), (F.col("_all") - F.col("_top")).alias("n"))
    return top.unionByName(rest.filter("n > 0")).groupBy(site, "label").agg(F.sum("n").alias("n"))


def capped(notes: DataFrame, case: str, order: tuple[str, ...], most: int, most_chars: int) -> DataFrame:
    """Notes in order until there are enough, or one would exceed the characters; none after that."""
    w = Window.partitionBy(case).orderBy(*order)
    run = notes.withColumns({"_n": F.row_number().over(w), "_c": F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return run.filter((F.col("_n") <= most) & (F.col("_c") <= most_chars)).drop("_n", "_c")

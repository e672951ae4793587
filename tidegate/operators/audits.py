"""Audits: orderings that can't be, novelty, exclusive causes, ledgers, geometry of intervals, populations side by side, merged flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.expressions import hours_between, plus_microseconds
from tidegate.operators import ranks
from tidegate.operators.disclose import SMALL
from tidegate.operators.intervals import stabbed
from tidegate.sources.shared import written

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def bilateral(wide: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """For each pair of columns: <name>_any_zero and <name>_gap, null where neither, or not both, are known."""
    out = {}
    for name, (a, b) in pairs.items():
        zero = F.when(F.col(a).isNotNull() | F.col(b).isNotNull(), F.coalesce(F.col(a) == 0, F.lit(False)) | F.coalesce(F.col(b) == 0, F.lit(False)))
        out |= {f"{name}_any_zero": zero.cast("int"), f"{name}_gap": F.abs(F.col(a) - F.col(b))}
    return wide.withColumns(out)


def results(gated: DataFrame, domain: str, positive: str) -> DataFrame:
    """entity_id, key, latest by availability, resulted, positive, n of a domain's rows in a gated frame."""
    rows = gated.filter(F.col("domain") == domain)
    order = F.when(F.col("value").isNotNull(), F.struct("t_avail", "t_event", "event_id"))
    return rows.groupBy("entity_id", "key").agg(
        F.max_by("value", order).alias("latest"), F.bool_or(F.col("value").isNotNull()).alias("resulted"), F.coalesce(F.bool_or(F.expr(positive)), F.lit(False)).alias("positive"), F.count("*").alias("n")
    )


def one_hot(rows: DataFrame, column: str, categories: dict[str, str], keep: list[str]) -> DataFrame:
    """A 0/1 column for each category, by the first pattern that the wording has, and one for other."""
    kind = F.lit("other")
    for name, pattern in reversed(categories.items()):
        kind = F.when(F.lower(column).rlike(pattern), name).otherwise(kind)
    marked = rows.withColumn("_k", F.coalesce(kind, F.lit("other")))
    return marked.select(*keep, *[(F.col("_k") == n).cast("int").alias(f"{column}_{n}") for n in [*categories, "other"]])


def misordered(sources: dict[str, tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """source, rule, n, n_bad: rows that break a rule; unknown isn't broken."""
    parts = []
    for source, (rows, rules) in sources.items():
        counts = rows.agg(F.count("*").alias("n"), *[F.count_if(F.expr(c)).alias(r) for r, c in rules.items()])
        parts.append(counts.unpivot(["n"], list(rules), "rule", "n_bad").select(F.lit(source).alias("source"), "rule", "n", "n_bad"))
    return reduce(DataFrame.unionByName, parts)


def novelty(new: DataFrame, old: DataFrame, site: str, wording: str) -> DataFrame:
    """site, n, n_new: rows whose wording the site's older rows don't have."""
    known = old.select(F.col(site).alias("_s"), F.col(wording).alias("_w")).distinct()
    same = F.col(site).eqNullSafe(F.col("_s")) & F.col(wording).eqNullSafe(F.col("_w"))
    counts = new.groupBy(site).agg(F.count("*").alias("n"))
    unseen = new.join(known, same, "left_anti").groupBy(F.col(site).alias("_site")).agg(F.count("*").alias("k"))
    return counts.join(unseen, F.col(site).eqNullSafe(F.col("_site")), "left").select(site, "n", F.coalesce("k", F.lit(0)).alias("n_new"))


def cause(causes: list[tuple[str, str]]) -> Column:
    """The first cause whose condition is met, else none."""
    out = F.lit("none")
    for name, condition in reversed(causes):
        out = F.when(F.coalesce(F.expr(condition), F.lit(False)), name).otherwise(out)
    return out


def ledger_summary(ledger: DataFrame, reason: str, size: str, seconds: str) -> DataFrame:
    """reason, n, total size, quartiles of seconds."""
    out = ledger.groupBy(reason).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    q = ranks.quantiles(ledger, [reason], seconds, QUARTILES).drop("n").withColumnRenamed(reason, "_r")
    return out.join(q, F.col(reason).eqNullSafe(F.col("_r")), "left").select(reason, "n", "bytes", *QUARTILES)


def geometry(points: DataFrame, intervals: DataFrame, slack_h: float) -> DataFrame:
    """point_id with: intervals, null and midnight ends, cover by four rules, the nearest start in hours, the latest start up to the point.

    Points whose entity has no interval are left out. What holds for all of an entity's intervals is counted once for it; covers meet by
    cells of time; the nearest and the latest start come from one order of points and starts.
    """
    intervals = written(intervals.select("entity_id", "t_start", "t_end"), "intervals")
    own = intervals.groupBy(F.col("entity_id").alias("_e")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("t_end").isNull()).alias("null_ends"),
        F.count_if(F.date_trunc("DAY", "t_end") == F.col("t_end")).alias("midnight_ends"),
        F.min(F.when(F.col("t_end").isNull(), F.col("t_start"))).alias("_open"),
    )
    micros = F.lit(round(slack_h * 3.6e9)).cast("long")
    ends = F.greatest(plus_microseconds("t_end", micros), F.timestamp_add("DAY", F.lit(1), F.date_trunc("DAY", "t_end").cast("timestamp_ntz")))
    j = stabbed(points.select("entity_id", "point_id", "t"), intervals.filter("t_start IS NOT NULL AND t_end IS NOT NULL"), F.least(plus_microseconds("t_start", -micros), F.col("t_start")), ends)
    begun = F.col("t_start") <= F.col("t")
    covers = j.groupBy(F.col("point_id").alias("_p")).agg(
        F.bool_or(begun & (F.col("t_end") >= F.col("t"))).alias("exact"),
        F.bool_or(begun & (F.to_date("t_end") >= F.to_date("t"))).alias("whole_day"),
        F.bool_or((hours_between("t", "t_start") <= slack_h) & (hours_between("t_end", "t") <= slack_h)).alias("slack"),
    )
    no = F.lit(None)
    starts = intervals.filter("t_start IS NOT NULL").select("entity_id", F.col("t_start").alias("t"), F.col("t_start").alias("s"), no.cast(points.schema["point_id"].dataType).alias("point_id"))
    both = starts.unionByName(points.select("entity_id", "t", no.cast(intervals.schema["t_start"].dataType).alias("s"), "point_id"))
    order = Window.partitionBy("entity_id").orderBy("t", F.col("s").isNull())
    # backwards: a frame to the end of the group would be read anew for each row
    back_order = Window.partitionBy("entity_id").orderBy(F.desc("t"), F.col("s").isNull().desc())
    told = both.withColumns({"_last": F.last("s", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.last("s", True).over(back_order.rowsBetween(Window.unboundedPreceding, -1))}).filter("point_id IS NOT NULL")
    back, on = hours_between("t", "_last"), hours_between("t", "_next")
    nearest = F.when(back.isNull() | (on < -back), on).otherwise(back)
    flag = lambda c: F.coalesce(c, F.lit(False))
    out = told.join(own, F.col("entity_id") == F.col("_e")).join(covers, F.col("point_id") == F.col("_p"), "left")
    return out.select(
        "point_id", "n", "null_ends", "midnight_ends", flag(F.col("exact")).alias("exact"), (flag(F.col("exact")) | flag(F.col("_open") <= F.col("t"))).alias("open_end"),
        flag(F.col("whole_day")).alias("whole_day"), flag(F.col("slack")).alias("slack"), nearest.alias("nearest_start_h"), F.col("_last").alias("latest_start"),
    )


def top_wordings(rows: DataFrame, site: str, wording: str, matched: str, k: int) -> DataFrame:
    """site, matched, wording, n of the k most frequent matched and unmatched wordings of each site."""
    counts = rows.groupBy(site, F.coalesce(F.expr(matched), F.lit(False)).alias("matched"), wording).agg(F.count("*").alias("n"))
    order = Window.partitionBy(site, "matched").orderBy(F.desc("n"), F.col(wording).asc_nulls_first())
    # k rows of each partition are all that is shuffled: the limit on the rank goes below the exchange
    return counts.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).select(site, "matched", wording, "n")


def coverage_in(rows: DataFrame, site: str, hours: str, windows: dict[str, tuple[float, float]]) -> DataFrame:
    """site, n cases, and how many have a row in each window."""
    each = rows.groupBy(site, "case_id").agg(*[F.coalesce(F.bool_or(F.col(hours).between(*w)), F.lit(False)).alias(n) for n, w in windows.items()])
    return each.groupBy(site).agg(F.count("*").alias("n"), *[F.count_if(n).alias(n) for n in windows])


def populations(rows: DataFrame, masks: dict[str, str], flags: dict[str, str], value: str) -> DataFrame:
    """population, n, share of each flag, quartiles of a value: a row belongs to every population whose mask it meets."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(m), F.lit(False)), F.lit(n)) for n, m in masks.items()]))
    long = rows.withColumn("population", F.explode(names))
    out = long.groupBy("population").agg(F.count("*").alias("n"), *[F.avg(F.expr(c).cast("double")).alias(n) for n, c in flags.items()])
    q = ranks.quantiles(long, ["population"], value, QUARTILES).drop("n")
    return out.join(q, "population", "left").select("population", "n", *flags, *QUARTILES)


def qc_summary(quality: DataFrame, channel: str, good: str, least: float) -> DataFrame:
    """channel, n, passed (good from ``least`` on), quartiles of good, over rows (recording, channel, good)."""
    out = quality.groupBy(channel).agg(F.count("*").alias("n"), F.count_if(F.col(good) >= least).alias("passed"))
    q = ranks.quantiles(quality, [channel], good, QUARTILES).drop("n").withColumnRenamed(channel, "_c")
    return out.join(q, F.col(channel).eqNullSafe(F.col("_c")), "left").select(channel, "n", "passed", *QUARTILES)


def criteria(rows: DataFrame, checks: dict[str, tuple[str, float]]) -> DataFrame:
    """criterion, share, least, passed: the share of rows that meet each check; unknown isn't met."""
    wide = rows.agg(*[F.avg(F.coalesce(F.expr(c), F.lit(False)).cast("double")).alias(n) for n, (c, _) in checks.items()])
    least = F.create_map(*[F.lit(x) for n, (_, t) in checks.items() for x in (n, float(t))])
    long = wide.unpivot([], list(checks), "criterion", "share").withColumn("least", least[F.col("criterion")])
    return long.withColumn("passed", F.coalesce(F.col("share") >= F.col("least"), F.lit(False)))


def role_summary(rows: DataFrame, role: str, positive: str, least: int, ratio: float) -> DataFrame:
    """role, positives, controls, enough: so many positives, and so many controls for each."""
    out = rows.groupBy(role).agg(F.count_if(F.expr(positive)).alias("positives"), F.count_if(~F.coalesce(F.expr(positive), F.lit(False))).alias("controls"))
    return out.withColumn("enough", (F.col("positives") >= least) & (F.col("controls") >= F.col("positives") * ratio))


def availability(flags: DataFrame, site: str, names: list[str], k: int = SMALL) -> DataFrame:
    """site (null: pooled), flag, n with the flag, total, share, why: low, high, total or linked, where a cell is hidden, and a bound.

    A cell is hidden if the flag's rows, the others or all are fewer than k, and a pooled one also if a site's is; a total is hidden
    below k, and the pooled total if a site's is.
    """
    long = flags.select(site, *[F.col(c).cast("int").alias(c) for c in names]).unpivot(site, names, "flag", "v")
    cells = long.filter("v IS NOT NULL").groupBy("flag", F.col(site).alias("site")).agg(F.sum("v").alias("n"), F.count("v").alias("total"))
    few = F.when(F.col("total") < k, "total").when(F.col("n") < k, "low").when(F.col("total") - F.col("n") < k, "high")
    cells = cells.withColumns({"why": few, "few_total": F.col("total") < k})
    pooled = cells.groupBy("flag").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bool_or(F.col("why").isNotNull()).alias("_hidden"), F.bool_or("few_total").alias("_few"))
    pooled = pooled.select("flag", F.lit(None).cast(flags.schema[site].dataType).alias("site"), "n", "total", F.coalesce(few, F.when(F.col("_hidden"), "linked")).alias("why"), ((F.col("total") < k) | F.col("_few")).alias("few_total"))
    shown, told = F.col("why").isNull(), ~F.col("few_total")
    high = F.when((F.col("why") == "high") & told, F.format_string(">=%.3f", (F.col("total") - (k - 1)) / F.col("total")))
    return cells.unionByName(pooled).select(
        "site", "flag", F.when(shown, F.col("n")).alias("n"), F.when(told, F.col("total")).alias("total"), F.when(shown & told, F.col("n") / F.col("total")).alias("share"), "why", high.alias("bound")
    )


def channel_names(rows: DataFrame, column: str, aliases: dict[str, str]) -> DataFrame:
    """Adds channel: letters and digits without the montage's prefix and reference, in upper case, older names as their newer ones."""
    bare = F.regexp_replace(F.upper(F.trim(column)), r"^EEG[ _-]*|[ _-]*(REF|LE|AR)$", "")
    bare = F.regexp_replace(bare, "[^A-Z0-9]", "")
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return rows.withColumn("channel", F.coalesce(names[bare], bare))


def live_channels(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows of channels that aren't constant. One aggregate for each channel meets the rows again."""
    dead = samples.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).filter(F.col("_lo").isNull() | (F.col("_lo") == F.col("_hi"))).select(*by)
    return samples.join(dead, by, "left_anti")


def burden(snippets: DataFrame, windows: DataFrame, at: float = 0.5) -> DataFrame:
    """rec_id, window: n, mean, 90th percentile and share of probabilities from ``at`` of the snippets that start within."""
    inside = (snippets["rec_id"] == windows["rec_id"]) & (snippets["t"] >= windows["lo"]) & (snippets["t"] < windows["hi"])
    j = snippets.join(windows, inside).select(windows["rec_id"], "window", "p")
    out = j.groupBy("rec_id", "window").agg(F.count("*").alias("n"), F.avg("p").alias("mean"), F.percentile("p", F.lit(0.9)).alias("p90"), F.avg((F.col("p") >= at).cast("double")).alias("burden"))
    return out


def valid_segments(rows: DataFrame, vector: str, low: float, high: float, least: float) -> DataFrame:
    """Rows whose components are within bounds for a share of at least ``least``, with that share and the mean of those."""
    ok = F.filter(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= low) & (x <= high))
    share = F.size(ok) / F.size(vector)
    mean = F.aggregate(ok, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(ok)
    return rows.withColumns({"valid": share, "pooled": mean}).filter(F.col("valid") >= least)

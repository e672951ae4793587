"""Disclosure control of aggregates: cells too small to show, and those from which a hidden one could be worked out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Counts below this are hidden.
SMALL = 11
ID_LIKE = re.compile(r"(^|_)(id|mrn|ssn|uuid|email|phone)$|(^|_)(person|patient|session)(_|$)", re.IGNORECASE)


def hidden_share(n: Column, total: Column, k: int = SMALL) -> Column:
    """Whether a count or its complement is too small; nothing and everything of a large total may be told as zero only."""
    return ((n > 0) & (n < k)) | ((total - n > 0) & (total - n < k))


def counts(rows: DataFrame, by: list[str], k: int = SMALL) -> DataFrame:
    """by, n (null if hidden), suppressed."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return out.select(*by, F.when(F.col("n") >= k, F.col("n")).alias("n"), (F.col("n") < k).alias("suppressed"))


def shares(cells: DataFrame, k: int = SMALL) -> DataFrame:
    """cells (.., n, total): share with the reason low, high or small total where it is hidden, and a bound for shares near one."""
    why = F.when(F.col("total") < k, "total").when(F.col("n") < k, "low").when(F.col("total") - F.col("n") < k, "high")
    return cells.withColumn("why", why).select(
        *[c for c in cells.columns if c not in ("n", "total")],
        F.when(F.col("why").isNull(), F.col("n") / F.col("total")).alias("share"),
        F.when(F.col("why") == "high", F.format_string(">=%.3f", (F.col("total") - k + 1) / F.col("total"))).alias("bound"),
        "why",
    )


def complementary(cells: DataFrame, group: list[str], order: str, k: int = SMALL) -> DataFrame:
    """cells (group, part, n): hides small parts, then, while one alone is hidden or the hidden sum is small, the next smallest.

    Parts in order of size: the hidden ones are a prefix, and the rule asks for the shortest prefix that has all small parts and,
    if it has any, at least two parts that sum to k. Running sums find it in one pass.
    """
    w = Window.partitionBy(*group).orderBy("n", order)
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    small = F.col("n") < k
    r = cells.withColumns(
        {
            "_any": F.max(small).over(Window.partitionBy(*group)),
            "_before": F.coalesce(F.sum("n").over(upto), F.lit(0)),
            "_parts": F.row_number().over(w) - 1,
        }
    )
    hide = small | (F.col("_any") & ((F.col("_parts") < 2) | (F.col("_before") < k)))
    return r.withColumn("suppressed", hide).withColumn("n", F.when(~F.col("suppressed"), F.col("n"))).drop("_any", "_before", "_parts")


def with_totals(cells: DataFrame, site: str, part: str, k: int = SMALL) -> DataFrame:
    """Site cells and pooled ones (null site); a pooled cell is hidden where exactly one of its sites' cells is."""
    shown = cells.withColumn("suppressed", F.col("n") < k)
    pooled = shown.groupBy(part).agg(F.sum("n").alias("n"), F.count(F.when(F.col("suppressed"), 1)).alias("h"))
    pooled = pooled.select(F.lit(None).cast(cells.schema[site].dataType).alias(site), part, "n", ((F.col("n") < k) | (F.col("h") == 1)).alias("suppressed"))
    return shown.select(site, part, "n", "suppressed").unionByName(pooled).withColumn("n", F.when(~F.col("suppressed"), F.col("n")))


def pooled_sites(sizes: DataFrame, site: str, k: int) -> DataFrame:
    """site, pool: while a group has fewer than k rows, the smallest joins the next smallest; a pool is named by its sites, joined by +.

    Of equal groups the one that began with the lowest site comes first. A site without rows is a group of its own. The fold runs over
    one array with an entry for each site, so that the table of sites, not of rows, has to fit a row.
    """
    name = F.col(site).cast("string")
    group = F.struct(F.col("n").cast("long").alias("n"), F.col(site).alias("first"), F.array(name).alias("sites"))
    groups = sizes.filter("n > 0").agg(F.sort_array(F.collect_list(group)).alias("g"))

    def merge(g: Column, _: Column) -> Column:
        a, b = F.get(g, F.lit(0)), F.get(g, F.lit(1))
        both = F.struct((a["n"] + b["n"]).alias("n"), b["first"].alias("first"), F.concat(b["sites"], a["sites"]).alias("sites"))
        return F.when((F.size(g) > 1) & (a["n"] < k), F.sort_array(F.concat(F.array(both), F.slice(g, 3, F.size(g))))).otherwise(g)

    groups = groups.select(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("g"))), F.col("g"), merge).alias("g"))
    pools = groups.select(F.explode("g").alias("g")).select(F.array_join(F.sort_array("g.sites"), "+").alias("pool"), F.explode("g.sites").alias("_s"))
    return sizes.join(pools, name.eqNullSafe(F.col("_s")), "left").select(site, F.coalesce("pool", name).alias("pool"))


def pseudonyms(rows: DataFrame, site: str) -> DataFrame:
    """Adds site_label, site_1 and up by sorted id."""
    names = rows.select(site).distinct()
    names = names.withColumn("site_label", F.concat(F.lit("site_"), F.dense_rank().over(Window.orderBy(site))))
    return rows.join(names, site)


def aggregate_only(report: DataFrame, known_ids: DataFrame | None = None) -> DataFrame:
    """The report itself, if no column looks like an id or a time and no text cell is a known id; else raises."""
    for f in report.schema.fields:
        if ID_LIKE.search(f.name):
            raise ValueError(f"column {f.name} looks like an identifier")
        if f.dataType.typeName().startswith(("timestamp", "date")):
            raise ValueError(f"column {f.name} holds times")
    if known_ids is not None:
        for f in report.schema.fields:
            ids = known_ids.select(known_ids.columns[0]).withColumnRenamed(known_ids.columns[0], "_id")
            if f.dataType.typeName() == "string" and not report.join(ids, F.col(f.name) == F.col("_id").cast("string"), "left_semi").isEmpty():
                raise ValueError(f"column {f.name} holds known identifiers")
    return report

"""Flows of exclusions that can be published: small steps merge, so that no count below k is shown or follows by subtraction.

A count is safe if it is zero or at least k. Steps wait until what they exclude together can be shown: safe for every member, at least
k for one, with safe remainders. What still waits where the unit changes, or at the end, joins the row before it, and rows join further
back while they aren't safe. If nothing before it excludes enough, the last row is hidden. Members of a report share their rows, so that
a total less the other members gives nothing away either. A flow is a few steps: it folds in one row of an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.operators.disclose import SMALL, pooled_sites

WITHHELD = "withheld"
ALL = "ALL"


def small(n: Column, k: int) -> Column:
    """Whether a count is above zero and below k."""
    return (n > 0) & (n < k)


def none_small(counts: Column, k: int) -> Column:
    return F.forall(counts, lambda n: ~small(n, k))


class Fold:
    """The fold over one flow's steps (name, unit, start, left: a count of each member)."""

    ROW = "struct<step:string,unit:string,gone:array<bigint>,left:array<bigint>>"

    def __init__(self, k: int):
        self.k = k

    def row(self, names: Column, unit: Column, gone: Column, left: Column) -> Column:
        return F.struct(F.array_join(names, " + ").alias("step"), unit.alias("unit"), gone.alias("gone"), left.alias("left"))

    def state(self, rows: Column, names: Column, gone: Column, left: Column, unit: Column) -> Column:
        return F.struct(rows.alias("rows"), names.alias("names"), gone.alias("gone"), left.alias("left"), unit.alias("unit"))

    def added(self, a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    def joined(self, rows: Column, row: Column) -> Column:
        """The last row and one more as one row."""
        last = F.element_at(rows, -1)
        both = self.row(F.array(last["step"], row["step"]), row["unit"], self.added(last["gone"], row["gone"]), row["left"])
        return F.concat(F.slice(rows, 1, F.size(rows) - 1), F.array(both))

    def settled(self, rows: Column) -> Column:
        """Rows join backwards while the last one excludes a small number of some member, but never into a start."""

        def step(r: Column, _: Column) -> Column:
            last = F.element_at(r, -1)
            open_to = (F.size(r) > 2) & F.try_element_at(r, F.lit(-2))["gone"].isNotNull()
            return F.when(open_to & ~none_small(last["gone"], self.k), self.joined(F.slice(r, 1, F.size(r) - 1), last)).otherwise(r)

        return F.aggregate(F.sequence(F.lit(1), F.size(rows)), rows, step)

    def step(self, s: Column, x: Column) -> Column:
        none, zeros = F.array().cast("array<string>"), F.transform(x["left"], lambda n: F.lit(0).cast("long"))
        waits = F.size(s["names"]) > 0
        closed = F.try_element_at(s["rows"], F.lit(-1))["gone"].isNotNull()
        back = self.settled(self.joined(s["rows"], self.row(s["names"], s["unit"], s["gone"], s["left"])))
        barrier = F.coalesce(waits & closed & (x["unit"] != s["unit"]) & none_small(F.element_at(back, -1)["gone"], self.k), F.lit(False))
        rows = F.when(barrier, back).otherwise(s["rows"])
        names = F.concat(F.when(barrier, none).otherwise(s["names"]), F.array(x["step"]))
        out = self.added(F.when(barrier, zeros).otherwise(F.coalesce(s["gone"], zeros)), F.zip_with(F.coalesce(s["left"], x["left"]), x["left"], lambda a, b: a - b))
        full = F.exists(out, lambda n: n >= self.k) & none_small(out, self.k) & none_small(x["left"], self.k)
        start = self.state(F.concat(self.end(s), F.array(self.row(F.array(x["step"]), x["unit"], F.lit(None).cast("array<bigint>"), x["left"]))), none, zeros, x["left"], x["unit"])
        shown = self.state(F.concat(rows, F.array(self.row(names, x["unit"], out, x["left"]))), none, zeros, x["left"], x["unit"])
        return F.when(x["start"] | s["left"].isNull(), start).when(full, shown).otherwise(self.state(rows, names, out, x["left"], x["unit"]))

    def end(self, s: Column) -> Column:
        rest = self.row(s["names"], s["unit"], s["gone"], s["left"])
        closed = F.try_element_at(s["rows"], F.lit(-1))["gone"].isNotNull()
        return F.when(F.size(s["names"]) == 0, s["rows"]).when(closed, self.settled(self.joined(s["rows"], rest))).otherwise(F.concat(s["rows"], F.array(rest)))

    def rows(self, steps: Column) -> Column:
        none = lambda kind: F.lit(None).cast(kind)
        start = self.state(F.array().cast(f"array<{self.ROW}>"), F.array().cast("array<string>"), none("array<bigint>"), none("array<bigint>"), none("string"))
        return F.aggregate(steps, start, self.step, self.end)


def folded(steps: DataFrame, by: list[str], member: str, k: int) -> DataFrame:
    """by, member, row, step, unit, n_excluded, n_remaining, small: exact counts, and whether a row must be hidden for the member."""
    names = steps.groupBy(*by).agg(F.sort_array(F.collect_set(member)).alias("_members"))
    each = steps.groupBy(*by, "stage", "step", "unit", "start").agg(F.map_from_entries(F.collect_list(F.struct(F.col(member), F.col("remaining").cast("long")))).alias("_n"))
    each = each.join(names, by) if by else each.crossJoin(names)  # names is one row
    left = F.transform("_members", lambda m: F.coalesce(F.col("_n")[m], F.lit(0).cast("long")))
    item = F.struct("stage", "step", "unit", F.coalesce("start", F.lit(False)).alias("start"), left.alias("left"))
    listed = each.groupBy(*by, "_members").agg(F.sort_array(F.collect_list(item)).alias("_x"))
    rows = listed.select(*by, "_members", F.posexplode(Fold(k).rows(F.col("_x"))).alias("row", "_r"))
    begun = F.get("_members", F.col("_i"))
    out = rows.select(*by, "_members", "row", "_r", F.explode(F.sequence(F.lit(0), F.size("_members") - 1)).alias("_i"))
    out = out.select(*by, begun.alias(member), "row", "_r.step", "_r.unit", F.get("_r.gone", F.col("_i")).alias("n_excluded"), F.get("_r.left", F.col("_i")).alias("n_remaining"))
    return out.withColumn("small", F.coalesce(small(F.col("n_excluded"), k), F.lit(False)) | small(F.col("n_remaining"), k))


def shown(rows: DataFrame, member: str, k: int) -> DataFrame:
    """member, row, step, unit, n_excluded, n_remaining: small rows hidden, and a member that starts below k told as withheld only."""
    first = rows.filter("row = 0").select(F.col(member).alias("_m"), (F.col("n_remaining") < k).alias("_low"))
    told = rows.join(first, F.col(member).eqNullSafe(F.col("_m"))).filter("NOT _low OR row = 0")
    count = lambda c: F.when(~F.col("_low") & ~F.col("small"), F.col(c)).alias(c)
    text = lambda c: F.when(~F.col("_low"), F.col(c))
    return told.select(member, "row", F.coalesce(text("step"), F.lit(WITHHELD)).alias("step"), text("unit").alias("unit"), count("n_excluded"), count("n_remaining"))


def merged_flow(steps: DataFrame, site: str, k: int = SMALL) -> DataFrame:
    """steps (site, stage, step, unit, remaining, start) -> site, row, step, unit, n_excluded, n_remaining, each site for itself.

    Hidden counts are null. To be published beside each other's totals, sites go through ``flow_report``.
    """
    own = steps.withColumn("_by", F.col(site))
    return shown(folded(own, ["_by"], site, k), site, k)


def flow_report(steps: DataFrame, site: str, k: int = SMALL) -> DataFrame:
    """group, row, step, unit, n_excluded, n_remaining of pooled groups of sites and of all sites.

    Sites that end with less than k rows are pooled. A row of all sites is hidden where exactly one group's is, or where the hidden
    ones are small together; a group that starts below k is withheld, and so is the total then.
    """
    last = steps.groupBy(site).agg(F.max_by("remaining", "stage").alias("n"))
    pools = pooled_sites(last, site, k).select(F.col(site).alias("_s"), F.col("pool").alias("group"))
    pooled = steps.join(pools, F.col(site).eqNullSafe(F.col("_s"))).groupBy("group", "stage", "step", "unit", "start").agg(F.sum("remaining").alias("remaining"))
    rows = folded(pooled, [], "group", k)
    low = rows.filter("row = 0").select(F.col("group").alias("_g"), (F.col("n_remaining") < k).alias("_low"))
    marked = rows.join(low, rows["group"].eqNullSafe(low["_g"])).withColumn("hidden", F.col("small") | F.col("_low"))
    of_hidden = lambda c: F.coalesce(F.sum(F.when(F.col("hidden"), F.col(c))), F.lit(0))
    total = marked.groupBy("row", "step", "unit").agg(
        F.sum("n_excluded").alias("n_excluded"),
        F.sum("n_remaining").alias("n_remaining"),
        (F.count_if("hidden") == 1).alias("_one"),
        (small(of_hidden("n_excluded"), k) | small(of_hidden("n_remaining"), k)).alias("_few"),
    )
    safe = F.coalesce(small(F.col("n_excluded"), k), F.lit(False)) | small(F.col("n_remaining"), k) | F.col("_one") | F.col("_few")
    total = total.select(F.lit(ALL).alias("group"), "row", "step", "unit", "n_excluded", "n_remaining", safe.alias("small"))
    return shown(rows.unionByName(total), "group", k)

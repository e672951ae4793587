"""Ranks, running sums and quantiles of groups that don't fit a task.

Rows are dealt by range of group and order, so that a large group spreads over many partitions, and written; each partition's counts
and sums, a row for each group in it, give the offsets that partitions add to what they number by themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.sources.shared import written


def ranked(rows: DataFrame, by: list[str], order: list[str | Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """Adds _rank, from 1 by the order within the group, _size of the group, and _sum_<column> up to each row and _total_<column> of the
    group. The order should be total."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, *map(F.col, by), *order).withColumn("_part", F.spark_partition_id()), "ranked")
    each = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    group = Window.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_part").alias("_at"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("_size"),
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums],
        *[F.sum(f"_s_{c}").over(group).alias(f"_total_{c}") for c in sums],
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_part") == F.col("_at"))
    own = Window.partitionBy(*by, "_part").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    numbered = dealt.withColumns({"_own": F.row_number().over(own)} | {f"_o_{c}": F.sum(c).over(upto) for c in sums})
    out = numbered.join(offsets, same).withColumns({"_rank": F.col("_own") + F.col("_before")} | {f"_sum_{c}": F.col(f"_o_{c}") + F.col(f"_b_{c}") for c in sums})
    return out.select(*rows.columns, "_rank", "_size", *[f"_sum_{c}" for c in sums], *[f"_total_{c}" for c in sums])


def tied(rows: DataFrame, by: list[str], value: str, count: Column | None = None, **extra: Column) -> DataFrame:
    """by, value, n, rank (average, from 1), total rows of the group, and extra aggregates of each known value: equal values are counted
    before they are ranked, so that a common one is one row."""
    each = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg((F.count("*") if count is None else count).alias("n"), *[c.alias(k) for k, c in extra.items()])
    r = ranked(each, by, [value], ("n",))
    return r.select(*by, value, "n", (F.col("_sum_n") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"), F.col("_total_n").alias("total"), *extra)


def ntile(k: int) -> Column:
    """Of ranked rows: the first groups have one row more where k doesn't divide their number."""
    base, more = F.floor(F.col("_size") / k), F.col("_size") % k
    place = F.col("_rank") - 1
    wide = more * (base + 1)
    return (F.when(place < wide, F.floor(place / (base + 1))).otherwise(more + F.floor((place - wide) / F.greatest(base, F.lit(1)))) + 1).cast("int")


def quantiles(rows: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """by, n, and linear quantiles of known values: each is taken from the one or two values that have its ranks."""
    r = ranked(rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")), by, [value], ("n",))
    has = lambda rank: (F.col("_sum_n") - F.col("n") < rank) & (rank <= F.col("_sum_n"))
    out = {}
    for name, q in qs.items():
        place = F.lit(q) * (F.col("_total_n") - 1)
        low = F.max(F.when(has(F.floor(place) + 1), F.col(value)))
        high = F.max(F.when(has(F.ceil(place) + 1), F.col(value)))
        share = F.max(place - F.floor(place))
        out[name] = low + (high - low) * share
    return r.groupBy(*by).agg(F.sum("n").alias("n"), *[c.alias(n) for n, c in out.items()])

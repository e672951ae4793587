"""Intervals of an entity: repair, cover, chaining, and the backward as-of join. Each rides on the entity's equality key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.expressions import hours_between, plus_microseconds
from tidegate.sources.shared import written


def compacted(raw: DataFrame, open_when: str, open_days: int) -> DataFrame:
    """entity_id, interval_id, t_start, t_end, open, class_rank: an end before its start is the start; open ends reach some days on."""
    repaired = F.greatest("t_end", "t_start")
    return raw.filter(F.col("t_start").isNotNull()).select(
        "entity_id",
        "interval_id",
        "t_start",
        F.when(F.expr(open_when) | F.col("t_end").isNull(), F.timestamp_add("DAY", F.lit(open_days), F.col("t_start"))).otherwise(repaired).alias("t_end"),
        (F.expr(open_when) | F.col("t_end").isNull()).alias("open"),
        "class_rank",
    )


def backward_as_of(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """For each point (entity_id, point_id, t), the interval that started last at or before it, if it hasn't ended by then.

    Points and starts of an entity are put in one order of time, and each point takes the last start before it: no pairs are made.
    """
    no = F.lit(None)
    started = F.struct("t_start", "interval_id", "t_end")
    starts = intervals.select("entity_id", F.col("t_start").alias("_t"), F.lit(0).alias("_kind"), F.col("interval_id").alias("_id"), started.alias("_m"), no.cast(points.schema["point_id"].dataType).alias("point_id"))
    wanted = points.select("entity_id", F.col("t").alias("_t"), F.lit(1).alias("_kind"), no.cast(intervals.schema["interval_id"].dataType).alias("_id"), no.cast(starts.schema["_m"].dataType).alias("_m"), "point_id")
    order = Window.partitionBy("entity_id").orderBy("_t", "_kind", "_id").rowsBetween(Window.unboundedPreceding, 0)
    last = starts.filter("_t IS NOT NULL").unionByName(wanted).withColumn("_last", F.last("_m", ignorenulls=True).over(order)).filter("_kind = 1")
    open_still = F.col("entity_id").isNotNull() & F.coalesce(F.col("_last.t_end") >= F.col("_t"), F.lit(False))
    return last.select("point_id", F.when(open_still, F.col("_last.interval_id")).alias("interval_id"))


#: Points and intervals of an entity that meet each with each; entities with more that are broadcast at most.
MANY, FEW = 128, 100_000
#: Hours of the smallest cell of time, cells of a block of the next size, and the largest size; a longer stretch has several of these.
CELL_H, RADIX, LEVELS = 96.0, 4, 4


def cell(t: Column, hours: float = CELL_H) -> Column:
    """The number of the cell that a time falls in."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t) / F.lit(hours * 3.6e9))


def stabbed(points: DataFrame, intervals: DataFrame, low: Column, high: Column) -> DataFrame:
    """points (entity_id, t, ..) beside the intervals of their entity from whose cell of low to that of high their own cell lies; of an
    entity with at most MANY of both, beside all of its intervals: what is asked of a pair must be asked of it again.

    Both are read twice, as entities are counted first. Of one with more, a stretch of cells is cut into blocks of powers of RADIX, a few of each size, and a point asks for its block of each size: both meet
    by equality of entity and block, each pair once, and an entity's rows spread over its time. ``low`` and ``high`` are of intervals.
    """
    known = intervals.withColumns({"_lo": cell(low), "_hi": cell(high)}).filter("_lo <= _hi")
    each = points.select("entity_id").unionAll(known.select("entity_id")).groupBy(F.col("entity_id").alias("_many")).agg(F.count("*").alias("_n"))
    crowded = written(each.filter((F.col("_n") > MANY) & F.col("_many").isNotNull()).select("_many"), "crowded")
    n = crowded.count()
    renamed = [F.col(c).alias("_e" if c == "entity_id" else c) for c in intervals.columns]
    if n == 0:
        return points.join(known.select(*renamed), F.col("entity_id") == F.col("_e")).drop("_e")
    if n <= FEW:
        crowded = F.broadcast(crowded)
    known = known.join(crowded, known["entity_id"] == F.col("_many"), "left")
    of_all = lambda k, c, blocks: F.when(F.col("_many").isNotNull(), blocks).otherwise(F.array(F.struct(F.lit(-1).alias(k), F.lit(0).cast("long").alias(c))))
    none = F.array().cast("array<bigint>")
    run = lambda x, y: F.when(x <= y, F.sequence(x.cast("long"), y.cast("long"))).otherwise(none)
    of_size = lambda k, cells: F.transform(cells, lambda c: F.struct(F.lit(k).alias("_k"), c.alias("_c")))
    first = [F.ceil(F.col("_lo") / RADIX**k).cast("long") for k in range(LEVELS + 1)]
    last = [(F.floor((F.col("_hi") + 1) / RADIX**k) - 1).cast("long") for k in range(LEVELS + 1)]
    blocks = []
    for k in range(LEVELS + 1):
        whole = run(first[k], last[k])
        if k < LEVELS:  # what the next size doesn't take
            ends = F.concat(run(first[k], first[k + 1] * RADIX - 1), run((last[k + 1] + 1) * RADIX, last[k]))
            whole = F.when(first[k + 1] > last[k + 1], whole).otherwise(ends)
        blocks.append(of_size(k, whole))
    parts = known.select(*renamed, F.inline(of_all("_k", "_c", F.concat(*blocks))))
    asked = F.array(*[F.struct(F.lit(k).alias("_pk"), F.floor(cell(F.col("t")) / RADIX**k).alias("_pc")) for k in range(LEVELS + 1)])
    own = points.join(crowded, points["entity_id"] == F.col("_many"), "left").select(*[points[c] for c in points.columns], F.inline(of_all("_pk", "_pc", asked)))
    met = own.join(parts, (F.col("entity_id") == F.col("_e")) & (F.col("_pk") == F.col("_k")) & (F.col("_pc") == F.col("_c")))
    return met.drop("_e", "_k", "_c", "_pk", "_pc")


def covering(points: DataFrame, intervals: DataFrame, slack_h: float, long_h: float = 24.0) -> DataFrame:
    """For each point the best interval that covers it within some slack: exact cover, then length, start not after, class, latest start."""
    slack = F.lit(slack_h)
    micros = F.lit(round(slack_h * 3.6e9)).cast("long")
    kept = written(intervals.select("entity_id", "interval_id", "t_start", "t_end", "class_rank"), "intervals")
    j = stabbed(points.select("entity_id", "point_id", "t"), kept, plus_microseconds("t_start", -micros), plus_microseconds("t_end", micros))
    j = j.filter((hours_between("t", "t_start") <= slack) & (hours_between("t_end", "t") <= slack))
    exact = (F.col("t_start") <= F.col("t")) & (F.col("t_end") >= F.col("t"))
    long = hours_between("t_start", "t_end") >= long_h
    late = -F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("t_start"))
    key = F.struct((~exact).alias("a"), (~long).alias("b"), (F.col("t_start") > F.col("t")).alias("c"), F.col("class_rank").alias("d"), late.alias("e"), F.col("interval_id").alias("f"))
    row = F.struct("interval_id", "t_start", F.when(exact, "exact").otherwise("slack").alias("cover"))
    # the best row is an aggregate: it combines before the shuffle
    best = j.groupBy("point_id").agg(F.min_by(row, key).alias("_b")).select(F.col("point_id").alias("_p"), "_b.*")
    return points.select("point_id").join(best, F.col("point_id") == F.col("_p"), "left").drop("_p")


def chained_start(matches: DataFrame, intervals: DataFrame, gap_h: float, acute: str = "true") -> DataFrame:
    """One hop back: the earliest start of an acute interval with a known end that overlaps the match or ends shortly before it, at most t.

    acute is a condition on an interval: its class or its length.
    """
    prior = written(intervals.filter("NOT open").filter(acute).select("entity_id", F.col("t_start").alias("p_start"), F.col("t_end").alias("p_end")), "prior")
    matches = written(matches.select("entity_id", "point_id", "t", "t_start"), "matches")
    from_start = matches.filter("t_start IS NOT NULL").select("entity_id", "point_id", F.col("t_start").alias("t"))
    near = stabbed(from_start, prior, F.col("p_start"), plus_microseconds("p_end", F.lit(round(gap_h * 3.6e9)).cast("long")))
    hop = near.filter((F.col("p_start") <= F.col("t")) & (hours_between("p_end", "t") <= gap_h)).groupBy("point_id").agg(F.min("p_start").alias("earlier"))
    return matches.join(hop, "point_id", "left").select("point_id", F.least(F.coalesce("earlier", "t_start"), "t").alias("start"))


def chain_back(start: DataFrame, parents: DataFrame, hops: int) -> DataFrame:
    """start (id, t) and parents (id, parent, t): the earliest time along at most some hops of parent links."""
    reached = start.select("id", F.col("id").alias("at"), F.col("t").alias("first"))
    links = parents.select(F.col("id").alias("at"), "parent", F.col("t").alias("here"))
    for _ in range(hops):
        reached = reached.join(links, "at", "left").select("id", F.coalesce("parent", "at").alias("at"), F.least("first", "here").alias("first"))
    return reached.join(links, "at", "left").select("id", F.least("first", "here").alias("first"))


def overlaps(rows: DataFrame, lo: float, hi: float) -> DataFrame:
    """Intervals given in hours that start in a closed window or still run at its start."""
    end = F.coalesce(F.greatest("end_h", "start_h"), "start_h")
    return rows.filter((F.col("start_h") <= hi) & (end >= lo))

"""The gate: what was available at an entity's index time, and nothing else.

Events are long rows (entity_id, domain, key, value, quantity, t_event, t_avail, t_end_raw). Availability decides, not the event's
own time: a row passes iff t_avail and t0 are known and t_avail <= t0. An interval that still runs at t0 shows neither its end nor
its quantity. The gated frame has other columns than the raw one, so that raw rows can't be taken for gated ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.expressions import hours_between


def build_index(events: DataFrame, qualifies: str, order: tuple[str, ...] = ("t_event", "event_id")) -> DataFrame:
    """The whole first qualifying row of each entity, its time as t0."""
    first = Window.partitionBy("entity_id").orderBy(*order)
    rows = events.filter(qualifies).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return rows.withColumn("t0", F.col("t_event"))


def as_of(events: DataFrame, index: DataFrame) -> DataFrame:
    """Gated events with t0, censored ends and hours before t0."""
    ix = index.select("entity_id", "t0")
    kept = events.join(ix, "entity_id").filter(F.col("t_avail") <= F.col("t0"))
    ongoing = F.coalesce(F.col("t_end_raw") > F.col("t0"), F.lit(False))
    return (
        kept.withColumn("ongoing", ongoing)
        .withColumn("t_end", F.when(~F.col("ongoing"), F.col("t_end_raw")))
        .withColumn("quantity", F.when(~F.col("ongoing"), F.col("quantity")))
        .withColumn("hours_since_event", hours_between("t_event", "t0"))
        .withColumn("hours_since_avail", hours_between("t_avail", "t0"))
        .drop("t_end_raw")
    )


def violations(gated: DataFrame) -> DataFrame:
    """One row of counts that are all 0 in a gated frame; raises for a frame that can't be a gated one."""
    checked(gated)
    bad = {
        "late": F.col("t_avail") > F.col("t0"),
        "unknown": F.col("t_avail").isNull() | F.col("t0").isNull(),
        "open_end": F.col("ongoing") & (F.col("t_end").isNotNull() | F.col("quantity").isNotNull()),
        "end_after": F.col("t_end") > F.col("t0"),
    }
    return gated.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in bad.items()], F.count("*").alias("rows"))


def as_of_presentation(events: DataFrame, index: DataFrame, domains: list[str], after_h: float) -> DataFrame:
    """The bounded exception: some domains up to a few hours after t0; hours stay relative to t0 itself.

    The frame tells until when it reaches and has names of its own for the hours: it can't be taken for a gated one.
    """
    late = index.select("entity_id", F.col("t0").alias("true_t0"), F.timestamp_add("SECOND", F.lit(int(after_h * 3600)), F.col("t0")).alias("t0"))
    shown = as_of(events.filter(F.col("domain").isin(domains)), late).join(late.select("entity_id", "true_t0"), "entity_id")
    hours = {f"hours_before_t0_{k}": hours_between(t, "true_t0") for k, t in (("event", "t_event"), ("avail", "t_avail"))}
    shown = shown.withColumns(hours).drop("hours_since_event", "hours_since_avail")
    return shown.withColumnRenamed("t0", "shown_until").withColumnRenamed("true_t0", "t0")


def checked(frame: DataFrame) -> DataFrame:
    """The frame itself if it has passed the gate; raises for raw events and for presentation frames."""
    if "t_end_raw" in frame.columns or not {"t0", "ongoing", "t_end", "hours_since_event"} <= set(frame.columns):
        raise ValueError("these events haven't passed the gate")
    if "shown_until" in frame.columns:
        raise ValueError("a presentation frame reaches beyond t0")
    return frame


def encounter_start(index: DataFrame, intervals: DataFrame, fallback_days: int) -> DataFrame:
    """entity_id, t0, start, basis: the earliest start of an interval that covers t0, else t0 less some days; never after t0."""
    cover = (
        index.select("entity_id", "t0")
        .join(intervals.select("entity_id", "t_start", "t_end"), "entity_id")
        .filter((F.col("t_start") <= F.col("t0")) & (F.coalesce(F.col("t_end"), F.col("t0")) >= F.col("t0")))
        .groupBy("entity_id")
        .agg(F.min("t_start").alias("covered"))
    )
    fallback = F.timestamp_add("DAY", F.lit(-fallback_days), F.col("t0"))
    return index.select("entity_id", "t0").join(cover, "entity_id", "left").select(
        "entity_id",
        "t0",
        F.least(F.coalesce("covered", fallback), "t0").alias("start"),
        F.when(F.col("covered").isNotNull(), "covering").otherwise("fallback").alias("basis"),
    )


def current_encounter(gated: DataFrame, starts: DataFrame, exempt: list[str]) -> DataFrame:
    """Events since the encounter's start; exempt domains pass whatever their age."""
    s = starts.select("entity_id", F.col("start").alias("_start"))
    return gated.join(s, "entity_id").filter((F.col("t_event") >= F.col("_start")) | F.col("domain").isin(exempt)).drop("_start")


def onset(starts: DataFrame, scores: DataFrame, abnormal: str) -> DataFrame:
    """entity_id, onset, basis: the first abnormal score from the encounter's start to t0, else that start."""
    seen = (
        starts.join(scores.select("entity_id", "t_event", "value", "domain"), "entity_id")
        .filter((F.col("t_event") >= F.col("start")) & (F.col("t_event") <= F.col("t0")) & F.expr(abnormal))
        .groupBy("entity_id")
        .agg(F.min("t_event").alias("first"))
    )
    return starts.join(seen, "entity_id", "left").select(
        "entity_id", F.coalesce("first", "start").alias("onset"), F.when(F.col("first").isNotNull(), "score").otherwise("start").alias("basis")
    )


def pruned(events: DataFrame, index: DataFrame) -> DataFrame:
    """Rows that can matter to the gate and its latest values: raw rows available by t0. The gate over these equals that over all."""
    return events.join(index.select("entity_id", "t0"), "entity_id").filter(F.col("t_avail") <= F.col("t0")).drop("t0")

"""Nearest rows in time, per source and in asymmetric windows; whether anything lies in a window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.expressions import hours_between


def nearest_gaps(index: DataFrame, events: DataFrame) -> DataFrame:
    """entity_id, source, gap_h (signed, event after t0 positive; ties go to the earlier event) and n."""
    j = index.select("entity_id", "t0").join(events.select("entity_id", F.col("domain").alias("source"), "t_event"), "entity_id")
    j = j.withColumn("gap", hours_between("t0", "t_event"))
    return j.groupBy("entity_id", "source").agg(F.min_by("gap", F.struct(F.abs("gap").alias("a"), F.col("gap").alias("g"))).alias("gap_h"), F.count("*").alias("n"))


def nearest_value(index: DataFrame, scores: DataFrame, before_h: float, after_h: float) -> DataFrame:
    """entity_id, value, low, n over scores in the closed window; ties prefer the row before t0, then time, then value."""
    j = index.select("entity_id", "t0").join(scores.select("entity_id", "t_event", "value"), "entity_id")
    j = j.withColumn("h", hours_between("t0", "t_event")).filter(F.col("h").between(-before_h, after_h) & F.col("value").isNotNull())
    key = F.struct(F.abs("h").alias("a"), (F.col("h") > 0).alias("b"), "t_event", "value")
    return j.groupBy("entity_id").agg(F.min_by("value", key).alias("value"), F.min("value").alias("low"), F.count("*").alias("n"))


def exposed(points: DataFrame, exposures: DataFrame, lookback_h: float) -> DataFrame:
    """points (entity_id, point_id, t) with exposed: any exposure from some hours before until t."""
    x = exposures.select(F.col("entity_id").alias("e"), F.col("t_event").alias("x"))
    hit = points.join(x, (F.col("entity_id") == F.col("e")) & (F.col("x") <= F.col("t")) & (hours_between("x", "t") <= lookback_h), "left_semi")
    return points.join(hit.select("point_id", F.lit(True).alias("hit")), "point_id", "left").withColumn("exposed", F.coalesce("hit", F.lit(False))).drop("hit")

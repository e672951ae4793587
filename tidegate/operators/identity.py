"""Ids that were merged, composite keys and checks of rows against an independent source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.sources.shared import Scratch


def resolved(history: DataFrame, max_hops: int = 20) -> DataFrame:
    """old, survivor from history (old, new, mod): the latest record of each retired id, followed until an id that isn't retired.

    A record without a time loses to one with a time; of equal times the larger new id holds. From its new id an old one is followed
    max_hops records at most, and no further than the last id before one that was already passed: in a cycle an id ends at the one
    before itself, and a chain into a cycle at the one before it came in. Paths double with each join, and each doubling is written,
    so that the plan doesn't grow; ids whose path has ended no longer take part.
    """
    keep = Scratch(history.sparkSession)
    latest = history.groupBy("old").agg(F.max_by("new", F.struct("mod", "new")).alias("new")).filter("new IS NOT NULL")
    paths = keep(latest.select("old", F.array("new").alias("path")), "paths")
    ended = None
    length = 1
    while length <= max_hops:
        onward = paths.select(F.col("old").alias("at"), F.col("path").alias("next"))
        longer = paths.join(onward, F.element_at("path", -1) == F.col("at"), "left")
        # an id that ended earlier isn't among the paths: it may still be somebody's next
        if ended is not None:
            rest = ended.select(F.col("old").alias("ea"), F.col("path").alias("en"))
            longer = longer.join(rest, F.element_at("path", -1) == F.col("ea"), "left").withColumn("next", F.coalesce("next", "en"))
        longer = longer.select("old", F.concat("path", F.coalesce("next", F.array().cast(paths.schema["path"].dataType))).alias("path"), F.col("next").isNull().alias("end"))
        step = keep(longer, "paths")
        done = step.filter("end").select("old", "path")
        ended = done if ended is None else ended.unionByName(done)
        paths = step.filter("NOT end").select("old", "path")
        length *= 2
        if paths.isEmpty():
            break
    whole = paths if ended is None else paths.unionByName(ended)
    seen = lambda i: F.concat(F.array("old"), F.slice("path", 1, i - 1))  # noqa: E731  before the i-th id of the path, counted from 1
    steps = F.sequence(F.lit(1), F.lit(max_hops))
    stops = F.filter(steps, lambda i: F.coalesce(F.array_contains(seen(i), F.get("path", i)), F.lit(True)))
    last = F.coalesce(F.get(stops, F.lit(0)), F.lit(max_hops + 1))
    return whole.select("old", F.element_at("path", last.cast("int")).alias("survivor"))


def rekeyed(rows: DataFrame, survivors: DataFrame, column: str) -> DataFrame:
    s = survivors.select(F.col("old").alias(column), "survivor")
    return rows.join(s, column, "left").withColumn(column, F.coalesce("survivor", column)).drop("survivor")


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def verified(rows: DataFrame, source: DataFrame, key: list[str], value: str) -> DataFrame:
    """Each row of rows with status ok, conflict or missing, as an independent source (key, value) has it."""
    s = source.select(*key, F.col(value).alias("_v"))
    found = rows.join(s, key, "left").groupBy(*key, value).agg(F.max(F.when(F.col("_v").isNotNull(), F.col("_v") == F.col(value))).alias("same"))
    return found.withColumn("status", F.when(F.col("same").isNull(), "missing").when(F.col("same"), "ok").otherwise("conflict")).drop("same")

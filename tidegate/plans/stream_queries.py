"""Registered streams: events arrive in two parts, each taken by a run of its own that goes on from the last one's checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.plans.tables import GATED, INDEX, events, index
from tidegate.sources.shared import fresh_path
from tidegate.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def in_two_runs(spark: SparkSession, rows: DataFrame, run: Callable[[DataFrame, str, str], None], stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What two runs leave at the target: the late half of the rows arrives as new files between them."""
    source, target, checkpoint = (fresh_path(spark, f"stream-{x}") for x in ("source", "target", "checkpoint"))
    for late in (False, True):
        rows.filter((F.pmod(F.xxhash64("event_id"), F.lit(2)) == 1) == late).write.mode("append").parquet(source)
        run(stream(incremental.new_files(spark, source, rows.schema)), target, checkpoint)
    return spark.read.parquet(target)


@query("ss01_each_file_once", "WITH " + INDEX + " SELECT domain, count(*) AS n, count(DISTINCT event_id) AS n_distinct FROM ev GROUP BY 1")
def each_file_once(spark: SparkSession, d: str) -> DataFrame:
    got = in_two_runs(spark, events(spark, d), incremental.run_once, lambda s: s.select("event_id", "domain"))
    return got.groupBy("domain").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_distinct"))


@query("ss02_nearest_state", "WITH " + INDEX + ", j AS (SELECT entity_id, domain AS source, date_diff('microsecond', t0, t_event) / 3.6e9 AS gap FROM ev JOIN ix USING (entity_id)) SELECT entity_id, source, round(first(gap ORDER BY abs(gap), gap), 6) AS gap_h FROM j WHERE gap IS NOT NULL GROUP BY 1, 2".replace("JOIN ix USING", "JOIN (SELECT entity_id, t0 FROM ix) USING"))
def nearest_state(spark: SparkSession, d: str) -> DataFrame:
    ix = index(spark, d)
    got = in_two_runs(spark, events(spark, d), incremental.kept, lambda s: incremental.nearest(s, ix))
    return got.select("entity_id", "source", F.round("gap_h", 6).alias("gap_h"))


@query("ss03_late_arrivals", "WITH " + GATED + " SELECT event_id, entity_id, domain, round(hours_since_avail, 6) AS hours_since_avail FROM g")
def late_arrivals(spark: SparkSession, d: str) -> DataFrame:
    ix = index(spark, d)
    got = in_two_runs(spark, events(spark, d), incremental.run_once, lambda s: incremental.gated(s, ix).select("event_id", "entity_id", "domain", "hours_since_avail"))
    return got.withColumn("hours_since_avail", F.round("hours_since_avail", 6))

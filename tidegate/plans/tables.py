"""How the given tables stand for entities, events, intervals, labels and ratings, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.expressions import plus_microseconds
from tidegate.operators.gate import build_index

#: Minutes from an event to its availability, by type.
LAGS = {"click": 60, "error": 120, "purchase": 30, "signup": 180, "view": 0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long events: a type is a domain, k modulo 5 the key, the value also the quantity and the length in minutes."""
    lag = F.lit(0)
    for kind, minutes in LAGS.items():
        lag = F.when(F.col("event_type") == kind, minutes).otherwise(lag)
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("user_id").alias("entity_id"),
        F.pmod("user_id", F.lit(3)).cast("int").alias("site"),
        F.col("event_type").alias("domain"),
        F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 5).cast("string")).alias("key"),
        "value",
        F.col("value").alias("quantity"),
        F.col("ts").alias("t_event"),
        F.timestamp_add("MINUTE", lag, F.col("ts")).alias("t_avail"),
        plus_microseconds("ts", F.round(F.col("value") * 60_000_000)).alias("t_end_raw"),
    )


EVENTS = """ev AS (
  SELECT event_id, user_id AS entity_id, (user_id % 3)::int AS site, event_type AS domain, 'k' || (json_extract_string(props, '$.k')::int % 5) AS key, value,
    value AS quantity, ts AS t_event,
    ts + to_minutes(CASE event_type WHEN 'click' THEN 60 WHEN 'error' THEN 120 WHEN 'purchase' THEN 30 WHEN 'signup' THEN 180 ELSE 0 END) AS t_avail,
    ts + to_microseconds(round(value * 60000000)::bigint) AS t_end_raw FROM events
)"""


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_index(events(spark, sf_dir), "domain = 'purchase'").select("entity_id", "site", "event_id", "t0")


INDEX = EVENTS + """, ix AS (
  SELECT entity_id, site, event_id, t_event AS t0 FROM ev WHERE domain = 'purchase' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY t_event, event_id) = 1
)"""
GATED = INDEX + """, g AS (
  SELECT * EXCLUDE (t_end_raw, quantity), CASE WHEN ongoing THEN NULL ELSE t_end_raw END AS t_end, CASE WHEN ongoing THEN NULL ELSE quantity END AS quantity FROM (
    SELECT ev.*, t0, coalesce(t_end_raw > t0, false) AS ongoing, date_diff('microsecond', t_event, t0) / 3.6e9 AS hours_since_event,
      date_diff('microsecond', t_avail, t0) / 3.6e9 AS hours_since_avail FROM ev JOIN (SELECT entity_id, t0 FROM ix) USING (entity_id) WHERE t_avail <= t0)
)"""


def raw_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order runs from its date to the last shipment; status O leaves it open; the priority's digit ranks its class."""
    ends = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("t_end"))
    o = table(spark, sf_dir, "orders")
    return o.join(ends, o["o_orderkey"] == ends["l_orderkey"], "left").select(
        F.col("o_custkey").alias("entity_id"),
        F.col("o_orderkey").alias("interval_id"),
        F.col("o_orderdate").alias("t_start"),
        "t_end",
        F.substring("o_orderpriority", 1, 1).cast("int").alias("class_rank"),
        F.col("o_orderstatus").alias("status"),
    )


RAW_INTERVALS = """ri AS (
  SELECT o_custkey AS entity_id, o_orderkey AS interval_id, o_orderdate AS t_start, e.t_end, substr(o_orderpriority, 1, 1)::int AS class_rank, o_orderstatus AS status
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS t_end FROM lineitem GROUP BY 1) e ON l_orderkey = o_orderkey
)"""
INTERVALS = RAW_INTERVALS + """, iv AS (
  SELECT entity_id, interval_id, t_start, CASE WHEN status = 'O' OR t_end IS NULL THEN t_start + to_days(30) ELSE greatest(t_end, t_start) END AS t_end,
    (status = 'O' OR t_end IS NULL) AS open, class_rank FROM ri WHERE t_start IS NOT NULL
)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's date and a half day, as a time to be covered by the customer's orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("point_id"), F.timestamp_add("HOUR", F.lit(12), F.col("o_orderdate")).alias("t"))


POINTS = "pt AS (SELECT o_custkey AS entity_id, o_orderkey AS point_id, o_orderdate + to_hours(12) AS t FROM orders)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, site, label, y, p_a, p_b: labels of documents, and two scores made from the texts' lengths and ids."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.join(y, "doc_id", "left").select(F.col("doc_id").alias("entity"), F.col("lang").alias("site"), "n_chars", F.expr("stack(2, 'quality', quality, 'toxic', toxic) AS (label, y)"))
    return rows.select(
        "entity",
        "site",
        "label",
        F.col("y").cast("int").alias("y"),
        (1 / (1 + F.exp(-(F.col("n_chars") - 2000) / 4000))).alias("p_a"),
        (0.05 + 0.9 * F.pmod(F.col("n_chars") + 7 * F.col("entity"), F.lit(101)) / 101).alias("p_b"),
    )


PREDICTIONS = """pr AS (
  SELECT doc_id AS entity, lang AS site, label, y, 1 / (1 + exp(-(n_chars - 2000) / 4000)) AS p_a, 0.05::double + 0.9::double * ((n_chars + 7 * doc_id) % 101) / 101 AS p_b
  FROM (SELECT d.*, 'quality' AS label, quality::int AS y FROM documents d LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT d.*, 'toxic', toxic::int FROM documents d LEFT JOIN labels USING (doc_id))
)"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, a, b, w: the quality label, and a second rater who turns every seventh."""
    y = table(spark, sf_dir, "labels")
    flip = F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    return y.select(F.col("doc_id").alias("case_id"), F.col("quality").cast("int").alias("a"), flip.cast("int").alias("b"), (1.0 + F.col("doc_id") % 3).alias("w"))


RATINGS = "rt AS (SELECT doc_id AS case_id, quality::int AS a, (CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END)::int AS b, (1 + doc_id % 3)::double AS w FROM labels)"

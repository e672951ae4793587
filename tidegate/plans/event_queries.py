"""Registered queries on gates, intervals, nearest rows, lexicons, features, windows and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.functions.expressions import hours_between, normal_code, normal_name
from tidegate.operators import features, gate, identity, intervals, lexicon, nearest, rules, runs
from tidegate.plans.tables import EVENTS, GATED, INDEX, INTERVALS, POINTS, events, index, points, raw_intervals, table
from tidegate.sources.shared import written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


FEATURES = [
    features.Feature("purchase_latest", "latest", "click"),
    features.Feature("click_age_h", "age", "click"),
    features.Feature("view_k0_latest", "latest", "view", "k0"),
    features.Feature("error_first", "first", "error"),
    features.Feature("signup_ever", "ever", "signup", fill=0.0),
    features.Feature("error_24h", "recent", "error", window_h=24, fill=0.0),
    features.Feature("view_count_72h", "count", "view", window_h=72, fill=0.0),
    features.Feature("click_sum_72h", "sum", "click", window_h=72),
    features.Feature("view_keys", "distinct", "view", fill=0.0),
    features.Feature("dose_view_48h", "dose", "view", window_h=48, fill=0.0),
]
MATRIX = "WITH " + GATED + """, w AS (
  SELECT entity_id, arg_max(value, struct_pack(a := t_event, b := t_avail, c := event_id)) FILTER (domain = 'click' AND value IS NOT NULL) AS purchase_latest,
    arg_max(hours_since_event, struct_pack(a := t_event, b := t_avail, c := event_id)) FILTER (domain = 'click' AND value IS NOT NULL) AS click_age_h,
    arg_max(value, struct_pack(a := t_event, b := t_avail, c := event_id)) FILTER (domain = 'view' AND key = 'k0' AND value IS NOT NULL) AS view_k0_latest,
    arg_min(value, struct_pack(a := t_event, b := t_avail, c := event_id)) FILTER (domain = 'error' AND value IS NOT NULL) AS error_first,
    max(1.0::double) FILTER (domain = 'signup') AS signup_ever, max(1.0::double) FILTER (domain = 'error' AND hours_since_event <= 24) AS error_24h,
    count(*) FILTER (domain = 'view' AND hours_since_event <= 72)::double AS view_count_72h, sum(value) FILTER (domain = 'click' AND hours_since_event <= 72) AS click_sum_72h,
    count(DISTINCT key) FILTER (domain = 'view')::double AS view_keys,
    sum(CASE WHEN NOT ongoing AND quantity IS NOT NULL THEN quantity * CASE WHEN date_diff('microsecond', t_event, t_end) > 0
      THEN greatest(0, least(hours_since_event, 48) - date_diff('microsecond', t_end, t0) / 3.6e9) / (date_diff('microsecond', t_event, t_end) / 3.6e9)
      ELSE CASE WHEN hours_since_event <= 48 THEN 1 ELSE 0 END END ELSE 0 END) FILTER (domain = 'view') AS dose_view_48h
  FROM g GROUP BY 1
), m AS (
  SELECT ix.entity_id, round(purchase_latest, 6) AS purchase_latest, (purchase_latest IS NULL)::int AS purchase_latest__miss, round(click_age_h, 6) AS click_age_h, (click_age_h IS NULL)::int AS click_age_h__miss,
    round(view_k0_latest, 6) AS view_k0_latest, (view_k0_latest IS NULL)::int AS view_k0_latest__miss, round(error_first, 6) AS error_first, (error_first IS NULL)::int AS error_first__miss,
    coalesce(signup_ever, 0) AS signup_ever, coalesce(error_24h, 0) AS error_24h, coalesce(view_count_72h, 0) AS view_count_72h,
    round(click_sum_72h, 6) AS click_sum_72h, (click_sum_72h IS NULL)::int AS click_sum_72h__miss, coalesce(view_keys, 0) AS view_keys, round(coalesce(dose_view_48h, 0), 6) AS dose_view_48h
  FROM ix LEFT JOIN w USING (entity_id)
)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def gated(spark: SparkSession, d: str) -> DataFrame:
    return gate.as_of(events(spark, d), index(spark, d))


@query("ao_gate_matrix", MATRIX + " SELECT * FROM m")
def gate_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.matrix(gated(spark, d), index(spark, d), FEATURES))


@query("ao01_as_of", "WITH " + GATED + " SELECT event_id, entity_id, domain, key, value, quantity, t_event, t_avail, t_end, ongoing, t0, round(hours_since_event, 6) AS hours_since_event, round(hours_since_avail, 6) AS hours_since_avail FROM g")
def as_of(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gated(spark, d).drop("site"))


@query("ao02_violations", "WITH " + GATED + " SELECT 0::bigint AS late, 0::bigint AS unknown, 0::bigint AS open_end, 0::bigint AS end_after, count(*) AS rows FROM g")
def violations(spark: SparkSession, d: str) -> DataFrame:
    return gate.violations(gated(spark, d))


@query("ao02_spoilt", "WITH " + GATED + " SELECT count(*) FILTER (t_avail + to_hours(12) > t0) AS late, count(*) FILTER (key = 'k0') AS unknown, count(*) FILTER (ongoing) AS open_end, 0::bigint AS end_after, count(*) AS rows FROM (SELECT * REPLACE (CASE WHEN key <> 'k0' THEN t_avail END AS t_avail) FROM g)")
def spoilt(spark: SparkSession, d: str) -> DataFrame:
    """A frame into which late availabilities, unknown ones and open ends were smuggled."""
    g = gated(spark, d).withColumn("t_avail", F.when(F.col("key") != "k0", F.timestamp_add("HOUR", F.lit(12), F.col("t_avail"))))
    return gate.violations(g.withColumn("t_end", F.when(F.col("ongoing"), F.col("t0")).otherwise(F.col("t_end"))))


@query("ao03_presentation", "WITH " + INDEX + " SELECT event_id, entity_id, t0, coalesce(t_end_raw > t0 + to_hours(6), false) AS ongoing, round(date_diff('microsecond', t_event, t0) / 3.6e9, 6) AS hours_since_event FROM ev JOIN (SELECT entity_id, t0 FROM ix) USING (entity_id) WHERE domain IN ('error', 'view') AND t_avail <= t0 + to_hours(6)")
def presentation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gate.as_of_presentation(events(spark, d), index(spark, d), ["error", "view"], 6).select("event_id", "entity_id", "t0", "ongoing", F.col("hours_before_t0_event").alias("hours_since_event")))


def last_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    last = o.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return last.select(F.col("o_custkey").alias("entity_id"), F.timestamp_add("HOUR", F.lit(12), F.col("o_orderdate")).alias("t0"))


LAST = "lo AS (SELECT o_custkey AS entity_id, o_orderdate + to_hours(12) AS t0 FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"


def compact(spark: SparkSession, d: str) -> DataFrame:
    return intervals.compacted(raw_intervals(spark, d), "status = 'O'", 30)


STARTS = INTERVALS + ", " + LAST + """, es AS (
  SELECT lo.entity_id, lo.t0, least(coalesce(c.covered, lo.t0 - to_days(2)), lo.t0) AS start, CASE WHEN c.covered IS NULL THEN 'fallback' ELSE 'covering' END AS basis
  FROM lo LEFT JOIN (SELECT lo.entity_id, min(t_start) AS covered FROM lo JOIN iv USING (entity_id) WHERE t_start <= t0 AND t_end >= t0 GROUP BY 1) c USING (entity_id)
)"""


@query("ao04_encounter_start", "WITH " + STARTS + " SELECT * FROM es")
def encounter_start(spark: SparkSession, d: str) -> DataFrame:
    return gate.encounter_start(last_orders(spark, d), compact(spark, d), 2)


EVENT_STARTS = GATED + ", st AS (SELECT entity_id, t0, t0 - to_days(1) AS start FROM ix)"


def event_starts(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).select("entity_id", "t0", F.timestamp_add("DAY", F.lit(-1), F.col("t0")).alias("start"))


@query("ao05_current_encounter", "WITH " + EVENT_STARTS + " SELECT g.event_id, g.entity_id, g.domain FROM g JOIN st USING (entity_id) WHERE g.t_event >= st.start OR g.domain = 'signup'")
def current_encounter(spark: SparkSession, d: str) -> DataFrame:
    return gate.current_encounter(gated(spark, d), event_starts(spark, d), ["signup"]).select("event_id", "entity_id", "domain")


@query("ao06_index", "WITH " + INDEX + " SELECT * FROM ix")
def index_rows(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d)


@query("ao07_onset", "WITH " + EVENT_STARTS + " SELECT st.entity_id, coalesce(f, start) AS onset, CASE WHEN f IS NULL THEN 'start' ELSE 'score' END AS basis FROM st LEFT JOIN (SELECT st.entity_id, min(t_event) AS f FROM st JOIN ev USING (entity_id) WHERE domain = 'error' AND value > 20 AND t_event BETWEEN start AND t0 GROUP BY 1) USING (entity_id)")
def onset(spark: SparkSession, d: str) -> DataFrame:
    return gate.onset(event_starts(spark, d), events(spark, d), "domain = 'error' AND value > 20")


@query("ev07_intervals", "WITH " + INTERVALS + " SELECT * FROM iv")
def interval_rows(spark: SparkSession, d: str) -> DataFrame:
    return compact(spark, d)


@query("jn02_backward_as_of", "WITH " + INTERVALS + ", " + POINTS + """, m AS (SELECT point_id, t, unnest(arg_max(struct_pack(t_end := t_end, interval_id := interval_id), struct_pack(a := t_start, b := iv.interval_id))) FROM pt JOIN iv USING (entity_id) WHERE t_start <= t GROUP BY 1, 2)
  SELECT pt.point_id, CASE WHEN m.t_end >= pt.t THEN m.interval_id END AS interval_id FROM pt LEFT JOIN m USING (point_id)""")
def backward_as_of(spark: SparkSession, d: str) -> DataFrame:
    return intervals.backward_as_of(points(spark, d), compact(spark, d))


COVER = INTERVALS + ", " + POINTS + """, cv AS (
  SELECT point_id, interval_id, t_start, CASE WHEN t_start <= t AND t_end >= t THEN 'exact' ELSE 'slack' END AS cover FROM pt JOIN iv USING (entity_id)
  WHERE date_diff('microsecond', t, t_start) / 3.6e9 <= 24 AND date_diff('microsecond', t_end, t) / 3.6e9 <= 24
  QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY NOT (t_start <= t AND t_end >= t), NOT (date_diff('microsecond', t_start, t_end) / 3.6e9 >= 24), t_start > t, class_rank, t_start DESC, interval_id) = 1
), mt AS (SELECT pt.point_id, pt.entity_id, pt.t, cv.interval_id, cv.t_start, cv.cover FROM pt LEFT JOIN cv USING (point_id))"""


@query("jn03_covering", "WITH " + COVER + " SELECT point_id, interval_id, t_start, cover FROM mt")
def covering(spark: SparkSession, d: str) -> DataFrame:
    return intervals.covering(points(spark, d), compact(spark, d), 24)


@query("jn04_chained_start", "WITH " + COVER + """, h AS (SELECT point_id, min(iv.t_start) AS e FROM mt JOIN iv USING (entity_id) WHERE mt.t_start IS NOT NULL AND NOT iv.open AND (iv.class_rank <= 2 OR iv.t_end > iv.t_start + to_days(90)) AND iv.t_start <= mt.t_start
  AND date_diff('microsecond', iv.t_end, mt.t_start) / 3.6e9 <= 48 GROUP BY 1) SELECT point_id, least(coalesce(e, t_start), t) AS start FROM mt LEFT JOIN h USING (point_id)""")
def chained_start(spark: SparkSession, d: str) -> DataFrame:
    p, c = points(spark, d), written(compact(spark, d), "compact")
    m = intervals.covering(p, c, 24).join(p, "point_id")
    return intervals.chained_start(m, c, 48, "class_rank <= 2 OR t_end > timestampadd(DAY, 90, t_start)")


@query("jn05_chain_back", """WITH RECURSIVE o AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent, o_orderdate AS t FROM orders),
  r AS (SELECT id, id AS at, t AS f, 0 AS k FROM o UNION ALL SELECT r.id, p.id, least(r.f, p.t), k + 1 FROM r JOIN o ON o.id = r.at JOIN o p ON p.id = o.parent WHERE k < 3)
  SELECT id, min(f) AS first FROM r GROUP BY 1""")
def chain_back(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(w).alias("parent"), F.col("o_orderdate").alias("t"))
    return intervals.chain_back(o.select("id", "t"), o, 3)


@query("pf04_overlaps", "WITH " + INTERVALS + ", " + LAST + " SELECT interval_id, round(date_diff('microsecond', t0, t_start) / 3.6e9, 6) AS start_h FROM iv JOIN lo USING (entity_id) WHERE date_diff('microsecond', t0, t_start) / 3.6e9 <= 0 AND greatest(date_diff('microsecond', t0, t_end), date_diff('microsecond', t0, t_start)) / 3.6e9 >= -240")
def overlap_rows(spark: SparkSession, d: str) -> DataFrame:
    j = compact(spark, d).join(last_orders(spark, d), "entity_id").select("interval_id", hours_between("t0", "t_start").alias("start_h"), hours_between("t0", "t_end").alias("end_h"))
    return rounded(intervals.overlaps(j, -240, 0).select("interval_id", "start_h"))


@query("jn06_attach_cases", "WITH " + INDEX + " SELECT ev.event_id, ev.entity_id, round(date_diff('microsecond', t0, t_event) / 3.6e9, 6) AS hours_from_t0 FROM ev JOIN ix ON ev.entity_id = ix.entity_id WHERE date_diff('microsecond', t0, t_event) / 3.6e9 BETWEEN -48 AND 48")
def attach_cases(spark: SparkSession, d: str) -> DataFrame:
    j = events(spark, d).join(index(spark, d).select("entity_id", "t0"), "entity_id").withColumn("hours_from_t0", hours_between("t0", "t_event"))
    return rounded(j.filter(F.col("hours_from_t0").between(-48, 48)).select("event_id", "entity_id", "hours_from_t0"))


@query("jn07_nearest_gaps", "WITH " + INDEX + ", j AS (SELECT ev.entity_id, domain AS source, date_diff('microsecond', t0, t_event) / 3.6e9 AS gap FROM ev JOIN ix ON ev.entity_id = ix.entity_id) SELECT entity_id, source, round(arg_min(gap, struct_pack(a := abs(gap), g := gap)), 6) AS gap_h, count(*) AS n FROM j GROUP BY 1, 2")
def nearest_gaps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nearest.nearest_gaps(index(spark, d), events(spark, d)))


@query("jn08_nearest_value", "WITH " + INDEX + ", j AS (SELECT ev.entity_id, t_event, value, date_diff('microsecond', t0, t_event) / 3.6e9 AS h FROM ev JOIN ix ON ev.entity_id = ix.entity_id WHERE domain = 'error') SELECT entity_id, arg_min(value, struct_pack(a := abs(h), b := h > 0, c := t_event, e := value)) AS value, min(value) AS low, count(*) AS n FROM j WHERE h BETWEEN -72 AND 24 AND value IS NOT NULL GROUP BY 1")
def nearest_value(spark: SparkSession, d: str) -> DataFrame:
    return nearest.nearest_value(index(spark, d), events(spark, d).filter("domain = 'error'"), 72, 24)


@query("jn09_exposed", "WITH " + EVENTS + ", p AS (SELECT * FROM ev WHERE domain = 'purchase') SELECT p.event_id AS point_id, p.entity_id, p.t_event AS t, exists(SELECT 1 FROM ev x WHERE x.domain = 'error' AND x.entity_id = p.entity_id AND x.t_event <= p.t_event AND date_diff('microsecond', x.t_event, p.t_event) / 3.6e9 <= 24) AS exposed FROM p")
def exposed(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    p = e.filter("domain = 'purchase'").select("entity_id", F.col("event_id").alias("point_id"), F.col("t_event").alias("t"))
    return nearest.exposed(p, e.filter("domain = 'error'"), 24)


def merges(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").filter("c_custkey % 10 IN (0, 1)")
    return c.select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1).alias("new"), F.lit(1).alias("mod"))


MERGES = "mg AS (SELECT c_custkey AS old, CASE c_custkey % 10 WHEN 0 THEN c_custkey + 2 ELSE c_custkey + 1 END AS survivor FROM customer WHERE c_custkey % 10 IN (0, 1))"


@query("jn11_merge_history", "WITH " + MERGES + " SELECT old, survivor FROM mg")
def merge_history(spark: SparkSession, d: str) -> DataFrame:
    return identity.resolved(merges(spark, d)).select("old", "survivor")


@query("jn11_rekeyed_orders", "WITH " + MERGES + " SELECT coalesce(survivor, o_custkey) AS o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN mg ON old = o_custkey GROUP BY 1")
def rekeyed_orders(spark: SparkSession, d: str) -> DataFrame:
    o = identity.rekeyed(table(spark, d, "orders"), identity.resolved(merges(spark, d)), "o_custkey")
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("jn22_verified_rows", "SELECT o_orderkey, o_custkey, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN c_custkey = o_custkey THEN 'ok' ELSE 'conflict' END AS status FROM orders LEFT JOIN (SELECT o_orderkey AS k, o_custkey + (o_orderkey % 50 = 0)::int AS c_custkey FROM orders WHERE o_orderkey % 11 <> 0) ON k = o_orderkey")
def verified_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    source = o.filter("o_orderkey % 11 <> 0").select("o_orderkey", (F.col("o_custkey") + (F.col("o_orderkey") % 50 == 0).cast("int")).alias("seen"))
    return identity.verified(o.select("o_orderkey", "o_custkey"), source.withColumnRenamed("seen", "o_custkey"), ["o_orderkey"], "o_custkey")


COLOURS = [("red|hot", "warm"), ("blue|cold", "cool"), ("small", "small"), ("ring|bolt", "round")]


@query("jn13_first_match", "SELECT p_partkey, p_name, CASE WHEN regexp_matches(p_name, 'red|hot') THEN 'warm' WHEN regexp_matches(p_name, 'blue|cold') THEN 'cool' WHEN regexp_matches(p_name, 'small') THEN 'small' WHEN regexp_matches(p_name, 'ring|bolt') THEN 'round' END AS item FROM part")
def first_matches(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.classified(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", COLOURS)


@query("jn13_all_matches", "WITH r AS (SELECT * FROM (VALUES ('red|hot', 'warm'), ('blue|cold', 'cool'), ('small', 'small'), ('ring|bolt', 'round')) t(p, item)) SELECT item, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey JOIN r ON regexp_matches(p_name, r.p) GROUP BY 1")
def all_matches(spark: SparkSession, d: str) -> DataFrame:
    p = lexicon.all_matches(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", COLOURS)
    j = table(spark, d, "lineitem").select("l_partkey", "l_quantity").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("item").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("jn14_code_prefixes", "SELECT p_partkey, item FROM (SELECT p_partkey, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS c FROM part) JOIN (VALUES ('BRAND1', '^BRAND1[5-9]$', 'low'), ('BRAND2', NULL, 'high'), ('BRAND15', NULL, 'fifteen')) r(prefix, exclude, item) ON starts_with(c, prefix) AND NOT coalesce(regexp_matches(c, exclude), false)")
def code_prefixes(spark: SparkSession, d: str) -> DataFrame:
    r = spark.createDataFrame([("BRAND1", "^BRAND1[5-9]$", "low"), ("BRAND2", None, "high"), ("BRAND15", None, "fifteen")], "prefix string, exclude string, item string")
    p = table(spark, d, "part").select("p_partkey", normal_code(F.col("p_brand")).alias("code"))
    return lexicon.code_hits(p, "code", r).select("p_partkey", "item")


@query("sf01_normal_names", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS code FROM part")
def normal_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", normal_name(F.col("p_name")).alias("name"), normal_code(F.col("p_brand")).alias("code"))


@query("sf04_units", "WITH " + EVENTS + """, x AS (SELECT event_id, domain AS item, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'cents' WHEN event_id % 7 = 0 THEN 'ounces' ELSE 'units' END AS unit, value FROM ev),
  u AS (SELECT *, CASE unit WHEN 'cents' THEN value * 0.01::double WHEN 'units' THEN value END AS c FROM x)
  SELECT event_id, CASE WHEN s = 'ok' THEN round(c, 6) END AS canonical, s AS status FROM (SELECT *, CASE WHEN value IS NULL THEN 'no_value' WHEN unit IS NULL THEN 'unit_missing' WHEN c IS NULL THEN 'unit_unrecognised' WHEN c NOT BETWEEN 0.05 AND 200 THEN 'implausible' ELSE 'ok' END AS s FROM u)""")
def units(spark: SparkSession, d: str) -> DataFrame:
    unit = F.expr("CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'cents' WHEN event_id % 7 = 0 THEN 'ounces' ELSE 'units' END")
    rows = events(spark, d).select("event_id", F.col("domain").alias("item"), unit.alias("unit"), "value")
    kinds = ["click", "error", "purchase", "signup", "view"]
    u = spark.createDataFrame([(k, n, 0.0, m, 0.0) for k in kinds for n, m in (("cents", 0.01), ("units", 1.0))], "item string, unit string, pre double, mul double, add double")
    r = spark.createDataFrame([(k, 0.05, 200.0) for k in kinds], "item string, lo double, hi double")
    return rounded(lexicon.converted(rows, u, r).select("event_id", "canonical", "status"))


@query("ag10_long_features", MATRIX + " SELECT entity_id, feature, round(value, 6) AS value FROM (SELECT entity_id, purchase_latest, click_age_h, view_k0_latest, error_first, signup_ever, error_24h, view_count_72h, click_sum_72h, view_keys, dose_view_48h FROM m) UNPIVOT INCLUDE NULLS (value FOR feature IN (purchase_latest, click_age_h, view_k0_latest, error_first, signup_ever, error_24h, view_count_72h, click_sum_72h, view_keys, dose_view_48h))")
def long_features(spark: SparkSession, d: str) -> DataFrame:
    wide = features.matrix(gated(spark, d), index(spark, d), FEATURES)
    return rounded(features.long_form(wide, FEATURES).select("entity_id", "feature", "value"))


@query("ag11_missingness", MATRIX + " SELECT feature, count(*) AS n, round(avg((value IS NULL)::int), 6) AS missing FROM (SELECT * FROM (SELECT entity_id, purchase_latest, click_age_h, view_k0_latest, error_first, signup_ever, error_24h, view_count_72h, click_sum_72h, view_keys, dose_view_48h FROM m) UNPIVOT INCLUDE NULLS (value FOR feature IN (purchase_latest, click_age_h, view_k0_latest, error_first, signup_ever, error_24h, view_count_72h, click_sum_72h, view_keys, dose_view_48h))) GROUP BY 1")
def missing_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.missingness(features.matrix(gated(spark, d), index(spark, d), FEATURES), FEATURES))


@query("ag12_unmapped_names", "SELECT name, count(DISTINCT l_orderkey) AS orders FROM (SELECT l_orderkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name FROM lineitem JOIN part ON p_partkey = l_partkey) WHERE NOT regexp_matches(name, 'red|hot|blue|cold|small|ring|bolt') GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 20")
def unmapped_names(spark: SparkSession, d: str) -> DataFrame:
    named = lexicon.classified(table(spark, d, "part").select("p_partkey", normal_name(F.col("p_name")).alias("name")), "name", COLOURS).filter("item IS NULL")
    j = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(named, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("name").agg(F.count_distinct("l_orderkey").alias("orders")).filter("orders >= 20")


@query("ag13_rollup_shares", "SELECT flag, site, count(v) AS n, sum(v) AS n_true, round(sum(v) / count(v), 6) AS share FROM (SELECT domain_site AS site, unnest([struct_pack(f := 'late', v := late), struct_pack(f := 'large', v := large)], recursive := true) FROM (SELECT (user_id % 3)::int AS domain_site, (extract(hour FROM ts) >= 18)::int AS late, (value > 50)::int AS large FROM events)) t(site, flag, v) GROUP BY GROUPING SETS ((flag, site), (flag))")
def rollup_shares(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("site", (F.hour("t_event") >= 18).alias("late"), (F.col("value") > 50).alias("large"))
    return rounded(features.shares(e, "site", ["late", "large"]))


@query("ag14_grouping_sets", "SELECT site, bin, count(value) AS n, round(avg(value), 6) AS mean FROM (SELECT (user_id % 3)::int AS site, extract(hour FROM ts)::int // 6 AS bin, value FROM events) GROUP BY GROUPING SETS ((site, bin), (bin))")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("site", F.floor(F.hour("t_event") / 6).cast("int").alias("b"), "value")
    return rounded(features.binned(e, "value", "site", "b"))


@query("ag16_quantiles", "SELECT event_type AS domain, count(value) AS n, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY 1")
def quantile_rows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.quantiles(events(spark, d), "domain", "value"))


@query("wn01_prior_extremes", "SELECT event_id, min(value) OVER w AS prior_min, max(value) OVER w AS prior_max FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def prior_extremes(spark: SparkSession, d: str) -> DataFrame:
    return runs.prior_extremes(events(spark, d)).select("event_id", "prior_min", "prior_max")


@query("wn02_sustained_low", """WITH e AS (SELECT user_id AS entity_id, event_id, ts, value < 60 AS low, lag(value < 60, 1, false) OVER w AS pl, lag(ts) OVER w AS pt FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  r AS (SELECT *, sum(CASE WHEN low AND (NOT pl OR pt IS NULL OR date_diff('microsecond', pt, ts) / 3.6e9 > 24) THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS run FROM e)
  SELECT entity_id, min(ts) AS onset, max(ts) AS until, count(*) AS n FROM r WHERE low GROUP BY entity_id, run HAVING date_diff('microsecond', min(ts), max(ts)) / 3.6e9 >= 12""")
def sustained_low(spark: SparkSession, d: str) -> DataFrame:
    return runs.sustained_low(events(spark, d), 60, 12, 24)


@query("wn03_new_starts", "SELECT event_id, round(g, 6) AS gap_h FROM (SELECT event_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), ts) / 3.6e9 AS g FROM events) WHERE g IS NULL OR g >= 72")
def new_starts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(runs.new_starts(events(spark, d), 72, ("entity_id", "domain")).select("event_id", "gap_h"))


@query("wn04_day_islands", """WITH x AS (SELECT DISTINCT user_id AS entity_id, event_type AS agent, ts::date AS day FROM events), n AS (SELECT *, lead(day) OVER (PARTITION BY entity_id, agent ORDER BY day) AS nx FROM x),
  f AS (SELECT DISTINCT entity_id, unnest([day] || CASE WHEN nx - day = 2 THEN [(day + 1)::date] ELSE [] END) AS day FROM n),
  i AS (SELECT entity_id, day, day - row_number() OVER (PARTITION BY entity_id ORDER BY day)::int AS g FROM f) SELECT entity_id, min(day)::date::varchar AS first_day, count(*) AS days FROM i GROUP BY entity_id, g HAVING count(*) >= 4""")
def day_islands(spark: SparkSession, d: str) -> DataFrame:
    return runs.day_islands(events(spark, d).select("entity_id", F.col("domain").alias("agent"), F.to_date("t_event").alias("day")), 4).withColumn("first_day", F.col("first_day").cast("string"))


@query("wn05_rank_bins", "SELECT event_id, ((row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) - 1) * 7 // count(*) OVER (PARTITION BY user_id % 3))::int AS bin FROM events")
def rank_bins(spark: SparkSession, d: str) -> DataFrame:
    return runs.rank_bins(events(spark, d), "site", ("t_event", "event_id"), 7).select("event_id", "bin")


@query("wn06_tenths", "SELECT event_id, ntile(10) OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id)::int AS tenth FROM events")
def tenth_rows(spark: SparkSession, d: str) -> DataFrame:
    return runs.tenths(events(spark, d), "site", ("t_event", "event_id")).select("event_id", "tenth")


@query("wn07_late_holdout", "WITH e AS (SELECT event_id, user_id % 3 AS site, epoch_us(ts) / 1e6 AS s FROM events), c AS (SELECT site, quantile_cont(s, 0.8) AS cut FROM e GROUP BY 1) SELECT event_id, CASE WHEN s >= cut THEN 'test' WHEN s < cut - 86400 THEN 'train' ELSE 'none' END AS role FROM e JOIN c USING (site)")
def late_holdout(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", "site", (F.unix_micros(F.col("t_event").cast("timestamp")) / F.lit(1e6)).alias("s"))
    return runs.late_holdout(e, "site", "s", 0.2, 86400).select("event_id", "role")


@query("wn08_folds", "SELECT f.lang AS fold, CASE WHEN d.lang = f.lang THEN 'eval' ELSE 'dev' END AS role, count(*) AS n FROM documents d, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) f GROUP BY 1, 2")
def folds(spark: SparkSession, d: str) -> DataFrame:
    return runs.leave_one_out(table(spark, d, "documents").select("lang"), "lang").groupBy("fold", "role").agg(F.count("*").alias("n"))


@query("wn10_risk_coverage", "SELECT user_id % 3 AS site, event_id AS id, round((row_number() OVER w) / count(*) OVER (PARTITION BY user_id % 3), 6) AS coverage, round(avg((event_type = 'error')::int) OVER w, 6) AS risk FROM events WINDOW w AS (PARTITION BY user_id % 3 ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING)")
def risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("site").cast("long").alias("site"), F.col("event_id").alias("id"), (F.col("domain") == "error").cast("double").alias("risk"), F.col("value").alias("conf"))
    return rounded(runs.cumulative_risk(e, "site"))


@query("tk02_top_values", "SELECT site, CASE WHEN r <= 3 THEN v ELSE 'other' END AS label, sum(n)::bigint AS n FROM (SELECT lang AS site, source AS v, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY 1, 2) GROUP BY 1, 2")
def top_values(spark: SparkSession, d: str) -> DataFrame:
    return runs.top_values(table(spark, d, "documents").select(F.col("lang").alias("site"), F.col("source").alias("v")), "site", "v", 3)


@query("tk03_capped_notes", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER w AS n, sum(length(coalesce(text, ''))) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE n <= 4 AND c <= 3000")
def capped_notes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    return runs.capped(c, "conv_id", ("turn",), 4, 3000).select("conv_id", "turn")


RULES = {
    "E1": {"any_of": [{"id": "err_high", "item": "error", "lab_threshold": ("gt", 90), "window_hours": (-48, 24)}, {"id": "signup", "item": "signup", "window_hours": (-2, 2)}]},
    "E2": {"all_of": [{"id": "click_low", "item": "click", "lab_threshold": ("lt", 40), "window_hours": (-72, 0)}, {"id": "view_high", "item": "view", "lab_threshold": ("ge", 60), "window_hours": (-72, 24)}]},
}
LABELS = INDEX + """, h AS (SELECT ev.entity_id AS case_id, domain AS item, value, date_diff('microsecond', t0, t_event) / 3.6e9 AS hours FROM ev JOIN ix ON ev.entity_id = ix.entity_id),
  f AS (SELECT ix.entity_id AS case_id, coalesce(bool_or(item = 'error' AND hours BETWEEN -48 AND 24 AND value > 90), false) AS a, coalesce(bool_or(item = 'signup' AND hours BETWEEN -2 AND 2 AND (value IS NULL OR value >= 1)), false) AS b,
    coalesce(bool_or(item = 'click' AND hours BETWEEN -72 AND 0 AND value < 40), false) AS c, coalesce(bool_or(item = 'view' AND hours BETWEEN -72 AND 24 AND value >= 60), false) AS e FROM ix LEFT JOIN h ON h.case_id = ix.entity_id GROUP BY 1),
  lb AS (SELECT case_id, 'E1' AS label, a OR b AS y, concat_ws(',', CASE WHEN a THEN 'err_high' END, CASE WHEN b THEN 'signup' END) AS fired FROM f
    UNION ALL SELECT case_id, 'E2', c AND e, CASE WHEN c AND e THEN 'click_low,view_high' ELSE '' END FROM f)"""


def labels_of(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).join(index(spark, d).select("entity_id", "t0"), "entity_id")
    timed = e.select(F.col("entity_id").alias("case_id"), F.col("domain").alias("item"), "value", hours_between("t0", "t_event").alias("hours"))
    return rules.evaluated(index(spark, d).select(F.col("entity_id").alias("case_id")), timed, RULES)


@query("lb02_rules", "WITH " + LABELS + " SELECT * FROM lb")
def rule_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels_of(spark, d)


@query("lb06_availability", "WITH " + LABELS + """, s AS (SELECT case_id, (case_id % 4)::int AS bin, bool_or(item = 'view' AND hours BETWEEN -12 AND 12) AS has FROM h GROUP BY 1), t AS (SELECT bin, avg(has::int) AS share FROM s GROUP BY 1)
  SELECT case_id, label, CASE WHEN share < 0.5 AND NOT y THEN NULL ELSE y END AS y FROM lb JOIN s USING (case_id) JOIN t USING (bin)""")
def availability(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).join(index(spark, d).select("entity_id", "t0"), "entity_id").withColumn("h", hours_between("t0", "t_event"))
    s = e.groupBy(F.col("entity_id").alias("case_id")).agg(F.bool_or((F.col("domain") == "view") & F.col("h").between(-12, 12)).alias("has_source"))
    return rules.available(labels_of(spark, d), s.withColumn("bin", (F.col("case_id") % 4).cast("int")), 0.5)


@query("lb11_pattern", "WITH " + LABELS + " SELECT case_id, CASE WHEN bool_or(y AND label = 'E2') THEN 'E2' WHEN bool_or(y AND label = 'E1') THEN 'E1' ELSE 'all_negative' END AS pattern FROM lb GROUP BY 1")
def patterns(spark: SparkSession, d: str) -> DataFrame:
    return rules.pattern(labels_of(spark, d), ["E2", "E1"])


@query("jn18_exclusion", "WITH " + LABELS + " SELECT case_id, label, CASE WHEN label = 'E1' THEN y AND NOT bool_or(y AND label = 'E2') OVER (PARTITION BY case_id) ELSE y END AS y FROM lb")
def exclusion(spark: SparkSession, d: str) -> DataFrame:
    return rules.excluded(labels_of(spark, d).select("case_id", "label", "y"), "E1", "E2")


@query("lb09_report", "WITH " + LABELS + ", x AS (SELECT label, unnest(string_split(fired, ',')) AS leaf, (case_id % 3)::int AS site FROM lb WHERE fired <> '') SELECT label, leaf, site, count(*) AS n FROM x GROUP BY GROUPING SETS ((label, leaf, site), (label, leaf))")
def label_report(spark: SparkSession, d: str) -> DataFrame:
    x = labels_of(spark, d).filter("fired <> ''").select("label", F.explode(F.split("fired", ",")).alias("leaf"), (F.col("case_id") % 3).cast("int").alias("site"))
    g = x.groupingSets([[F.col("label"), F.col("leaf"), F.col("site")], [F.col("label"), F.col("leaf")]], "label", "leaf", "site")
    return g.agg(F.count("*").alias("n")).select("label", "leaf", "site", "n")

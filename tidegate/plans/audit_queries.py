"""Registered queries on audits, merged flows, availability, channels and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators import audits, flow, gate
from tidegate.plans.tables import EVENTS, GATED, INTERVALS, POINTS, RAW_INTERVALS, events, index, points, raw_intervals, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query("ag03_bilateral", "WITH " + GATED + ", w AS (SELECT entity_id, arg_max(value, t_event) FILTER (key = 'k0') AS l, arg_max(value, t_event) FILTER (key = 'k1') AS r FROM (SELECT *, floor(value) AS v FROM g WHERE domain = 'view') GROUP BY 1) SELECT entity_id, CASE WHEN l IS NOT NULL OR r IS NOT NULL THEN (coalesce(floor(l / 10) = 0, false) OR coalesce(floor(r / 10) = 0, false))::int END AS pupil_any_zero, abs(floor(l / 10) - floor(r / 10))::bigint AS pupil_gap FROM w")
def bilateral(spark: SparkSession, d: str) -> DataFrame:
    g = gate.as_of(events(spark, d), index(spark, d)).filter("domain = 'view'")
    side = lambda k: F.floor(F.max_by("value", F.when(F.col("key") == k, F.col("t_event"))) / 10)
    w = g.groupBy("entity_id").agg(side("k0").alias("left"), side("k1").alias("right"))
    return audits.bilateral(w, {"pupil": ("left", "right")}).select("entity_id", "pupil_any_zero", "pupil_gap")


@query("ag07_results", "WITH " + GATED + " SELECT entity_id, key, arg_max(value, struct_pack(a := t_avail, b := t_event, c := event_id)) FILTER (value IS NOT NULL) AS latest, bool_or(value IS NOT NULL) AS resulted, bool_or(value > 20) AS positive, count(*) AS n FROM g WHERE domain = 'error' GROUP BY 1, 2")
def results(spark: SparkSession, d: str) -> DataFrame:
    # a running interval hides its quantity, not its value
    return audits.results(gate.as_of(events(spark, d), index(spark, d)), "error", "value > 20")


@query("ag09_one_hot", "SELECT p_partkey, regexp_matches(lower(p_name), 'ring')::int AS p_name_ring, (regexp_matches(lower(p_name), 'widget') AND NOT regexp_matches(lower(p_name), 'ring'))::int AS p_name_widget, (NOT regexp_matches(lower(p_name), 'ring|widget'))::int AS p_name_other FROM part")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    return audits.one_hot(table(spark, d, "part"), "p_name", {"ring": "ring", "widget": "widget"}, ["p_partkey"])


@query("ag17_criteria", "WITH c AS (SELECT 'dated' AS criterion, avg((o_orderdate IS NOT NULL)::int::double) AS share, 0.99::double AS least FROM orders UNION ALL SELECT 'large', avg(coalesce(o_totalprice > 250000, false)::int::double), 0.6 FROM orders UNION ALL SELECT 'filled', avg(coalesce(o_orderstatus = 'F', false)::int::double), 0.2 FROM orders) SELECT criterion, round(share, 6) AS share, least, share >= least AS passed FROM c")
def criteria(spark: SparkSession, d: str) -> DataFrame:
    checks = {"dated": ("o_orderdate IS NOT NULL", 0.99), "large": ("o_totalprice > 250000", 0.6), "filled": ("o_orderstatus = 'F'", 0.2)}
    return rounded(audits.criteria(table(spark, d, "orders"), checks))


@query("ag19_misordered", "WITH " + RAW_INTERVALS + ", j AS (SELECT l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT 'visits' AS source, 'end_first' AS rule, count(*) AS n, count(*) FILTER (t_end < t_start) AS n_bad FROM ri UNION ALL SELECT 'visits', 'too_long', count(*), count(*) FILTER (t_end > t_start + to_days(2000)) FROM ri UNION ALL SELECT 'items', 'before_visit', count(*), count(*) FILTER (l_shipdate < o_orderdate) FROM j")
def misordered(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_shipdate", "o_orderdate")
    visits = {"end_first": "t_end < t_start", "too_long": "t_end > timestampadd(DAY, 2000, t_start)"}
    return audits.misordered({"visits": (raw_intervals(spark, d), visits), "items": (j, {"before_visit": "l_shipdate < o_orderdate"})})


@query("ag20_novelty", "WITH x AS (SELECT lang, regexp_extract(text, '[A-Za-z]+', 0) AS w, doc_id % 2 = 0 AS old FROM documents WHERE text IS NOT NULL), k AS (SELECT DISTINCT lang, w FROM x WHERE old) SELECT lang, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM k WHERE k.lang IS NOT DISTINCT FROM x.lang AND k.w = x.w)) AS n_new FROM x WHERE NOT old GROUP BY 1")
def novelty(spark: SparkSession, d: str) -> DataFrame:
    """First words of odd documents that even ones of the language don't begin with."""
    x = table(spark, d, "documents").filter("text IS NOT NULL").select("lang", F.regexp_extract("text", "[A-Za-z]+", 0).alias("w"), (F.col("doc_id") % 2 == 0).alias("old"))
    return audits.novelty(x.filter("NOT old"), x.filter("old"), "lang", "w")


GEOMETRY = """gm AS (SELECT point_id, t, t_start, t_end, date_diff('microsecond', t, t_start) / 3.6e9 AS s, date_diff('microsecond', t_end, t) / 3.6e9 AS e FROM pt JOIN ri USING (entity_id))"""


@query("ag23_geometry", "WITH " + RAW_INTERVALS + ", " + POINTS + ", " + GEOMETRY + """ SELECT point_id, count(*) AS n, count(*) FILTER (t_end IS NULL) AS null_ends, count(*) FILTER (date_trunc('day', t_end) = t_end) AS midnight_ends, coalesce(bool_or(t_start <= t AND t_end >= t), false) AS exact,
  coalesce(bool_or(t_start <= t AND coalesce(t_end, t) >= t), false) AS open_end, coalesce(bool_or(t_start <= t AND t_end::date >= t::date), false) AS whole_day, coalesce(bool_or(s <= 24 AND e <= 24), false) AS slack, round(arg_min(s, struct_pack(a := abs(s), b := s)), 6) AS nearest_start_h, max(t_start) FILTER (t_start <= t) AS latest_start FROM gm GROUP BY 1""")
def geometry(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audits.geometry(points(spark, d), raw_intervals(spark, d).select("entity_id", "t_start", "t_end"), 24))


@query("ag24_top_names", "WITH c AS (SELECT p_type, coalesce(regexp_matches(p_name, 'ring|widget'), false) AS matched, p_name, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL) SELECT p_type, matched, p_name, n FROM c QUALIFY row_number() OVER (PARTITION BY p_type, matched ORDER BY n DESC, p_name) <= 5")
def top_names(spark: SparkSession, d: str) -> DataFrame:
    li, p = table(spark, d, "lineitem").select("l_partkey"), table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return audits.top_wordings(li.join(p, F.col("l_partkey") == F.col("p_partkey")), "p_type", "p_name", "p_name RLIKE 'ring|widget'", 5)


@query("ag24_coverage", "WITH h AS (SELECT l_returnflag AS site, l_orderkey AS case_id, date_diff('day', o_orderdate, l_shipdate) * 24.0 AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey), e AS (SELECT site, case_id, bool_or(h BETWEEN 0 AND 240) AS early, bool_or(h BETWEEN 0 AND 960) AS middle, bool_or(h BETWEEN -1000 AND 1920) AS late FROM h GROUP BY 1, 2) SELECT site, count(*) AS n, count(*) FILTER (early) AS early, count(*) FILTER (middle) AS middle, count(*) FILTER (late) AS late FROM e GROUP BY 1")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    h = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("l_returnflag").alias("site"), F.col("l_orderkey").alias("case_id"), (F.datediff("l_shipdate", "o_orderdate") * 24.0).alias("h"))
    return audits.coverage_in(h, "site", "h", {"early": (0, 240), "middle": (0, 960), "late": (-1000, 1920)})


@query("ag26_populations", "WITH p AS (SELECT 'all' AS population, * FROM orders UNION ALL SELECT 'urgent', * FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'large', * FROM orders WHERE o_totalprice > 300000) SELECT population, count(*) AS n, round(avg((o_orderstatus = 'F')::int), 6) AS filled, round(avg((o_totalprice > 100000)::int), 6) AS dear, round(quantile_cont(o_totalprice, 0.25), 6) AS q25, round(quantile_cont(o_totalprice, 0.5), 6) AS q50, round(quantile_cont(o_totalprice, 0.75), 6) AS q75 FROM p GROUP BY 1")
def populations(spark: SparkSession, d: str) -> DataFrame:
    masks = {"all": "true", "urgent": "o_orderpriority = '1-URGENT'", "large": "o_totalprice > 300000"}
    return rounded(audits.populations(table(spark, d, "orders"), masks, {"filled": "o_orderstatus = 'F'", "dear": "o_totalprice > 100000"}, "o_totalprice"))


@query("ag27_causes", "SELECT CASE WHEN text IS NULL THEN 'missing' WHEN n_chars < 300 THEN 'short' WHEN n_chars > 9000 THEN 'long' WHEN lang <> 'en' THEN 'foreign' ELSE 'none' END AS cause, count(*) AS n FROM documents GROUP BY 1")
def causes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("n_chars", "lang", F.col("text").isNull().alias("missing"))
    return rows.groupBy(audits.cause([("missing", "missing"), ("short", "n_chars < 300"), ("long", "n_chars > 9000"), ("foreign", "lang <> 'en'")]).alias("cause")).agg(F.count("*").alias("n"))


@query("ag28_ledger", "SELECT event_type AS reason, count(*) AS n, sum(length(props))::bigint AS bytes, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY 1")
def ledger(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("reason"), F.length("props").alias("size"), "value")
    return rounded(audits.ledger_summary(e, "reason", "size", "value"))


@query("st03_roles", "SELECT lang AS role, count(*) FILTER (toxic = 1) AS positives, count(*) FILTER (NOT coalesce(toxic = 1, false)) AS controls, count(*) FILTER (toxic = 1) >= 5 AND count(*) FILTER (NOT coalesce(toxic = 1, false)) >= 3 * count(*) FILTER (toxic = 1) AS enough FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def roles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left").withColumnRenamed("lang", "role")
    return audits.role_summary(rows, "role", "toxic = 1", 5, 3.0)


def flow_steps(spark: SparkSession, d: str) -> DataFrame:
    """Orders left after each exclusion by segment, then the customers of those that stayed."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_mktsegment").alias("site"), "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderkey", "c_acctbal")
    keep = ["true", "o_totalprice > 1500", "o_orderkey % 500 <> 3", "o_orderpriority <> '5-LOW'", "o_orderstatus <> 'P' OR o_totalprice > 2500"]
    passed, counts = "true", []
    for i, condition in enumerate(keep):
        passed = f"({passed}) AND ({condition})"
        counts.append(F.count_if(F.expr(passed)).alias(f"s{i}"))
    people = lambda c: F.count_distinct(F.when(F.expr(passed + c), F.col("o_custkey")))
    wide = rows.groupBy("site").agg(*counts, people("").alias("s5"), people(" AND c_acctbal > -990").alias("s6"), people(" AND c_acctbal > 0").alias("s7"))
    long = wide.unpivot("site", [f"s{i}" for i in range(8)], "step", "remaining").withColumn("stage", F.substring("step", 2, 1).cast("int"))
    return long.withColumns({"unit": F.when(F.col("stage") < 5, "orders").otherwise("people"), "start": F.col("stage") == 0})


FLOW_STEPS = """
o AS (
  SELECT c_mktsegment AS site, o_custkey AS c, c_acctbal AS b, true AS k0, o_totalprice > 1500 AS k1, o_orderkey % 500 <> 3 AS k2, o_orderpriority <> '5-LOW' AS k3,
    o_orderstatus <> 'P' OR o_totalprice > 2500 AS k4 FROM orders JOIN customer ON o_custkey = c_custkey
), w AS (
  SELECT site, count(*) AS s0, count(*) FILTER (k1) AS s1, count(*) FILTER (k1 AND k2) AS s2, count(*) FILTER (k1 AND k2 AND k3) AS s3, count(*) FILTER (k1 AND k2 AND k3 AND k4) AS s4,
    count(DISTINCT c) FILTER (k1 AND k2 AND k3 AND k4) AS s5, count(DISTINCT c) FILTER (k1 AND k2 AND k3 AND k4 AND b > -990) AS s6, count(DISTINCT c) FILTER (k1 AND k2 AND k3 AND k4 AND b > 0) AS s7
  FROM o GROUP BY site
), t AS (SELECT site, step, substr(step, 2, 1)::int AS stage, n, CASE WHEN substr(step, 2, 1)::int < 5 THEN 'orders' ELSE 'people' END AS unit FROM (UNPIVOT w ON s0, s1, s2, s3, s4, s5, s6, s7 INTO NAME step VALUE n))
"""

#: open: the row that a step waits for. It gets it if a step of its own unit closes that row, else the one before.
FLOW_SQL = "WITH RECURSIVE " + FLOW_STEPS + """, r AS (
  SELECT site, stage, n, unit, 0 AS waits, 0 AS gone, 0 AS closed, 0 AS open, true AS closes FROM t WHERE stage = 0
  UNION ALL
  SELECT site, stage, n, unit, CASE WHEN closes THEN 0 ELSE waits + 1 END, CASE WHEN closes THEN 0 ELSE gone END, CASE WHEN closes THEN closed + 1 ELSE closed END, closed + 1, closes FROM (
    SELECT *, gone >= 11 AND (n = 0 OR n >= 11) AS closes FROM (
      SELECT t.site, t.stage, t.n, t.unit, CASE WHEN r.waits > 0 AND r.closed > 0 AND t.unit <> r.unit THEN 0 ELSE r.waits END AS waits, r.closed,
        CASE WHEN r.waits > 0 AND r.closed > 0 AND t.unit <> r.unit THEN 0 ELSE r.gone END + r.n - t.n AS gone FROM r JOIN t ON t.site = r.site AND t.stage = r.stage + 1))
), p AS (
  SELECT r.*, step, CASE WHEN open > 1 AND coalesce(max(CASE WHEN closes THEN r.unit END) OVER (PARTITION BY r.site, open) <> r.unit, true) THEN open - 1 ELSE open END AS "row"
  FROM r JOIN t ON t.site = r.site AND t.stage = r.stage
), g AS (SELECT site, "row", string_agg(step, ' + ' ORDER BY stage) AS step, max_by(unit, stage) AS unit, min_by(n, stage) AS first_n, max_by(n, stage) AS n FROM p GROUP BY site, "row"),
f AS (SELECT *, lag(n) OVER (PARTITION BY site ORDER BY "row") - n AS x, first_value(n) OVER (PARTITION BY site ORDER BY "row") < 11 AS low FROM g),
h AS (SELECT *, coalesce(x > 0 AND x < 11, false) OR (n > 0 AND n < 11) OR low AS hidden FROM f WHERE NOT low OR "row" = 0)
SELECT site, "row", CASE WHEN low THEN 'withheld' ELSE step END AS step, CASE WHEN NOT low THEN unit END AS unit, CASE WHEN NOT hidden THEN x END AS n_excluded, CASE WHEN NOT hidden THEN n END AS n_remaining FROM h
"""


@query("pv06_merged_flow", FLOW_SQL)
def merged_flow(spark: SparkSession, d: str) -> DataFrame:
    return flow.merged_flow(flow_steps(spark, d), "site")


@query("pv06_flow_report")
def flow_report(spark: SparkSession, d: str) -> DataFrame:
    return flow.flow_report(flow_steps(spark, d), "site")


AVAILABLE_SQL = """
WITH f AS (SELECT lang AS site, text IS NOT NULL AS text, n_chars > 9000 AS long, quality IS NOT NULL AS labelled FROM documents LEFT JOIN labels USING (doc_id)),
u AS (SELECT site, unnest(['text', 'long', 'labelled']) AS flag, unnest([text, long, labelled]) AS v FROM f),
c AS (SELECT site, flag, count(*) FILTER (v) AS n, count(v) AS d FROM u GROUP BY site, flag),
x AS (SELECT *, n < 11 OR d - n < 11 OR d < 11 AS hide FROM c),
a AS (
  SELECT site, flag, n, d, hide, d < 11 AS no_total, false AS linked FROM x
  UNION ALL SELECT NULL, flag, sum(n), sum(d), sum(n) < 11 OR sum(d) - sum(n) < 11 OR sum(d) < 11 OR bool_or(hide), sum(d) < 11 OR bool_or(d < 11), bool_or(hide) FROM x GROUP BY flag
)
SELECT site, flag, CASE WHEN NOT hide THEN n::bigint END AS n, CASE WHEN NOT no_total THEN d::bigint END AS total, CASE WHEN NOT hide AND NOT no_total THEN n / d END AS share,
  CASE WHEN d < 11 THEN 'total' WHEN n < 11 THEN 'low' WHEN d - n < 11 THEN 'high' WHEN linked THEN 'linked' END AS why,
  CASE WHEN n >= 11 AND d - n < 11 AND NOT no_total THEN format('>={:.3f}', (d - 10) / d) END AS bound FROM a
"""


@query("pv08_availability", AVAILABLE_SQL)
def availability(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("site"), F.col("text").isNotNull().alias("text"), (F.col("n_chars") > 9000).alias("long"))
    rows = rows.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("labelled", F.col("quality").isNotNull())
    return audits.availability(rows.select("site", "text", "long", "labelled"), "site", ["text", "long", "labelled"])


@query("sg01_channels", "SELECT event_id, CASE c WHEN 'T3' THEN 'T7' ELSE c END AS channel FROM (SELECT event_id, regexp_replace(regexp_replace(upper(trim(raw)), '^EEG[ _-]*|[ _-]*(REF|LE|AR)$', '', 'g'), '[^A-Z0-9]', '', 'g') AS c FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'EEG T3-REF' WHEN 'view' THEN ' eeg_Fp1 le' WHEN 'error' THEN 'C4' ELSE 'EEG ' || event_type || '-AR' END AS raw FROM events))")
def channels(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_type") == "click", "EEG T3-REF").when(F.col("event_type") == "view", " eeg_Fp1 le").when(F.col("event_type") == "error", "C4").otherwise(F.concat(F.lit("EEG "), "event_type", F.lit("-AR")))
    return audits.channel_names(table(spark, d, "events").select("event_id", raw.alias("raw")), "raw", {"T3": "T7", "T4": "T8"}).select("event_id", "channel")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Components of embeddings as channels; the third one is dead in every fourth vector."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    part = F.floor(F.col("vec_id") / 8).alias("rec_id")
    return e.select(part, "vec_id", F.pmod("i", F.lit(4)).alias("channel"), F.when((F.pmod("i", F.lit(4)) == 3) & (F.pmod(F.floor(F.col("vec_id") / 8), F.lit(4)) == 0), 0.0).otherwise(F.col("x").cast("double")).alias("x"))


SAMPLES = "sm AS (SELECT vec_id // 8 AS rec_id, vec_id, i % 4 AS channel, CASE WHEN i % 4 = 3 AND (vec_id // 8) % 4 = 0 THEN 0 ELSE x::double END AS x FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings))"


@query("sg02_live", "WITH " + SAMPLES + " SELECT rec_id, channel, count(*) AS n, round(max(x), 6) AS high FROM sm WHERE (rec_id, channel) NOT IN (SELECT (rec_id, channel) FROM sm GROUP BY rec_id, channel HAVING min(x) = max(x)) GROUP BY 1, 2")
def live(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audits.live_channels(samples(spark, d), ["rec_id", "channel"], "x").groupBy("rec_id", "channel").agg(F.count("*").alias("n"), F.max("x").alias("high")))


@query("sg05_qc_summary", "WITH " + SAMPLES + ", q AS (SELECT rec_id, channel, avg((abs(x) < 0.2)::int) AS good FROM sm GROUP BY 1, 2) SELECT channel, count(*) AS n, count(*) FILTER (good >= 0.5) AS passed, round(quantile_cont(good, 0.25), 6) AS q25, round(quantile_cont(good, 0.5), 6) AS q50, round(quantile_cont(good, 0.75), 6) AS q75 FROM q GROUP BY 1")
def qc_summary(spark: SparkSession, d: str) -> DataFrame:
    q = samples(spark, d).groupBy("rec_id", "channel").agg(F.avg((F.abs("x") < 0.2).cast("double")).alias("good"))
    return rounded(audits.qc_summary(q, "channel", "good", 0.5))


@query("sg11_burden", "WITH " + EVENTS + ", s AS (SELECT entity_id AS rec_id, date_diff('microsecond', TIMESTAMP '2024-01-01', t_event) / 3.6e9 AS t, least(1, value / 50) AS p FROM ev WHERE value IS NOT NULL), w AS (SELECT DISTINCT entity_id AS rec_id, k AS \"window\", k * 240.0 AS lo, k * 240.0 + 240 AS hi FROM ev, range(3) r(k)) SELECT w.rec_id, \"window\", count(*) AS n, round(avg(p), 8) AS mean, round(quantile_cont(p, 0.9), 8) AS p90, round(avg((p >= 0.5)::int), 8) AS burden FROM s JOIN w ON s.rec_id = w.rec_id AND t >= lo AND t < hi GROUP BY 1, 2")
def burden(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    hours = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("t_event")) / F.lit(3.6e9)
    s = e.filter("value IS NOT NULL").select(F.col("entity_id").alias("rec_id"), hours.alias("t"), F.least(F.lit(1.0), F.col("value") / 50).alias("p"))
    w = e.select(F.col("entity_id").alias("rec_id")).distinct().select("rec_id", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("window"))
    return rounded(audits.burden(s, w.withColumns({"lo": F.col("window") * 240.0, "hi": F.col("window") * 240.0 + 240})), 8)


@query("sg12_segments", "WITH v AS (SELECT vec_id, list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND x >= -0.15 AND x <= 0.3) AS o, len(embedding) AS k FROM embeddings) SELECT vec_id, round(len(o) / k, 6) AS valid, round(list_sum(list_transform(o, lambda x: x::double)) / len(o), 6) AS pooled FROM v WHERE len(o) / k >= 0.8")
def segments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audits.valid_segments(table(spark, d, "embeddings"), "embedding", -0.15, 0.3, 0.8).select("vec_id", "valid", "pooled"))

"""Further registered queries: cohorts, derived rows, classes, strata, correlations, fold-wise models, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.functions.expressions import event_time, log_loss, logit
from tidegate.operators import cohort, derived, features, identity, ladder, metrics, signals, summaries
from tidegate.operators import deltas as deltas_of
from tidegate.plans.event_queries import MERGES, merges, rounded
from tidegate.plans.statistic_queries import LOSS
from tidegate.plans.tables import EVENTS, INDEX, PREDICTIONS, events, index, predictions, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


RULES = [("small", "o_totalprice >= 50000"), ("pending", "o_orderstatus <> 'P'"), ("early", "o_orderdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00'")]
REASON = "CASE WHEN NOT coalesce(o_totalprice >= 50000, false) THEN 'small' WHEN NOT coalesce(o_orderstatus <> 'P', false) THEN 'pending' WHEN NOT coalesce(o_orderdate >= TIMESTAMP '1996-01-01', false) THEN 'early' ELSE 'included' END"


@query("pf02_exclusion_chain", f"SELECT o_orderkey, {REASON} AS reason FROM orders")
def exclusion_chain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", cohort.reason(RULES).alias("reason"))


@query("st04_flow", f"""WITH o AS (SELECT o_orderpriority AS site, {REASON} AS r FROM orders), s AS (SELECT site, r FROM o UNION ALL SELECT NULL, r FROM o),
  c AS (SELECT site, r, count(*) AS n, sum(count(*)) OVER (PARTITION BY site) AS t FROM s GROUP BY 1, 2), k AS (SELECT *, CASE r WHEN 'small' THEN 1 WHEN 'pending' THEN 2 ELSE 3 END AS stage FROM c WHERE r <> 'included')
  SELECT site, stage, r AS step, n AS dropped, (t - sum(n) OVER (PARTITION BY site ORDER BY stage))::bigint AS remaining FROM k""")
def flow(spark: SparkSession, d: str) -> DataFrame:
    return cohort.flow(table(spark, d, "orders"), RULES, "o_orderpriority")


@query("pf06_plausible", "SELECT event_id, CASE WHEN event_type = 'click' AND value NOT BETWEEN 1 AND 100 THEN NULL WHEN event_type = 'view' AND value NOT BETWEEN 5 AND 60 THEN NULL ELSE value END AS value FROM events")
def plausible(spark: SparkSession, d: str) -> DataFrame:
    r = spark.createDataFrame([("click", 1.0, 100.0), ("view", 5.0, 60.0)], "item string, lo double, hi double")
    return cohort.plausible(table(spark, d, "events").select("event_id", F.col("event_type").alias("item"), "value"), r, drop=False).select("event_id", "value")


@query("jn01_first_match_left", "SELECT c_custkey, f.o_orderkey, coalesce(f.o_totalprice, 0) AS price FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) f ON f.o_custkey = c_custkey")
def first_match_left(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    first = table(spark, d, "orders").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(first, c["c_custkey"] == first["o_custkey"], "left").select("c_custkey", "o_orderkey", F.coalesce("o_totalprice", F.lit(0.0)).alias("price"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", "entity_id", F.to_date("t_event").cast("string").alias("day"), F.col("domain").alias("item"), "value")


DAILY = "dy AS (SELECT event_id, user_id AS entity_id, ts::date::varchar AS day, event_type AS item, value FROM events)"


@query("ev13_component_totals", "WITH " + DAILY + ", w AS (SELECT entity_id, day, min(value) FILTER (item = 'click') AS a, min(value) FILTER (item = 'view') AS b, min(value) FILTER (item = 'purchase') AS t FROM dy GROUP BY 1, 2) SELECT entity_id, day, round(coalesce(t, a + b), 6) AS value, t IS NULL AS derived FROM w WHERE coalesce(t, a + b) IS NOT NULL")
def component_totals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(derived.component_totals(daily(spark, d), ["entity_id", "day"], "item", "value", ["click", "view"], "purchase"))


@query("jn16_corrected", "WITH " + DAILY + " SELECT a.entity_id, a.day, round(greatest(x - coalesce(y / 2, 0), 0), 6) AS value FROM (SELECT entity_id, day, max(value) AS x FROM dy WHERE item = 'click' GROUP BY 1, 2) a LEFT JOIN (SELECT entity_id, day, max(value) AS y FROM dy WHERE item = 'error' GROUP BY 1, 2) b USING (entity_id, day)")
def corrected(spark: SparkSession, d: str) -> DataFrame:
    return rounded(derived.corrected(daily(spark, d), ["entity_id", "day"], "item", "value", "click", "error", 2.0))


@query("jn17_supported", "WITH " + DAILY + " SELECT event_id, item FROM dy WHERE item <> 'click' OR EXISTS (SELECT 1 FROM dy s WHERE s.item = 'error' AND s.entity_id = dy.entity_id AND s.day = dy.day)")
def supported(spark: SparkSession, d: str) -> DataFrame:
    return derived.supported(daily(spark, d), ["entity_id", "day"], "item", "click", "error").select("event_id", "item")


@query("ev09_pairs_in_text", "WITH t AS (SELECT p_partkey, p_size AS b, (p_partkey % 40)::int AS a FROM part WHERE (p_partkey % 40) BETWEEN 5 AND 200 AND p_size BETWEEN 5 AND 200 AND p_partkey % 40 > p_size) SELECT p_partkey, 'upper' AS item, a::double AS value FROM t UNION ALL SELECT p_partkey, 'lower', b::double FROM t")
def pairs_in_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("/", (F.col("p_partkey") % 40).cast("string"), F.col("p_size").cast("string")).alias("t"))
    return derived.pairs_in_text(p, "t", ("upper", "lower"), 5, 200)


@query("jn19_study_window", "WITH " + INDEX + " SELECT ix.entity_id, coalesce(bool_or(domain = 'error' AND value > 50), false) AS large_error, count(DISTINCT key) FILTER (domain = 'view') AS view_keys FROM ix LEFT JOIN ev ON ev.entity_id = ix.entity_id AND date_diff('day', t0::date, t_event::date) BETWEEN -1 AND 3 GROUP BY 1")
def study_window(spark: SparkSession, d: str) -> DataFrame:
    i = index(spark, d).select(F.col("entity_id").alias("e"), "t0")
    j = i.join(events(spark, d), (F.col("e") == F.col("entity_id")) & F.datediff("t_event", "t0").between(-1, 3), "left")
    large = F.coalesce(F.bool_or((F.col("domain") == "error") & (F.col("value") > 50)), F.lit(False))
    return j.groupBy(F.col("e").alias("entity_id")).agg(large.alias("large_error"), F.count_distinct(F.when(F.col("domain") == "view", F.col("key"))).alias("view_keys"))


@query("jn24_membership", "WITH " + MERGES + ", m AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') SELECT c_custkey, c_custkey IN (SELECT k FROM m) OR coalesce(c_custkey IN (SELECT survivor FROM mg JOIN m ON m.k = mg.old), false) AS member FROM customer")
def membership(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).distinct()
    old = m.join(identity.resolved(merges(spark, d)), F.col("k") == F.col("old")).select(F.col("survivor").alias("k"))
    every = m.union(old).distinct()
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(every, c["c_custkey"] == every["k"], "left").select("c_custkey", F.col("k").isNotNull().alias("member"))


@query("jn27_join_rates", "WITH k AS (SELECT c_mktsegment AS site, unnest([struct_pack(form := 'same', k := c_custkey), struct_pack(form := 'plus', k := c_custkey + 1000), struct_pack(form := 'tens', k := c_custkey * 10)], recursive := true) FROM customer) SELECT site, form, round(avg((k IN (SELECT o_custkey FROM orders))::int), 6) AS rate FROM k GROUP BY 1, 2")
def join_rates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").selectExpr("c_mktsegment AS site", "stack(3, 'same', c_custkey, 'plus', c_custkey + 1000, 'tens', c_custkey * 10) AS (form, k)")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("ok")).distinct()
    return rounded(c.join(o, c["k"] == o["ok"], "left").groupBy("site", "form").agg(F.avg(F.col("ok").isNotNull().cast("double")).alias("rate")))


@query("sf02_event_times", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN ts::date + INTERVAL '23:59:59.999999' HOUR TO SECOND ELSE ts END AS t FROM events".replace("ts::date + INTERVAL '23:59:59.999999' HOUR TO SECOND", "ts::date::timestamp + to_microseconds(86399999999)"))
def event_times(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", event_time(F.when(F.col("event_id") % 4 != 0, F.col("ts")), F.to_date("ts"), "end").alias("t"))


@query("sf05_qualitative", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'negative' WHEN 1 THEN 'pending' WHEN 2 THEN 'positive' WHEN 3 THEN 'negative' ELSE 'other' END AS status FROM orders")
def qualitative(spark: SparkSession, d: str) -> DataFrame:
    words = F.element_at(F.array(*map(F.lit, ("Not Detected", "in progress", "Growth of x", "NEGATIVE, was positive", "see note"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", derived.qualitative(words).alias("status"))


@query("ag15_class_shares", "SELECT site, cls, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY site), 6) AS share FROM (SELECT user_id % 3 AS site, event_type AS cls FROM events UNION ALL SELECT NULL, event_type FROM events) GROUP BY 1, 2")
def class_shares(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("site").cast("long").alias("site"), F.col("domain").alias("cls"))
    return rounded(summaries.class_shares(e, "site", "cls"))


@query("ag18_day_modes", """WITH h AS (SELECT user_id % 3 AS site, floor(value / 10)::bigint AS b FROM events), c AS (SELECT site, b, count(*) AS n, sum(count(*)) OVER (PARTITION BY site) AS t FROM h GROUP BY 1, 2)
  SELECT c.site, c.b AS bin, round(c.n / c.t, 6) AS share FROM c LEFT JOIN c p ON p.site = c.site AND p.b = c.b - 1 LEFT JOIN c q ON q.site = c.site AND q.b = c.b + 1 WHERE c.n / c.t > 0.05 AND c.n > coalesce(p.n, 0) AND c.n >= coalesce(q.n, 0)""")
def day_modes(spark: SparkSession, d: str) -> DataFrame:
    """Bins of ten of an event's value."""
    h = events(spark, d).select(F.col("site").cast("long").alias("site"), F.floor(F.col("value") / 10).alias("bin"))
    return rounded(summaries.modes(h, "site", "bin"))


@query("ag21_any_all", "SELECT o_orderpriority AS site, round(avg(any_r::int), 6) AS any_share, round(avg(all_r::int), 6) AS all_share FROM (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_r, bool_and(l_returnflag = 'R') AS all_r FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def any_all(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", F.col("o_orderpriority").alias("site"), "l_returnflag")
    return rounded(summaries.any_all_shares(j, "l_orderkey", "site", F.col("l_returnflag") == "R"))


@query("ag22_ratio_quartiles", "WITH r AS (SELECT l_linestatus AS s, l_extendedprice / l_quantity AS x FROM lineitem WHERE l_quantity > 0) SELECT s AS l_linestatus, count(x) AS n, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75 FROM r GROUP BY 1")
def ratio_quartiles(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").filter("l_quantity > 0").select("l_linestatus", (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    return rounded(features.quantiles(r, "l_linestatus", "x"))


@query("ag25_bands", "SELECT c_mktsegment AS site, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, count(*) AS n, round(avg((c_nationkey < 10)::int), 6) AS share FROM customer GROUP BY GROUPING SETS ((1, 2), (2))".replace("GROUPING SETS ((1, 2), (2))", "GROUPING SETS ((c_mktsegment, band), (band))"))
def bands(spark: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    return rounded(summaries.bands(table(spark, d, "customer").withColumnRenamed("c_mktsegment", "site"), "site", band, F.col("c_nationkey") < 10))


@query("tk05_one_per_code_day", "WITH " + DAILY + " SELECT entity_id, item, day, event_id FROM dy QUALIFY row_number() OVER (PARTITION BY entity_id, item, day ORDER BY event_id) = 1")
def one_per_code_day(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("entity_id", "item", "day").orderBy("event_id")
    return daily(spark, d).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("entity_id", "item", "day", "event_id")


@query("ag15_top_classes", "WITH " + EVENTS + ", t AS (SELECT key FROM ev WHERE key IS NOT NULL GROUP BY key ORDER BY count(*) DESC, key LIMIT 2), e AS (SELECT site::bigint AS site, CASE WHEN key IN (SELECT key FROM t) THEN key ELSE 'other' END AS cls FROM ev), g AS (SELECT site, cls, count(*) AS n FROM e GROUP BY GROUPING SETS ((site, cls), (cls))) SELECT site, cls, n, round(n / sum(n) OVER (PARTITION BY site), 6) AS share FROM g")
def top_class_shares(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("site").cast("long").alias("site"), F.col("key").alias("cls"))
    return rounded(summaries.top_class_shares(e, "site", "cls", 2))


@query("ag18_near_shares", "WITH o AS (SELECT l_returnflag AS site, (date_diff('day', o_orderdate, l_shipdate) - 60) * 24.0 AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT site, count(*) AS n, round(avg((abs(h) <= 24)::int), 6) AS within_24h, round(avg((abs(h) <= 72)::int), 6) AS within_72h FROM o WHERE h IS NOT NULL GROUP BY 1")
def near_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shipments around the sixtieth day after the order."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    h = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("l_returnflag").alias("site"), ((F.datediff("l_shipdate", "o_orderdate") - 60) * 24.0).alias("h"))
    return rounded(summaries.near_shares(h, "site", "h", {"within_24h": 24, "within_72h": 72}))


@query("tk04_over_labels", "WITH e AS (SELECT vec_id, label, i - 1 AS dim, embedding[i]::double AS x FROM embeddings, range(1, 65) t(i)), c AS (SELECT dim, greatest(abs(corr(x, (label >= 5)::int)), abs(corr(x, label % 2))) AS c FROM e GROUP BY 1), r AS (SELECT dim, round(c, 9) AS c FROM c), f AS (SELECT dim, c, row_number() OVER (ORDER BY c DESC, dim) AS k FROM r WHERE dim NOT IN (0, 7)) SELECT dim, round(c, 6) AS corr, k AS rank, false AS protected FROM f WHERE k <= 8 UNION ALL SELECT dim, round(c, 6), NULL, true FROM r WHERE dim IN (0, 7)")
def correlated_over_labels(spark: SparkSession, d: str) -> DataFrame:
    """Components by their highest correlation with either of two labels; two of them stay whatever theirs is."""
    e = table(spark, d, "embeddings").select(F.expr("stack(2, 'high', int(label >= 5), 'odd', int(label % 2)) AS (target, y)"), "embedding")
    e = e.select("target", "y", F.posexplode("embedding").alias("dim", "x")).withColumn("dim", F.col("dim").cast("long"))
    return rounded(summaries.top_correlated(e, "dim", "target", "x", "y", 8, ["0", "7"]))


@query("tk04_top_correlated", "WITH e AS (SELECT vec_id, (label >= 5)::int::double AS y, i - 1 AS dim, embedding[i]::double AS x FROM embeddings, range(1, 65) t(i)), c AS (SELECT dim, round(abs(corr(x, y)), 9) AS c FROM e GROUP BY 1) SELECT dim, round(c, 6) AS corr, row_number() OVER (ORDER BY c DESC, dim) AS rank FROM c QUALIFY row_number() OVER (ORDER BY c DESC, dim) <= 10")
def top_correlated(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select((F.col("label") >= 5).cast("double").alias("y"), F.lit("high").alias("target"), F.posexplode("embedding").alias("dim", "x"))
    top = summaries.top_correlated(e.withColumn("dim", F.col("dim").cast("long")), "dim", "target", "x", "y", 10)
    return top.select("dim", F.round("corr", 6).alias("corr"), "rank")


DELTAS = PREDICTIONS + ", dl AS (SELECT site, entity, avg(" + LOSS.format(p="p_b") + " - (" + LOSS.format(p="p_a") + ")) AS d FROM pr WHERE y IS NOT NULL GROUP BY 1, 2)"


def deltas(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("y").cast("double")
    p = predictions(spark, d).filter("y IS NOT NULL").withColumn("d", log_loss(y, F.col("p_b")) - log_loss(y, F.col("p_a")))
    return p.groupBy("site", "entity").agg(F.avg("d").alias("d"))


@query("mt03_every_site", "WITH " + DELTAS + " SELECT count(*) AS sites, bool_and(m < 0) AS every_site, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS se FROM (SELECT site, avg(d) AS m FROM dl GROUP BY 1)")
def every_site(spark: SparkSession, d: str) -> DataFrame:
    return rounded(deltas_of.over_sites(deltas(spark, d), "site", "d").drop("pooled"))


@query("mt10_strata", "WITH " + DELTAS + ", s AS (SELECT d, entity % 3 AS stratum FROM dl), m AS (SELECT stratum, count(*) AS n, avg(d) AS m FROM s GROUP BY 1) SELECT stratum, n, round(m, 6) AS delta, round(m - min_by(m, stratum) OVER (), 6) AS against_first FROM m".replace("min_by(m, stratum) OVER ()", "first_value(m) OVER (ORDER BY stratum)"))
def strata(spark: SparkSession, d: str) -> DataFrame:
    return rounded(deltas_of.by_stratum(deltas(spark, d).withColumn("stratum", F.col("entity") % 3), "stratum", "d"))


@query("mt13_label_order", "WITH " + PREDICTIONS + ", s AS (SELECT site, avg(p_a) AS a, avg(p_b) AS b FROM pr GROUP BY 1), p AS (SELECT sign(x.a - y.a) * sign(x.b - y.b) AS c FROM s x JOIN s y ON x.site < y.site) SELECT count(*) AS pairs, round(sum(c) / count(*), 6) AS tau FROM p")
def label_order(spark: SparkSession, d: str) -> DataFrame:
    """Concordance of two rankings of sites; the self-join is over one row for each site."""
    s = predictions(spark, d).groupBy("site").agg(F.avg("p_a").alias("a"), F.avg("p_b").alias("b"))
    t = s.select(F.col("site").alias("s2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    c = s.join(t, F.col("site") < F.col("s2")).select((F.signum(F.col("a") - F.col("a2")) * F.signum(F.col("b") - F.col("b2"))).alias("c"))
    return rounded(c.agg(F.count("*").alias("pairs"), (F.sum("c") / F.count("*")).alias("tau")))


@query("mt03_site_deltas", "WITH " + DELTAS + " SELECT site, count(*) AS n, round(avg(d), 6) AS delta FROM dl GROUP BY 1")
def site_deltas(spark: SparkSession, d: str) -> DataFrame:
    return rounded(deltas_of.by_site(deltas(spark, d), "site", "d"))


@query("mt10_rule")
def strata_rule(spark: SparkSession, d: str) -> DataFrame:
    """Gains in three strata with their intervals."""
    return rounded(deltas_of.strata_rule(deltas(spark, d).withColumn("stratum", F.col("entity") % 3), "stratum", "site", "entity", "d", replicates=500)[0])


@query("mt14_by_grade", "WITH " + DELTAS + ", g AS (SELECT entity % 4 AS x, d FROM dl), r AS (SELECT d, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2 AS b FROM g) SELECT round(avg(d) FILTER (x < 2), 6) AS light, round(avg(d) FILTER (x >= 2), 6) AS heavy, round(avg(d) FILTER (x >= 2) - avg(d) FILTER (x < 2), 6) AS difference, round(corr(a, b), 6) AS spearman FROM r")
def by_grade(spark: SparkSession, d: str) -> DataFrame:
    g = deltas(spark, d).withColumn("x", F.col("entity") % 4)
    return rounded(deltas_of.graded(g, "x", "d", "site", 2).select("light", "heavy", "difference", "spearman"))


@query("mt14_graded", "WITH " + DELTAS + ", g AS (SELECT site, d, (entity % 4)::double AS x FROM dl), c AS (SELECT x - avg(x) OVER (PARTITION BY site) AS x, d - avg(d) OVER (PARTITION BY site) AS d FROM g) SELECT round((SELECT regr_slope(d, x) FROM g), 6) AS slope, round((SELECT sum(x * d) / sum(x * x) FROM c), 6) AS within_site")
def graded(spark: SparkSession, d: str) -> DataFrame:
    g = deltas(spark, d).withColumn("x", F.col("entity") % 4)
    return rounded(deltas_of.graded(g, "x", "d", "site", 2).select("slope", "within_site"))


@query("mt17_logit_gap", "WITH " + PREDICTIONS + " SELECT label, round(avg(ln(p_b / (1 - p_b)) - ln(p_a / (1 - p_a))) FILTER (y = 1), 5) AS gap_pos, round(avg(ln(p_b / (1 - p_b)) - ln(p_a / (1 - p_a))) FILTER (y = 0), 5) AS gap_neg FROM (SELECT * REPLACE (least(greatest(p_a, 1e-6::double), 1 - 1e-6::double) AS p_a) FROM pr) GROUP BY 1")
def logit_gap(spark: SparkSession, d: str) -> DataFrame:
    g = predictions(spark, d).withColumn("g", logit(F.col("p_b")) - logit(F.col("p_a")))
    return rounded(g.groupBy("label").agg(F.avg(F.when(F.col("y") == 1, F.col("g"))).alias("gap_pos"), F.avg(F.when(F.col("y") == 0, F.col("g"))).alias("gap_neg")), 5)


@query("ml01_imputed", "WITH e AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE embedding[1]::double END AS x FROM embeddings), m AS (SELECT quantile_cont(x, 0.5) AS m FROM e WHERE vec_id % 2 = 0) SELECT vec_id, round(coalesce(x, m), 6) AS x, (x IS NULL)::int AS miss FROM e, m")
def imputed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.get("embedding", F.lit(0)).cast("double")).alias("x"))
    m = ladder.fitted(e.filter("vec_id % 2 = 0"), ["x"])["x"][0]
    return rounded(e.select("vec_id", F.coalesce("x", F.lit(m)).alias("x"), F.col("x").isNull().cast("int").alias("miss")))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    cols = [F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(8)]
    return table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 4).alias("fold"), (F.col("label") >= 5).cast("double").alias("y"), *cols)


@query("ml06_out_of_fold")
def out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ladder.out_of_fold(vectors(spark, d), [f"x{i}" for i in range(8)], "y", "fold", "vec_id"))


@query("ml07_fold_auroc")
def fold_auroc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.auroc(ladder.out_of_fold(vectors(spark, d), [f"x{i}" for i in range(8)], "y", "fold", "vec_id"), ["fold"]))


@query("ml08_concentration", "WITH " + DELTAS + ", g AS (SELECT site, greatest(0, -sum(d)) AS g FROM dl GROUP BY 1) SELECT count(*) AS sites, round(max(g) / nullif(sum(g), 0), 6) AS share FROM g")
def concentration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ladder.concentration(deltas(spark, d).withColumnRenamed("d", "delta"), "site"))


@query("ml09_permuted", "WITH r AS (SELECT doc_id, quality, quality % 2 AS g FROM labels), a AS (SELECT doc_id, doc_id % 3 AS s, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) AS k FROM labels), b AS (SELECT quality, doc_id % 3 AS s, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY ('0x' || substr(md5(concat_ws('|', '9', doc_id)), 1, 8))::bigint, doc_id) AS k FROM labels) SELECT doc_id, quality FROM a JOIN b USING (s, k)")
def permuted(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 3).alias("s"), "quality")
    return ladder.permuted(r, ["s"], "doc_id", "quality", 9).select("doc_id", "quality")


@query("ml11_roles", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY ('0x' || substr(md5(concat_ws('|', '2', doc_id)), 1, 8))::bigint, doc_id) <= round(count(*) OVER (PARTITION BY lang) * 0.3::double) THEN 'dev' ELSE 'eval' END AS role FROM documents")
def dev_roles(spark: SparkSession, d: str) -> DataFrame:
    return ladder.drawn_roles(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.3, 2).select("doc_id", "role")


def epochs(spark: SparkSession, d: str) -> DataFrame:
    """Ten vectors make a recording: its channels are the vectors, its epochs their eight stretches of eight samples."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("rec"), (F.col("vec_id") % 10).alias("ch"), F.col("embedding").cast("array<double>").alias("v"))
    return e.select("rec", "ch", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("epoch"), "v").select("rec", "ch", "epoch", F.slice("v", F.col("epoch") * 8 + 1, F.lit(8)).alias("x"))


EPOCHS = "ep AS (SELECT vec_id // 10 AS rec, vec_id % 10 AS ch, e::int AS epoch, list_transform(embedding[e * 8 + 1:e * 8 + 8], lambda v: v::double) AS x FROM embeddings, range(8) t(e)), fl AS (SELECT rec, ch, epoch, list_max(x) - list_min(x) < 0.2 AS flat, greatest(abs(list_max(x)), abs(list_min(x))) > 0.3 AS extreme, list_max(x) > list_min(x) AND len(list_filter(x, lambda v: v = list_max(x) OR v = list_min(x))) >= 4 AS clipped FROM ep)"


@query("sg03_epoch_flags", "WITH " + EPOCHS + " SELECT rec, ch, epoch, flat, extreme, clipped, flat OR extreme OR clipped AS bad FROM fl")
def epoch_flags(spark: SparkSession, d: str) -> DataFrame:
    return signals.epoch_flags(epochs(spark, d), 0.2, 0.3).drop("x")


@query("sg04_window_quality", "WITH " + EPOCHS + ", g AS (SELECT rec, epoch, count(*) FILTER (NOT (flat OR extreme OR clipped)) AS good FROM fl GROUP BY 1, 2), w AS (SELECT * FROM (VALUES ('first', 0, 4), ('all', 0, 8), ('late', 5, 8)) t(window_name, lo, hi)) SELECT rec, window_name AS \"window\", round(avg((good >= 6)::int), 6) AS usable, count(*) AS n, avg((good >= 6)::int) >= 0.6 AS ok FROM g JOIN w ON epoch >= lo AND epoch < hi GROUP BY 1, 2")
def window_quality(spark: SparkSession, d: str) -> DataFrame:
    w = spark.createDataFrame([("first", 0, 4), ("all", 0, 8), ("late", 5, 8)], "window string, lo int, hi int")
    return rounded(signals.window_quality(signals.epoch_flags(epochs(spark, d), 0.2, 0.3), w, 6, 0.6))


@query("sg06_onset", "WITH " + EPOCHS + ", r AS (SELECT rec, ch, epoch, sum((NOT flat)::int) OVER w AS l, count(*) OVER w AS n FROM fl WINDOW w AS (PARTITION BY rec, ch ORDER BY epoch ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)), o AS (SELECT rec, epoch FROM r WHERE n = 3 AND l >= 2 AND epoch % 2 = 0 GROUP BY 1, 2 HAVING count(*) >= 8) SELECT k.rec, min(o.epoch) AS onset FROM (SELECT DISTINCT rec FROM fl) k LEFT JOIN o USING (rec) GROUP BY 1")
def signal_onset(spark: SparkSession, d: str) -> DataFrame:
    return signals.onset(signals.epoch_flags(epochs(spark, d), 0.2, 0.3), 3, 2, 8, 2)


@query("sg07_average_reference", "WITH " + EPOCHS + ", s AS (SELECT ep.rec, ep.ch, ep.epoch * 8 + i - 1 AS t, x[i] AS x, flat OR extreme OR clipped AS bad FROM ep JOIN fl USING (rec, ch, epoch), range(1, 9) k(i)) SELECT rec, ch, t, round(x - avg(x) FILTER (NOT bad) OVER (PARTITION BY rec, t), 6) AS x FROM s")
def average_reference(spark: SparkSession, d: str) -> DataFrame:
    f = signals.epoch_flags(epochs(spark, d), 0.2, 0.3).select("rec", "ch", "epoch", "bad", F.posexplode("x").alias("i", "v"))
    return rounded(signals.average_reference(f.select("rec", "ch", (F.col("epoch") * 8 + F.col("i")).cast("long").alias("t"), F.col("v").alias("x"), "bad")))


PAIRS = [(f"{a}-{b}", a, b) for a, b in ((0, 1), (2, 3), (4, 5), (6, 7), (8, 9), (0, 9))]


@query("sg10_connectivity", "WITH " + EPOCHS + """, g AS (SELECT ep.rec, ep.ch, ep.epoch, x FROM ep JOIN fl USING (rec, ch, epoch) WHERE NOT (flat OR extreme OR clipped)),
  t AS (SELECT rec, ch, epoch, x[i + 1] - list_avg(x) AS v, i FROM g, range(8) r(i)),
  f AS (SELECT rec, ch, epoch, k, sum(v * cos(2 * pi() * k * i / 8)) AS re, -sum(v * sin(2 * pi() * k * i / 8)) AS im FROM t, range(5) q(k) GROUP BY 1, 2, 3, 4),
  p AS (SELECT * FROM (VALUES ('0-1', 0, 1), ('2-3', 2, 3), ('4-5', 4, 5), ('6-7', 6, 7), ('8-9', 8, 9), ('0-9', 0, 9)) p(pair, a, b)),
  c AS (SELECT x.rec, pair, x.k, x.re * y.re + x.im * y.im AS re, x.im * y.re - x.re * y.im AS im, x.re * x.re + x.im * x.im AS xx, y.re * y.re + y.im * y.im AS yy
    FROM f x JOIN p ON x.ch = a JOIN f y ON y.rec = x.rec AND y.epoch = x.epoch AND y.k = x.k AND y.ch = b),
  m AS (SELECT rec, pair, k, count(*) AS n, (avg(re) ** 2 + avg(im) ** 2) / greatest(avg(xx) * avg(yy), 1e-24) AS coh FROM c GROUP BY 1, 2, 3)
  SELECT rec, pair, band, max(n) AS segments, CASE WHEN max(n) >= 3 THEN round(avg(coh), 6) END AS coherence FROM m JOIN (VALUES ('low', 8, 17), ('high', 17, 33)) w(band, lo, hi) ON k * 8 >= lo AND k * 8 < hi GROUP BY 1, 2, 3""")
def connectivity(spark: SparkSession, d: str) -> DataFrame:
    got = signals.connectivity(signals.epoch_flags(epochs(spark, d), 0.2, 0.3), PAIRS, 64.0, {"low": (8, 17), "high": (17, 33)}, 3, taper=False)
    return rounded(got.select("rec", "pair", "band", "segments", "coherence"))


@query("sg10_pair_means")
def pair_means(spark: SparkSession, d: str) -> DataFrame:
    got = signals.connectivity(signals.epoch_flags(epochs(spark, d), 0.2, 0.3), PAIRS, 64.0, {"low": (8, 17), "high": (17, 33)}, 3)
    return rounded(signals.pair_means(got, {"near": [p for p, a, b in PAIRS if b - a == 1], "far": ["0-9"]}))


@query("sg08_spectra")
def spectra(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return rounded(signals.complexity(signals.spectra(e, 64.0)).drop("x"))

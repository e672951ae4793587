"""Registered queries on calibration lines, intervals of site means, gains, variants, gates and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.expressions import log_loss
from tidegate.operators import agreement, concordance, deltas, evidence, fits, inference, resample, selection, summaries, transport
from tidegate.plans.tables import PREDICTIONS, predictions, ratings, table

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


def loss(p: str) -> str:
    q = f"least(greatest({p}, 1e-6::double), 1 - 1e-6::double)"
    return f"(-(y * ln({q}) + (1 - y) * ln(1 - {q})))"


@query("mt09_calibration_line")
def calibration_line(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fits.calibration_line(predictions(spark, d), ["label"], p="p_b"))


#: The normal equations of n, x (early), z (p_a) and d, solved by hand: the coefficient of x beside z and a constant.
OLS = "((szz - sz * sz / n) * (sxd - sx * sd / n) - (sxz - sx * sz / n) * (szd - sz * sd / n)) / ((sxx - sx * sx / n) * (szz - sz * sz / n) - (sxz - sx * sz / n) * (sxz - sx * sz / n))"


@query("mt11_adjusted", "WITH " + PREDICTIONS + ", x AS (SELECT label, (entity % 3 = 0)::int::double AS x, p_a::double AS z, (" + loss("p_b") + " - " + loss("p_a") + ")::double AS d FROM pr WHERE y IS NOT NULL), s AS (SELECT label, count(*) AS n, sum(x) AS sx, sum(z) AS sz, sum(d) AS sd, sum(x * x) AS sxx, sum(x * z) AS sxz, sum(z * z) AS szz, sum(x * d) AS sxd, sum(z * d) AS szd FROM x GROUP BY label) SELECT label, n, sx::bigint AS n_early, n - sx::bigint AS n_late, round(" + OLS + ", 6) AS adjusted FROM s")
def adjusted(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d).withColumn("d", log_loss(F.col("y"), F.col("p_b")) - log_loss(F.col("y"), F.col("p_a")))
    return rounded(fits.adjusted_interaction(rows, ["label"], "d", "entity % 3 = 0", [F.col("p_a")]))


@query("mt17_shifts")
def shifts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fits.cross_shifts(predictions(spark, d), ["label"], "site", "y", "p_a"))


@query("mt05_site_mean")
def site_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d).filter("y IS NOT NULL AND site IS NOT NULL")
    by_site = rows.groupBy("site").agg(F.avg(log_loss(F.col("y"), F.col("p_b")) - log_loss(F.col("y"), F.col("p_a"))).alias("delta"))
    return rounded(inference.site_mean(by_site, "delta"))


@query("mt11_interaction", "WITH " + PREDICTIONS + ", x AS (SELECT label, entity, " + loss("p_b") + " - " + loss("p_a") + " AS d FROM pr WHERE y IS NOT NULL) SELECT label, count(*) FILTER (entity % 3 = 0) AS n_early, count(*) FILTER (entity % 3 <> 0) AS n_late, round(avg(d) FILTER (entity % 3 = 0) - avg(d) FILTER (entity % 3 <> 0), 6) AS difference FROM x GROUP BY 1")
def interaction(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d).withColumn("d", log_loss(F.col("y"), F.col("p_b")) - log_loss(F.col("y"), F.col("p_a")))
    return rounded(inference.interaction(rows, "d", "entity % 3 = 0", ["label"]))


@query("mt13_tau_b", "WITH " + PREDICTIONS + ", s AS (SELECT a.label, a.site AS g, sign(a.p_a - b.p_a) * sign(a.p_b - b.p_b) AS c, a.p_a <> b.p_a AS x, a.p_b <> b.p_b AS y FROM pr a JOIN pr b ON a.label = b.label AND a.site IS NOT DISTINCT FROM b.site AND a.entity < b.entity WHERE a.p_a IS NOT NULL AND b.p_a IS NOT NULL AND a.p_b IS NOT NULL AND b.p_b IS NOT NULL), k AS (SELECT label, site, count(*) AS n FROM pr WHERE p_a IS NOT NULL AND p_b IS NOT NULL GROUP BY 1, 2) SELECT k.label, k.site, k.n, round(sum(c) / (sqrt(count(*) FILTER (x)) * sqrt(count(*) FILTER (y))), 6) AS tau FROM k LEFT JOIN s ON s.label = k.label AND s.g IS NOT DISTINCT FROM k.site GROUP BY 1, 2, 3")
def tau_b(spark: SparkSession, d: str) -> DataFrame:
    return rounded(concordance.kendall(predictions(spark, d), ["label", "site"], "p_a", "p_b"))


@query("wn09_spearman", "WITH " + PREDICTIONS + ", r AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY p_a) + (count(*) OVER (PARTITION BY label, p_a) - 1) / 2 AS a, rank() OVER (PARTITION BY label ORDER BY p_b) + (count(*) OVER (PARTITION BY label, p_b) - 1) / 2 AS b FROM pr WHERE p_a IS NOT NULL AND p_b IS NOT NULL) SELECT label, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(concordance.spearman(predictions(spark, d), ["label"], "p_a", "p_b"))


@query("mt13_pairwise_auroc", "WITH " + PREDICTIONS + ", z AS (SELECT a.y, ln(greatest(least(a.p_b, 1 - 1e-6), 1e-6) / (1 - greatest(least(a.p_b, 1 - 1e-6), 1e-6))) - ln(greatest(least(b.p_a, 1 - 1e-6), 1e-6) / (1 - greatest(least(b.p_a, 1 - 1e-6), 1e-6))) AS s FROM pr a JOIN pr b USING (entity) WHERE a.label = 'toxic' AND b.label = 'quality' AND a.y <> b.y), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS k FROM z), t AS (SELECT sum(y) AS n1, count(*) - sum(y) AS n0, sum(k * y) AS s FROM r) SELECT 'toxic/quality' AS pair, n1::bigint AS n1, n0::bigint AS n0, round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auroc FROM t WHERE n1 + n0 > 0")
def pairwise(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d).withColumn("p", F.when(F.col("label") == "toxic", F.col("p_b")).otherwise(F.col("p_a")))
    return rounded(concordance.pairwise_auroc(rows, [("toxic", "quality")], "entity", "label", "y", "p"))


@query("ud01_kappa_interval")
def kappa_interval(spark: SparkSession, d: str) -> DataFrame:
    """Interval of two raters' kappa: cases drawn within sources."""
    r = ratings(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), "source"), "case_id")
    return rounded(resample.interval(resample.replicated(r, [], "source", "case_id", resample.kappa("a", "b"), seed=7), []))


@query("ud01_auroc_intervals")
def auroc_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Of each label: intervals of AUROC by two scores, entities drawn within sites."""
    rows = predictions(spark, d).filter("y IS NOT NULL AND p_a IS NOT NULL AND p_b IS NOT NULL")
    out = None
    for p in ("p_a", "p_b"):
        one = resample.interval(resample.replicated(rows, ["label"], "site", "entity", resample.auroc("y", p), seed=7), ["label"]).withColumn("score", F.lit(p))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("mt12_gain_ratio", "WITH w AS (SELECT l_quantity AS q, least(ceil(date_diff('day', o_orderdate, l_shipdate) / 30.0), 4)::bigint AS \"window\" FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate), g AS (SELECT \"window\", avg(q) - 20 AS gain FROM w GROUP BY 1), r AS (SELECT *, gain / (SELECT gain FROM g WHERE \"window\" = 4) AS ratio FROM g) SELECT \"window\", round(gain, 6) AS gain, round(ratio, 6) AS ratio, \"window\" = (SELECT min(\"window\") FROM r WHERE ratio >= 0.9) AS first FROM r")
def gain_ratio(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).filter("l_shipdate > o_orderdate")
    w = j.select((F.col("l_quantity") - 20).alias("delta"), F.least(F.ceil(F.datediff("l_shipdate", "o_orderdate") / 30.0), F.lit(4)).cast("long").alias("window"))
    return rounded(inference.gain_ratio(w, "window", "delta", 4, 0.9))


@query("mt16_variant_gap", "WITH " + PREDICTIONS + ", x AS (SELECT site, label, entity, " + loss("p_b") + " - " + loss("p_a") + " AS g FROM pr WHERE y IS NOT NULL) SELECT site, label, count(*) AS n, round(avg(g), 6) AS gap, count(*) FILTER (entity % 4 <> 1) AS n_clean, round(avg(g) FILTER (entity % 4 <> 1), 6) AS gap_clean FROM x GROUP BY 1, 2")
def variant_gap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.variant_gap(predictions(spark, d), "p_b", "p_a", "y", "entity % 4 = 1", ["site", "label"]))


KAPPA = "CASE WHEN c < 1 THEN round((agree - c) / (1 - c), 6) END AS kappa, coalesce((agree - c) / (1 - c) < 0.6, false) AS low"


@query("mt19_circularity", "WITH " + PREDICTIONS + ", s AS (SELECT label, count(*) AS n, avg((y = (p_b > 0.5)::int)::int) AS with_label, avg(((p_a > 0.5) = (p_b > 0.5))::int) AS with_comparator FROM pr WHERE y IS NOT NULL GROUP BY 1) SELECT label, n, round(with_label, 6) AS with_label, round(with_comparator, 6) AS with_comparator, round(with_label - with_comparator, 6) AS difference, with_label > 0.95 AS leak FROM s")
def circularity(spark: SparkSession, d: str) -> DataFrame:
    """How often a model agrees with the label, and with a comparator that isn't one; near-perfect agreement with the label is a leak."""
    hit = F.col("p_b") > 0.5
    s = predictions(spark, d).filter("y IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("y") == hit.cast("int")).cast("double")).alias("with_label"), F.avg(((F.col("p_a") > 0.5) == hit).cast("double")).alias("with_comparator"))
    return rounded(s.select("label", "n", "with_label", "with_comparator", (F.col("with_label") - F.col("with_comparator")).alias("difference"), (F.col("with_label") > 0.95).alias("leak")))


@query("mt21_gates", "WITH p AS (SELECT lang AS family, source, avg(quality) AS prevalence, avg((quality = (n_chars > 1500)::int)::int) AS kappa FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2), g AS (SELECT family, count(*) AS labels, count(*) FILTER (kappa >= 0.6 AND prevalence >= 0.1) AS passing FROM p GROUP BY 1) SELECT *, 2 * passing >= labels AS \"primary\" FROM g")
def gates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    p = rows.groupBy(F.col("lang").alias("family"), "source").agg(F.avg("quality").alias("prevalence"), F.avg((F.col("quality") == (F.col("n_chars") > 1500).cast("int")).cast("double")).alias("kappa"))
    return inference.gates(p, "family", "kappa", "prevalence")


@query("mt23_text_agreement", r"WITH x AS (SELECT role, lower(coalesce(text, '')) AS t FROM conversations), f AS (SELECT role, regexp_matches(t, 'the') AND NOT regexp_matches(t, '(^| )no( |$)') AS a, regexp_matches(t, 'th') AND NOT regexp_matches(t, '(^| )no( |$)') AS b, regexp_matches(t, 'le') AS c, regexp_matches(t, 'la') AS e FROM x), s AS (SELECT role, 'english' AS pair, count(*) AS n, count(*) FILTER (a AND b) AS k, count(*) FILTER (a) AS a1, count(*) FILTER (b) AS b1, count(*) FILTER (NOT a AND NOT b) AS z FROM f GROUP BY 1 UNION ALL SELECT role, 'french', count(*), count(*) FILTER (c AND e), count(*) FILTER (c), count(*) FILTER (e), count(*) FILTER (NOT c AND NOT e) FROM f GROUP BY 1), m AS (SELECT *, (k + z) / n AS agree, (a1 * b1 + (n - a1) * (n - b1)) / (n * n) AS c FROM s) SELECT role, pair, n, round(agree, 6) AS agree, " + KAPPA + " FROM m")
def text_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Two readings of the same texts, one narrower than the other."""
    c = table(spark, d, "conversations")
    kind = lambda x: evidence.finding(F.col("text"), x, None, "(^| )no( |$)", "$^", "$^") == "positive"
    low = F.lower(F.coalesce("text", F.lit("")))
    return rounded(inference.kappas(c, {"english": (kind("the"), kind("th")), "french": (low.rlike("le"), low.rlike("la"))}, ["role"]))


@query("mt24_variants", "WITH b AS (SELECT o_custkey AS entity_id, o_orderdate AS t, o_totalprice > 300000 AS y, o_orderstatus = 'P' AS unclear FROM orders), v AS (SELECT 'main' AS variant, entity_id, bool_or(y AND NOT unclear) AS y FROM b GROUP BY 2 UNION ALL SELECT 'unclear_positive', entity_id, bool_or(y OR unclear) FROM b GROUP BY 2 UNION ALL SELECT 'recent', entity_id, bool_or(y AND NOT unclear) FROM b WHERE t >= TIMESTAMP '2000-01-01' GROUP BY 2 UNION ALL SELECT 'first', entity_id, arg_min(y, t) FROM (SELECT entity_id, t, bool_or(y) AS y FROM b GROUP BY 1, 2) GROUP BY 2) SELECT variant, count(*) AS n, count(*) FILTER (y) AS positive FROM v GROUP BY 1")
def variants(spark: SparkSession, d: str) -> DataFrame:
    """One label under other windows and readings of what is unclear."""
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("t"), (F.col("o_totalprice") > 300000).alias("y"), (F.col("o_orderstatus") == "P").alias("unclear"))
    sure = F.col("y") & ~F.col("unclear")
    recent = F.bool_or(F.when(F.col("t") >= F.lit("2000-01-01").cast("timestamp_ntz"), sure))
    first = F.min_by("y", F.struct("t", (~F.col("y")).alias("n")))
    return deltas.variants(b, "entity_id", {"main": F.bool_or(sure), "unclear_positive": F.bool_or(F.col("y") | F.col("unclear")), "recent": recent, "first": first})


RATED = "rg AS (SELECT l_orderkey AS case_id, l_returnflag AS label, l_suppkey % 4 AS rater, (max(l_quantity) > 25)::int AS v FROM lineitem GROUP BY 1, 2, 3)"


def rated(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as raters of orders, by return flag."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("label"), (F.col("l_suppkey") % 4).alias("rater")).agg((F.max("l_quantity") > 25).cast("int").alias("v"))


@query("sa07_fleiss", "WITH " + RATED + ", e AS (SELECT label, case_id, count(*) AS m, sum(v)::bigint AS k FROM rg GROUP BY 1, 2 HAVING count(*) > 1), c AS (SELECT label, m, count(*) AS c FROM e GROUP BY 1, 2), u AS (SELECT label, m FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY c DESC, m DESC) = 1), s AS (SELECT label, count(*) AS cases, avg((k * (k - 1) + (m - k) * (m - k - 1)) / (m * (m - 1))) AS o, sum(k) / sum(m) AS p FROM e JOIN u USING (label, m) GROUP BY 1) SELECT label, cases, CASE WHEN p * p + (1 - p) * (1 - p) < 1 THEN round((o - p * p - (1 - p) * (1 - p)) / (1 - p * p - (1 - p) * (1 - p)), 6) END AS kappa FROM s")
def fleiss(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.fleiss(rated(spark, d), "label", "case_id", "v"))


@query("sa08_rater_pairs", "WITH " + RATED + " SELECT x.label, x.rater AS a, y.rater AS b, count(*) AS n, round(avg((x.v = y.v)::int), 6) AS agree FROM rg x JOIN rg y ON x.case_id = y.case_id AND x.label = y.label AND x.rater < y.rater GROUP BY ALL")
def rater_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.rater_pairs(rated(spark, d), "case_id", "label", "rater", "v"))


@query("sa11_forms", "WITH f AS (SELECT conv_id, count(DISTINCT role) AS roles, count(*) AS turns, bool_or(role = 'system') AS opened, max(turn) + 1 AS claimed, sum(length(coalesce(text, ''))) / 1000.0 AS minutes FROM conversations GROUP BY 1) SELECT count(*) AS forms, count(*) FILTER (turns = claimed) AS consistent, count(*) FILTER (opened) AS unblinded, count(*) FILTER (roles > 1) AS complete, round(quantile_cont(minutes, 0.25), 6) AS q25, round(quantile_cont(minutes, 0.5), 6) AS q50, round(quantile_cont(minutes, 0.75), 6) AS q75 FROM f")
def forms(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as forms: consistent if all turns are there, unblinded if a system turn tells the case."""
    f = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_distinct("role").alias("roles"), F.count("*").alias("turns"), F.bool_or(F.col("role") == "system").alias("opened"), (F.max("turn") + 1).alias("claimed"), (F.sum(F.length(F.coalesce("text", F.lit("")))) / 1000.0).alias("minutes"))
    return rounded(summaries.form_checks(f, {"consistent": F.col("turns") == F.col("claimed"), "unblinded": F.col("opened"), "complete": F.col("roles") > 1}, "minutes"))


@query("sa05_vitals", "WITH v AS (SELECT user_id AS case_id, event_type AS item, floor(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 3.6e9 / 72)::bigint AS bin, value FROM events WHERE value IS NOT NULL) SELECT case_id, item, bin, count(*) AS n, round(median(value), 6) AS median, min(value) AS low, max(value) AS high FROM v GROUP BY 1, 2, 3")
def vitals(spark: SparkSession, d: str) -> DataFrame:
    """Values of a case in bins of three days."""
    hours = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")) / F.lit(3.6e9)
    rows = table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("item"), "ts", "value")
    return rounded(summaries.binned_values(rows, "case_id", "item", hours, "value", 72))


@query("mt20_weights")
def transport_weights(spark: SparkSession, d: str) -> DataFrame:
    """Toxic documents as the target domain: cross-fitted scores, and weights of all other labelled documents."""
    rows = predictions(spark, d).filter("label = 'toxic' AND y IS NOT NULL").join(table(spark, d, "documents").select(F.col("doc_id").alias("entity"), "n_chars"), "entity")
    scored, _ = transport.domain_scores(rows, ["n_chars", "p_b"], "y", "site", "entity")
    return rounded(transport.inverse_odds(scored, "y", "p").select("entity", "y", "fold", "p", "raw", "w", "trimmed"))


@query("mt20_balance", "WITH " + PREDICTIONS + """, r AS (SELECT p.*, n_chars::double AS n_chars FROM pr p JOIN documents ON doc_id = entity WHERE label = 'toxic' AND y IS NOT NULL),
  q AS (SELECT *, greatest(1e-3, least(1 - 1e-3, p_b)) AS c, (SELECT avg(y) FROM r) AS pi FROM r), o AS (SELECT *, c / (1 - c) / (pi / (1 - pi)) AS raw FROM q),
  b AS (SELECT quantile_cont(raw, 0.01) AS lo, quantile_cont(raw, 0.99) AS hi FROM o WHERE y = 0),
  w AS (SELECT y, n_chars, p_a, CASE WHEN y = 1 THEN 1 ELSE greatest(lo, least(hi, raw)) END AS w FROM o, b),
  l AS (SELECT y, w, unnest(['n_chars', 'p_a']) AS covariate, unnest([n_chars, p_a]) AS x FROM w),
  m AS (SELECT covariate, avg(x) FILTER (y = 1) AS a, var_pop(x) FILTER (y = 1) AS va, avg(x) FILTER (y = 0) AS b, var_pop(x) FILTER (y = 0) AS vb,
    sum(w * x) FILTER (y = 0) / sum(w) FILTER (y = 0) AS c, sum(w * x * x) FILTER (y = 0) / sum(w) FILTER (y = 0) AS c2 FROM l GROUP BY 1)
  SELECT covariate, round((a - b) / sqrt((va + vb) / 2), 6) AS smd_before, round((a - c) / sqrt((va + c2 - c * c) / 2), 6) AS smd_after FROM m""")
def transport_balance(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d).filter("label = 'toxic' AND y IS NOT NULL").join(table(spark, d, "documents").select(F.col("doc_id").alias("entity"), "n_chars"), "entity")
    return rounded(transport.balance(transport.inverse_odds(rows, "y", "p_b"), ["n_chars", "p_a"], "y"))


def components(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings with all 64 components as columns, a fold, and two labels."""
    cols = [F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(64)]
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("entity"), (F.col("vec_id") % 4).alias("fold"), F.expr("stack(2, 'high', int(label >= 5), 'odd', int(label % 2)) AS (target, y)"), *cols)


@query("ml05_selected")
def selected(spark: SparkSession, d: str) -> DataFrame:
    """Penalty and scale of the second half of the components, by the loss on a quarter of the rows; the last quarter isn't read."""
    rows = components(spark, d)
    names = [f"x{i}" for i in range(64)]
    return rounded(selection.select_penalty(rows.filter("fold < 2"), rows.filter("fold = 2"), "target", "y", "entity", names, names[32:], (0.01, 0.1, 1.0), (0.5, 1.0)))


@query("ml12_channels")
def channels(spark: SparkSession, d: str) -> DataFrame:
    """Eight channels of eight components each: four of them for each fold, from the other folds' rows."""
    groups = {f"c{g}": [f"x{i}" for i in range(8 * g, 8 * g + 8)] for g in range(8)}
    return rounded(selection.forward_channels(components(spark, d).filter("target = 'high'"), groups, "y", "fold", "entity", 4))


@query("sa07_categorical", "WITH x AS (SELECT l_returnflag AS flag, l_linenumber % 3 AS a, l_quantity::int % 3 AS b FROM lineitem), n AS (SELECT flag, count(*) AS n, avg((a = b)::int) AS o FROM x GROUP BY 1), p AS (SELECT flag, c, count(*) FILTER (a = c) AS i, count(*) FILTER (b = c) AS j FROM x, range(3) r(c) GROUP BY 1, 2), e AS (SELECT flag, sum(i * j) AS e FROM p GROUP BY 1) SELECT flag, n, round(o, 6) AS agree, round((o - e / n / n) / (1 - e / n / n), 6) AS kappa FROM n JOIN e USING (flag)")
def categorical(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_linenumber") % 3).cast("int").alias("a"), (F.col("l_quantity").cast("int") % 3).alias("b"))
    return rounded(agreement.categorical_kappa(rows, ["flag"], "a", "b"))


#: Kappa of the zeros and ones of pairs (x, y) by some columns.
PAIR_KAPPA = "count(*) AS n, round(avg((x = y)::int), 6) AS agree, CASE WHEN avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) < 1 THEN round((avg((x = y)::int) - avg(x) * avg(y) - (1 - avg(x)) * (1 - avg(y))) / (1 - avg(x) * avg(y) - (1 - avg(x)) * (1 - avg(y))), 6) END AS kappa"


@query("sa08_pair_kappas", "WITH " + RATED + ", p AS (SELECT s.label, s.rater AS a, t.rater AS b, s.v AS x, t.v AS y FROM rg s JOIN rg t ON s.case_id = t.case_id AND s.label = t.label AND s.rater < t.rater) SELECT label, a, b, " + PAIR_KAPPA + " FROM p GROUP BY 1, 2, 3")
def pair_kappas(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.pair_kappas(rated(spark, d), "case_id", "label", "rater", "v"))


@query("sa08_intrarater", "WITH " + RATED + ", p AS (SELECT s.label, s.rater, s.v AS x, t.v AS y FROM rg s JOIN rg t ON t.case_id = s.case_id + 1 AND s.label = t.label AND s.rater = t.rater WHERE s.case_id % 10 < 5) SELECT label, rater, " + PAIR_KAPPA + " FROM p GROUP BY 1, 2")
def intrarater(spark: SparkSession, d: str) -> DataFrame:
    """Half of the orders were shown again, as the next one."""
    r = rated(spark, d)
    again = table(spark, d, "orders").filter("o_orderkey % 10 < 5").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderkey") + 1).alias("copy"))
    return rounded(agreement.intrarater(r, again, "case_id", "label", "rater", "v"))


@query("sa01_waterfill")
def waterfill(spark: SparkSession, d: str) -> DataFrame:
    """Three hundred cases over sources in proportion to the square roots of their sizes, never more than a source has."""
    cells = table(spark, d, "documents").filter("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("cap"), F.sqrt(F.count("*")).alias("share"))
    return agreement.waterfilled(cells, "source", "cap", "share", 300)


@query("sa12_report")
def agreement_report(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("stratum"), (1.0 + F.col("o_orderkey") % 3).alias("weight"))
    return rounded(agreement.report(rated(spark, d), cases, (0, 1), "case_id", "label", "rater", "v", "stratum", "weight", 500, 3))


@query("sa12_disputes", "WITH " + RATED + " SELECT case_id, string_agg(label, ', ' ORDER BY label) AS labels FROM (SELECT case_id, label FROM rg WHERE rater IN (0, 1) GROUP BY 1, 2 HAVING count(*) = 2 AND min(v) <> max(v)) GROUP BY 1")
def disputes(spark: SparkSession, d: str) -> DataFrame:
    return agreement.disputes(rated(spark, d), 0, 1, "case_id", "label", "rater", "v")


@query("mt19_audit")
def circularity_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d).withColumn("comparator", (F.col("p_a") > 0.5).cast("int"))
    return rounded(agreement.circularity(rows, "label", "entity", "p_b", "comparator", "y", 500, 3))

"""Registered queries on metrics, agreement, sampling, disclosure, sources, text and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions import text
from tidegate.functions.expressions import log_loss, portable_hash
from tidegate.operators import disclose, metrics, sampling, signals
from tidegate.plans.event_queries import rounded
from tidegate.plans.tables import PREDICTIONS, RATINGS, predictions, ratings, table
from tidegate.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


LOSS = "-(y * ln(least(greatest({p}, 1e-6::double), 1 - 1e-6::double)) + (1 - y) * ln(1 - least(greatest({p}, 1e-6::double), 1 - 1e-6::double)))"


@query("mt01_entity_loss", "WITH " + PREDICTIONS + " SELECT site, round(avg(l), 6) AS loss, count(*) AS n FROM (SELECT site, entity, avg(" + LOSS.format(p="p_b") + ") AS l FROM pr WHERE y IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def entity_loss(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.entity_loss(predictions(spark, d).withColumn("p", F.col("p_b")), ["site"]))


@query("mt02_paired_delta", "WITH " + PREDICTIONS + ", x AS (SELECT site, entity, avg(" + LOSS.format(p="p_b") + " - (" + LOSS.format(p="p_a") + ")) AS d FROM pr WHERE y IS NOT NULL GROUP BY 1, 2) SELECT site, round(avg(d), 6) AS delta, count(*) AS n, count(*) FILTER (d < 0) AS better FROM x GROUP BY ROLLUP (site)")
def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.paired_delta(predictions(spark, d), "site"))


@query("mt07_auroc", "WITH " + PREDICTIONS + """, r AS (SELECT site, label, y, rank() OVER w + (count(*) OVER (PARTITION BY site, label, p_b) - 1) / 2.0 AS k FROM pr WHERE y IS NOT NULL WINDOW w AS (PARTITION BY site, label ORDER BY p_b)),
  s AS (SELECT site, label, sum(y)::bigint AS n1, (count(*) - sum(y))::bigint AS n0, sum(k * y) AS s FROM r GROUP BY 1, 2) SELECT site, label, n1, n0, CASE WHEN n1 > 0 AND n0 > 0 THEN round((s - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) END AS auroc FROM s""")
def auroc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.auroc(predictions(spark, d).withColumn("p", F.col("p_b")), ["site", "label"]))


@query("mt08_calibration", "WITH " + PREDICTIONS + ", c AS (SELECT label, least(floor(p_b * 10), 9) AS bin, count(*) AS n, sum(y) AS sy, sum(p_b) AS sp, sum((y - p_b) * (y - p_b)) AS se FROM pr WHERE y IS NOT NULL GROUP BY 1, 2) SELECT label, sum(n)::bigint AS n, round(sum(se) / sum(n), 6) AS brier, round(sum(sy) / sum(sp), 6) AS observed_expected, round(sum(abs(sy - sp)) / sum(n), 6) AS ece FROM c GROUP BY 1")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.calibration(predictions(spark, d).withColumn("p", F.col("p_b")), ["label"], 10))


@query("mt04_bootstrap", "WITH " + PREDICTIONS + """, x AS (SELECT site, entity, avg(y) AS v FROM pr WHERE y IS NOT NULL AND label = 'quality' GROUP BY 1, 2),
  n AS (SELECT site, v, row_number() OVER (PARTITION BY site ORDER BY entity) - 1 AS row, count(*) OVER (PARTITION BY site) AS n FROM x),
  s AS (SELECT site, rep, ('0x' || substr(md5(concat_ws('|', '7', rep, site, row)), 1, 8))::bigint % n AS row FROM n, range(2000) t(rep))
  SELECT rep, round(avg(n.v), 6) AS mean FROM s JOIN n USING (site, row) GROUP BY 1""")
def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    v = predictions(spark, d).filter("y IS NOT NULL AND label = 'quality'").select("site", "entity", F.col("y").cast("double").alias("v"))
    return rounded(metrics.bootstrap_means(v, "site", "v", metrics.REPLICATES, 7))


@query("mt06_interval", "WITH " + PREDICTIONS + """, x AS (SELECT site, entity, y - 0.8::double AS v FROM pr WHERE y IS NOT NULL AND label = 'quality'),
  n AS (SELECT site, v, row_number() OVER (PARTITION BY site ORDER BY entity) - 1 AS row, count(*) OVER (PARTITION BY site) AS n FROM x),
  s AS (SELECT site, rep, ('0x' || substr(md5(concat_ws('|', '7', rep, site, row)), 1, 8))::bigint % n AS row FROM n, range(2000) t(rep)), m AS (SELECT rep, avg(n.v) AS mean FROM s JOIN n USING (site, row) GROUP BY 1)
  SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, round((count(*) FILTER (mean >= 0) + 1) / (count(*) + 1), 6) AS p FROM m""")
def interval(spark: SparkSession, d: str) -> DataFrame:
    v = predictions(spark, d).filter("y IS NOT NULL AND label = 'quality'").select("site", "entity", (F.col("y") - F.lit(0.8)).alias("v"))
    return rounded(metrics.percentile_interval(metrics.bootstrap_means(v, "site", "v", metrics.REPLICATES, 7)))


@query("mt04_modes")
def interval_modes(spark: SparkSession, d: str) -> DataFrame:
    v = predictions(spark, d).filter("y IS NOT NULL AND label = 'quality'").select("site", "entity", (F.col("y") - F.lit(0.8)).alias("v"))
    means = metrics.bootstrap_modes(v, "site", "v", metrics.REPLICATES, 7)
    each = [metrics.percentile_interval(means[m]).select(F.lit(m).alias("mode"), "*") for m in metrics.MODES]
    return rounded(each[0].unionByName(each[1]).unionByName(each[2]))


@query("mt06_holm", "WITH t AS (SELECT event_type AS name, (1 + count(*) FILTER (value > 90)) / (1 + count(*)) AS p FROM events GROUP BY 1) SELECT name, round(p, 6) AS p, round(least(1, max(s) OVER (ORDER BY p, name)), 6) AS adjusted FROM (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p AS s FROM t)")
def holm(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(((F.count(F.when(F.col("value") > 90, 1)) + 1) / (F.count("*") + 1)).alias("p"))
    return rounded(metrics.holm(t))


@query("mt15_drift", "SELECT lang AS site, doc_id % 5 = 0 AS test, count(quality) AS n, round(avg(quality), 6) AS prevalence FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang, doc_id % 5 = 0), (doc_id % 5 = 0))")
def drift(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("lang").alias("site"), (F.col("doc_id") % 5 == 0).alias("test"), "quality")
    g = j.groupingSets([[F.col("site"), F.col("test")], [F.col("test")]], "site", "test").agg(F.count("quality").alias("n"), F.avg("quality").alias("prevalence"))
    return rounded(g.select("site", "test", "n", "prevalence"))


@query("mt18_confusion", "WITH " + RATINGS + ", c AS (SELECT count(*) FILTER (a = 1 AND b = 1) AS tp, count(*) FILTER (a = 0 AND b = 1) AS fp, count(*) FILTER (a = 1 AND b = 0) AS fn, count(*) FILTER (a = 0 AND b = 0) AS tn FROM rt) SELECT *, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(tp / (tp + fp), 6) AS ppv, round(tn / (tn + fn), 6) AS npv FROM c")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.confusion(ratings(spark, d), [], "a", "b"))


KAPPA = """SELECT n, round((po - pe) / (1 - pe), 6) AS kappa, round(2 * po - 1, 6) AS pabak, round((n11 - n00) / n, 6) AS prevalence, round((n10 - n01) / n, 6) AS bias FROM (SELECT *, (n00 + n11) / n AS po, ((n11 + n10) * (n11 + n01) + (n00 + n01) * (n00 + n10)) / (n * n) AS pe
  FROM (SELECT *, n00 + n01 + n10 + n11 AS n FROM (SELECT coalesce(sum(w) FILTER (a = 0 AND b = 0), 0) AS n00, coalesce(sum(w) FILTER (a = 0 AND b = 1), 0) AS n01, coalesce(sum(w) FILTER (a = 1 AND b = 0), 0) AS n10, coalesce(sum(w) FILTER (a = 1 AND b = 1), 0) AS n11 FROM rt)))"""


@query("sa06_kappa", "WITH " + RATINGS + " " + KAPPA)
def kappa(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.kappa(ratings(spark, d), [], "a", "b", "w"))


@query("sa07_weighted_kappa", "WITH x AS (SELECT (length(text) % 4)::int AS a, ((length(text) + (doc_id % 5 = 0)::int) % 4)::int AS b FROM documents WHERE text IS NOT NULL), n AS (SELECT a, b, count(*) AS n FROM x GROUP BY 1, 2), r AS (SELECT a, sum(n) AS ra FROM n GROUP BY 1), c AS (SELECT b, sum(n) AS cb FROM n GROUP BY 1) SELECT t.total::bigint AS total, round(1 - t.s * t.total / e.e, 6) AS kappa FROM (SELECT sum(n) AS total, sum(pow(abs(a - b) / 3, 2) * n) AS s FROM n) t, (SELECT sum(pow(abs(a - b) / 3, 2) * ra * cb) AS e FROM r, c) e")
def weighted_kappa(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").filter("text IS NOT NULL").select((F.length("text") % 4).alias("a"), ((F.length("text") + (F.col("doc_id") % 5 == 0).cast("int")) % 4).alias("b"))
    return rounded(metrics.weighted_kappa(x, "a", "b", 4, 2))


@query("sa09_consensus", "WITH x AS (SELECT doc_id AS case_id, quality AS y, 1 AS r FROM labels UNION ALL SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END, 2 FROM labels UNION ALL SELECT doc_id, 1, 3 FROM labels WHERE doc_id % 14 = 0), c AS (SELECT case_id, count(*) FILTER (y = 1) AS yes, count(*) FILTER (y = 0) AS no FROM x GROUP BY 1), s AS (SELECT *, CASE WHEN yes + no < 2 THEN 'pending' WHEN yes = 0 OR no = 0 THEN 'agreed' WHEN yes = no THEN 'pending' ELSE 'majority' END AS status FROM c) SELECT case_id, status, CASE WHEN status <> 'pending' THEN (yes > no)::int END AS y FROM s")
def consensus(spark: SparkSession, d: str) -> DataFrame:
    r = ratings(spark, d)
    long = r.select("case_id", F.lit("one").alias("rater"), F.col("a").alias("y")).unionByName(r.select("case_id", F.lit("two").alias("rater"), F.col("b").alias("y")))
    third = r.filter("case_id % 14 = 0").select("case_id", F.lit("three").alias("rater"), F.lit(1).alias("y"))
    return sampling.consensus(long.unionByName(third))


ALLOCATED = "sz AS (SELECT lang, count(*) AS size FROM documents WHERE lang IS NOT NULL GROUP BY 1), q AS (SELECT *, 100 * size / sum(size) OVER () AS quota FROM sz), al AS (SELECT lang, size, least(size, floor(quota) + CASE WHEN row_number() OVER (ORDER BY round(quota - floor(quota), 9) DESC, lang) <= 100 - sum(floor(quota)) OVER () THEN 1 ELSE 0 END)::bigint AS take FROM q)"


@query("sa01_allocation", "WITH " + ALLOCATED + " SELECT * FROM al")
def allocation(spark: SparkSession, d: str) -> DataFrame:
    return sampling.allocated(table(spark, d, "documents").filter("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("size")), "lang", 100)


DRAWN = ALLOCATED + ", dr AS (SELECT doc_id, lang, size, take FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY ('0x' || substr(md5(concat_ws('|', '5', doc_id)), 1, 8))::bigint, doc_id) AS r FROM documents) JOIN al USING (lang) WHERE r <= take)"


def sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.drawn(table(spark, d, "documents").select("doc_id", "lang").filter("lang IS NOT NULL"), "lang", "doc_id", allocation(spark, d), 5)


@query("sa02_stratified_sample", "WITH " + DRAWN + " SELECT doc_id, lang, round(take / size, 6) AS inclusion_prob, round(size / take, 6) AS weight FROM dr")
def stratified(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sample(spark, d).select("doc_id", "lang", "inclusion_prob", "weight"))


@query("sa03_effective_size", "WITH " + DRAWN + ", w AS (SELECT size / take AS w FROM dr) SELECT count(*) AS n, round(sum(w), 4) AS sum_weight, round(sum(w) * sum(w) / sum(w * w), 4) AS ess FROM w")
def effective(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.effective_size(sample(spark, d), []), 4)


@query("sa04_assignments", "SELECT rater, doc_id AS case_id, row_number() OVER w::int AS place, ((row_number() OVER w - 1) // 25)::int AS batch FROM labels, (VALUES ('ann'), ('bo')) r(rater) WINDOW w AS (PARTITION BY rater ORDER BY ('0x' || substr(md5(concat_ws('|', '3', rater, doc_id)), 1, 8))::bigint, doc_id)".replace("row_number() OVER w::int", "(row_number() OVER w)::int"))
def assignments(spark: SparkSession, d: str) -> DataFrame:
    return sampling.assignments(table(spark, d, "labels").select(F.col("doc_id").alias("case_id")), ["ann", "bo"], 25, 3).select("rater", "case_id", "place", "batch")


@query("sa10_weighted_prevalence", "WITH " + DRAWN + " SELECT lang, count(quality) AS n, round(sum(quality * size / take) / sum(CASE WHEN quality IS NOT NULL THEN size / take END), 6) AS prevalence FROM dr LEFT JOIN labels USING (doc_id) GROUP BY 1")
def prevalence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sampling.weighted_prevalence(sample(spark, d).join(table(spark, d, "labels"), "doc_id", "left"), ["lang"], "quality", "weight"))


PARTS = "cl AS (SELECT lang AS site, source AS part, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2)"


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("lang IS NOT NULL AND source IS NOT NULL").groupBy(F.col("lang").alias("site"), F.col("source").alias("part")).agg(F.count("*").alias("n"))


@query("pv01_counts", "SELECT lang, source, CASE WHEN count(*) >= 11 THEN count(*) END AS n, count(*) < 11 AS suppressed FROM documents GROUP BY 1, 2")
def small_counts(spark: SparkSession, d: str) -> DataFrame:
    return disclose.counts(table(spark, d, "documents"), ["lang", "source"])


@query("pv03_complementary", "WITH " + PARTS + """, r AS (SELECT *, max(n < 11) OVER (PARTITION BY site) AS a, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER w - 1 AS k FROM cl WINDOW w AS (PARTITION BY site ORDER BY n, part)),
  h AS (SELECT *, n < 11 OR (a AND (k < 2 OR b < 11)) AS suppressed FROM r) SELECT site, part, CASE WHEN NOT suppressed THEN n END AS n, suppressed FROM h""")
def complementary(spark: SparkSession, d: str) -> DataFrame:
    return disclose.complementary(parts(spark, d), ["site"], "part")


@query("pv04_pooled", "WITH " + PARTS + ", u AS (SELECT site, part, n, n < 11 AS suppressed FROM cl UNION ALL SELECT NULL, part, sum(n)::bigint, sum(n) < 11 OR count(*) FILTER (n < 11) = 1 FROM cl GROUP BY part) SELECT site, part, CASE WHEN NOT suppressed THEN n END AS n, suppressed FROM u")
def pooled(spark: SparkSession, d: str) -> DataFrame:
    return disclose.with_totals(parts(spark, d), "site", "part")


@query("pv05_shares", "WITH c AS (SELECT source, count(*) FILTER (n_chars > 1000) AS n, count(*) AS total FROM documents GROUP BY 1), y AS (SELECT *, CASE WHEN total < 11 THEN 'total' WHEN n < 11 THEN 'low' WHEN total - n < 11 THEN 'high' END AS why FROM c) SELECT source, CASE WHEN why IS NULL THEN round(n / total, 6) END AS share, CASE WHEN why = 'high' THEN '>=' || printf('%.3f', (total - 10) / total) END AS bound, why FROM y")
def share_cells(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").groupBy("source").agg(F.count(F.when(F.col("n_chars") > 1000, 1)).alias("n"), F.count("*").alias("total"))
    return rounded(disclose.shares(c))


@query("pv07_pooled_sites", """WITH RECURSIVE s AS (SELECT c_nationkey AS site, count(*) AS n FROM customer GROUP BY 1),
  f AS (SELECT list_sort(list(struct_pack(n := n, first := site, sites := [site::varchar]))) AS g FROM s
    UNION ALL SELECT list_sort(list_prepend(struct_pack(n := g[1].n + g[2].n, first := g[2].first, sites := list_concat(g[2].sites, g[1].sites)), g[3:])) FROM f WHERE len(g) > 1 AND g[1].n < 60),
  e AS (SELECT unnest(g) AS p FROM f WHERE len(g) = 1 OR g[1].n >= 60)
  SELECT s.site, array_to_string(list_sort(p.sites), '+') AS pool FROM s JOIN e ON list_contains(p.sites, s.site::varchar)""")
def site_pools(spark: SparkSession, d: str) -> DataFrame:
    return disclose.pooled_sites(table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("site")).agg(F.count("*").alias("n")), "site", 60)


@query("pv09_pseudonyms", "SELECT 'site_' || dense_rank() OVER (ORDER BY source) AS site_label, sum(n)::bigint AS n FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1) GROUP BY source")
def pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").filter("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"))
    return disclose.pseudonyms(n, "source").select("site_label", "n")


@query("sc01_pruned_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return readers.scan(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"], ids, "l_orderkey")


@query("sc02_matching_scan", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'ring$') OR p_size IN (1, 2)")
def matching_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.matching(table(spark, d, "part"), "p_name", "ring$", "p_size", [1, 2]).select("p_partkey", "p_name")


@query("sc08_url_parts", "SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, count(*) AS n, max(try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS bigint)) AS last FROM pages WHERE url IS NOT NULL GROUP BY 1")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").filter("url IS NOT NULL")
    return p.groupBy(F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host")).agg(F.count("*").alias("n"), F.max(F.regexp_extract("url", "/([0-9]+)", 1).try_cast("long")).alias("last"))


@query("sc10_first_existing", "WITH c AS (SELECT o_orderkey AS k, 'a' || (o_orderkey % 7) AS x, 'b' || (o_orderkey % 3) AS y FROM orders) SELECT k, CASE WHEN x IN ('a1', 'a4') THEN x WHEN y IN ('b0') THEN y END AS found, CASE WHEN x IN ('a1', 'a4') THEN 0 WHEN y IN ('b0') THEN 1 END AS at FROM c")
def first_existing(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("a"), (F.col("o_orderkey") % 7).cast("string")).alias("x"), F.concat(F.lit("b"), (F.col("o_orderkey") % 3).cast("string")).alias("y"))
    return readers.first_existing(o, "k", ["x", "y"], spark.createDataFrame([("a1",), ("a4",), ("b0",)], "name string"))


@query("sc16_unfinished", "SELECT count(*) AS n, sum(o_orderkey)::bigint AS keys FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def unfinished(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    ledger = o.filter("o_orderstatus <> 'O'").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "timeout").alias("reason"))
    return readers.unfinished(o, "o_orderkey", ledger, ["timeout"]).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("st01_union", "SELECT kind, count(*) AS n, round(sum(amount), 2) AS amount FROM (SELECT 'order' AS kind, o_totalprice AS amount FROM orders UNION ALL SELECT 'line', l_extendedprice FROM lineitem UNION ALL SELECT 'customer', NULL FROM customer) GROUP BY 1")
def union(spark: SparkSession, d: str) -> DataFrame:
    parts_ = [
        table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_totalprice").alias("amount")),
        table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("amount"), F.lit("line").alias("kind")),
        table(spark, d, "customer").select(F.lit("customer").alias("kind")),
    ]
    u = parts_[0].unionByName(parts_[1]).unionByName(parts_[2], allowMissingColumns=True)
    return u.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query("st02_roles", "WITH m AS (SELECT c_custkey, c_mktsegment = 'BUILDING' AS train, c_acctbal > 5000 AS rich, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS urgent FROM customer) SELECT c_custkey, CASE WHEN train AND urgent THEN NULL WHEN train THEN 'train' WHEN urgent THEN 'test' WHEN rich THEN 'pool' ELSE 'none' END AS role FROM m")
def roles(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("u")).distinct()
    c = table(spark, d, "customer")
    j = c.join(urgent, c["c_custkey"] == urgent["u"], "left")
    return j.selectExpr("c_custkey", "CASE WHEN c_mktsegment = 'BUILDING' AND u IS NOT NULL THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'train' WHEN u IS NOT NULL THEN 'test' WHEN c_acctbal > 5000 THEN 'pool' ELSE 'none' END AS role")


@query("sf07_sentences_without")
def sentences_without(spark: SparkSession, d: str) -> DataFrame:
    """Split and filtered sentences of whole texts; another engine's patterns lack lookbehind, so that tests hold it to a plain version."""
    s = table(spark, d, "documents").select("doc_id", text.sentences(F.coalesce("text", F.lit(""))).alias("s"))
    s = s.withColumn("kept", text.without(F.col("s"), "license|rights reserved"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.size("kept").alias("n_kept"), F.sha2(F.array_join("kept", " "), 256).alias("kept_sha256"))


@query("sf08_scrubbed", r"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(coalesce(text, ''), '[0-9A-Za-z_.]+@[0-9A-Za-z_.]+', '[mail]', 'g'), '[0-9]{6,}', '[number]', 'g')) AS scrubbed FROM conversations")
def scrubbed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.scrubbed(F.coalesce("text", F.lit("")))).alias("scrubbed"))


@query("sf14_pooled_vectors", "SELECT label, i - 1 AS dim, round(avg(embedding[i]::double), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2")
def pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return rounded(e.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.avg(F.col("x").cast("double")).alias("mean")))


@query("sf14_attention", """WITH v AS (SELECT label AS g, vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0),
  e AS (SELECT g, vec_id, unnest(v) AS x, unnest(range(len(v))) AS dim FROM v), m AS (SELECT g, dim, avg(x) AS m FROM e GROUP BY 1, 2),
  s AS (SELECT e.g, e.vec_id, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m)) + 1e-12) / 0.1 AS s FROM e JOIN m ON e.g = m.g AND e.dim = m.dim GROUP BY 1, 2),
  w AS (SELECT g, vec_id, exp(s - max(s) OVER (PARTITION BY g)) AS w FROM s)
  SELECT e.g AS label, e.dim, count(*) AS n, round(avg(x), 6) AS mean, round(sum(w * x) / sum(w), 6) AS pooled FROM e JOIN w ON w.g = e.g AND w.vec_id = e.vec_id GROUP BY 1, 2""")
def attention(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signals.attention_pooled(table(spark, d, "embeddings"), "label", "embedding", 0.1))


@query("sf15_log_loss", "WITH " + PREDICTIONS + " SELECT entity, label, round(" + LOSS.format(p="p_a") + ", 6) AS loss FROM pr WHERE y IS NOT NULL")
def losses(spark: SparkSession, d: str) -> DataFrame:
    return rounded(predictions(spark, d).filter("y IS NOT NULL").select("entity", "label", log_loss(F.col("y").cast("double"), F.col("p_a")).alias("loss")))


@query("sg09_amplitude", """WITH s AS (SELECT vec_id, i, embedding[i]::double AS x, embedding[i]::double - lag(embedding[i]::double) OVER (PARTITION BY vec_id ORDER BY i) AS dx FROM embeddings, range(1, 65) t(i))
  SELECT vec_id, round(sqrt(avg(x * x)), 6) AS rms, round(quantile_cont(abs(x), 0.95), 6) AS p95, round(sum(abs(dx)), 6) AS line_length, round(max(x) - min(x), 6) AS peak FROM s GROUP BY 1""")
def amplitude(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as a signal of 64 samples: all sums are within the row, so that nothing is shuffled but the percentile."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    add = lambda a, b: a + b
    mags = F.array_sort(F.transform("x", lambda v: F.abs(v)))
    at = (F.size("x") - 1) * F.lit(0.95)
    low = F.floor(at).cast("int")
    p95 = F.get("m", low) + (F.get("m", F.least(low + 1, F.size("m") - 1)) - F.get("m", low)) * (at - low)
    steps = F.zip_with("x", F.slice("x", 2, 63), lambda a, b: F.coalesce(F.abs(b - a), F.lit(0.0)))
    return rounded(
        e.withColumn("m", mags).select(
            "vec_id",
            F.sqrt(F.aggregate(F.transform("x", lambda v: v * v), F.lit(0.0), add) / F.size("x")).alias("rms"),
            p95.alias("p95"),
            F.aggregate(steps, F.lit(0.0), add).alias("line_length"),
            (F.array_max("x") - F.array_min("x")).alias("peak"),
        )
    )


@query("sc16_shards", "SELECT s AS shard, count(*) AS n FROM (SELECT ('0x' || substr(md5(concat_ws('|', o_orderkey)), 1, 8))::bigint % 8 AS s FROM orders) GROUP BY 1")
def shards(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").select(F.pmod(portable_hash(F.col("o_orderkey").cast("string")), F.lit(8)).alias("shard"))
    return s.groupBy("shard").agg(F.count("*").alias("n"))

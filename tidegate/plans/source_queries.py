"""Registered queries on sources as rows, and on ladders of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators import ladder, metrics
from tidegate.plans.tables import PREDICTIONS, predictions, table
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


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query("sc09_object_keys", "SELECT c_custkey, c_mktsegment || '/' || f || '/ses-' || c_nationkey || '/' || f || '_ses-' || c_nationkey || '_task-eeg.edf' AS key FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'Sub-' || c_custkey ELSE 'sub-' || c_name END AS f FROM customer)")
def object_keys(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    folder = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Sub-"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_name"))
    return c.select("c_custkey", readers.object_key(F.col("c_mktsegment"), folder, F.col("c_nationkey").cast("string"), F.lit("eeg")).alias("key"))


@query("sc11_primary_parts", "WITH p AS (SELECT vec_id % 97 AS rec_id, vec_id % 3 AS w, vec_id AS part, embedding[1]::double AS x FROM embeddings) SELECT rec_id, part, round(x, 6) AS x FROM p WHERE w = 1 AND rec_id IN (SELECT user_id FROM events) QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY coalesce(x > 0, false) DESC, part DESC) = 1")
def primary_parts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 97).alias("rec_id"), F.when(F.col("vec_id") % 3 == 1, "primary").otherwise("other").alias("window"), F.col("vec_id").alias("part"), F.get("embedding", F.lit(0)).cast("double").alias("x"))
    ids = table(spark, d, "events").select(F.col("user_id").alias("rec_id"))
    return rounded(readers.primary_parts(e, "primary", ids, "x > 0").select("rec_id", "part", "x"))


@query("sc13_ratings", "WITH x AS (SELECT doc_id, 1 AS form, quality, toxic FROM labels UNION ALL SELECT doc_id, 2, 1 - quality, toxic FROM labels WHERE doc_id % 10 = 0), l AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY form DESC) = 1) SELECT doc_id, 'good' AS label, quality::int AS value FROM l UNION ALL SELECT doc_id, 'rude', CASE toxic WHEN 1 THEN 1 WHEN 0 THEN 0 END FROM l")
def ratings(spark: SparkSession, d: str) -> DataFrame:
    """Labels as an export of forms; every tenth case has a corrected one, and one form has no case."""
    y = table(spark, d, "labels").select("doc_id", F.lit(1).alias("form"), "quality", "toxic")
    again = y.filter("doc_id % 10 = 0").select("doc_id", F.lit(2).alias("form"), (1 - F.col("quality")).alias("quality"), "toxic")
    blank = y.limit(1).select(F.lit(None).cast("long").alias("doc_id"), "form", "quality", "toxic")
    return readers.long_ratings(y.unionByName(again).unionByName(blank), "doc_id", "form", {"quality": "good", "toxic": "rude"}, {"0": 0, "1": 1})


@query("sc14_listed_ids", r"WITH i AS (SELECT CASE WHEN page_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, unnest(regexp_extract_all(coalesce(url, ''), '[0-9]+')) AS id FROM pages) SELECT id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) AS n FROM i GROUP BY 1")
def listed_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.when(F.col("page_id") % 2 == 0, "train").otherwise("test").alias("split"), "url")
    return readers.listed_ids(p, ["url"], "split", "[0-9]+")


@query("ml04_recalibrated")
def recalibrated(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d).withColumn("role", F.when(F.col("entity") % 3 == 0, "dev").otherwise("eval"))
    return rounded(ladder.recalibrated(rows, "label", "role", "p_b").select("entity", "label", "role", F.col("p_b").alias("p"), "recalibrated"))


@query("ml04_isotonic")
def isotonic(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d).withColumn("role", F.when(F.col("entity") % 3 == 0, "dev").otherwise("eval"))
    return rounded(ladder.recalibrated(rows, "label", "role", "p_b", method="isotonic").select("entity", "label", "role", F.col("p_b").alias("p"), "recalibrated"))


@query("ml10_exposure", "WITH e AS (SELECT 'encoder' AS component, doc_id FROM labels UNION ALL SELECT 'head', doc_id FROM labels WHERE toxic = 1), d AS (SELECT doc_id, lang FROM documents), t AS (SELECT lang, count(*) AS n FROM d GROUP BY 1), h AS (SELECT component, lang, count(*) AS k FROM d JOIN (SELECT DISTINCT * FROM e) USING (doc_id) GROUP BY 1, 2) SELECT c.component, t.lang AS site, t.n, coalesce(h.k, 0) AS n_exposed FROM t CROSS JOIN (SELECT DISTINCT component FROM e) c LEFT JOIN h ON h.component = c.component AND h.lang IS NOT DISTINCT FROM t.lang")
def exposure(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "labels")
    seen = y.select(F.lit("encoder").alias("component"), "doc_id").unionByName(y.filter("toxic = 1").select(F.lit("head").alias("component"), "doc_id"))
    return ladder.exposure_accounting(table(spark, d, "documents").select("doc_id", "lang"), seen, "lang", "doc_id")


def loss(p: str) -> str:
    q = f"least(greatest({p}, 1e-6::double), 1 - 1e-6::double)"
    return f"(-(y * ln({q}) + (1 - y) * ln(1 - {q})))"


@query("ml13_subgroups", "WITH " + PREDICTIONS + ", s AS (SELECT 'all' AS subgroup, * FROM pr UNION ALL SELECT 'english', * FROM pr WHERE site = 'en' UNION ALL SELECT 'sure', * FROM pr WHERE p_a > 0.6 OR p_a < 0.4) SELECT subgroup, count(*) AS n, round(avg(" + loss("p_a") + "), 6) AS loss_a, round(avg(" + loss("p_b") + "), 6) AS loss_b, round(avg(" + loss("p_b") + ") - avg(" + loss("p_a") + "), 6) AS delta FROM s WHERE y IS NOT NULL GROUP BY 1")
def subgroups(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ladder.scored_subgroups(predictions(spark, d), {"all": "true", "english": "site = 'en'", "sure": "p_a > 0.6 OR p_a < 0.4"}, "p_a", "p_b", "y"))


@query("ml14_aggregate_table", "WITH " + PREDICTIONS + ", r AS (SELECT site, label, y, count(*) AS n, avg(p_b) AS mean FROM pr WHERE y IS NOT NULL GROUP BY 1, 2, 3) SELECT site, label, y, CASE WHEN n >= 11 THEN n END AS n, CASE WHEN n >= 11 THEN round(mean, 6) END AS mean, n < 11 AS suppressed FROM r")
def aggregate_table(spark: SparkSession, d: str) -> DataFrame:
    r = predictions(spark, d).filter("y IS NOT NULL").groupBy("site", "label", "y").agg(F.count("*").alias("n"), F.avg("p_b").alias("mean"))
    return rounded(ladder.aggregate_table(r, ["site", "label", "y"], "n", ["mean"]))


@query("mt22_graded_auroc", "WITH " + PREDICTIONS + """, g AS (SELECT label, least((entity % 4)::int, 3) AS grade, y, p_a, p_b FROM pr WHERE y IS NOT NULL), r AS (SELECT label, grade, y, rank() OVER (PARTITION BY label, grade ORDER BY p_a) + (count(*) OVER (PARTITION BY label, grade, p_a) - 1) / 2.0 AS ka, rank() OVER (PARTITION BY label, grade ORDER BY p_b) + (count(*) OVER (PARTITION BY label, grade, p_b) - 1) / 2.0 AS kb FROM g),
  s AS (SELECT label, grade, sum(y) AS n1, count(*) - sum(y) AS n0, sum(ka * y) AS sa, sum(kb * y) AS sb FROM r GROUP BY 1, 2), u AS (SELECT label, grade, (sb - sa) / (n1 * n0) AS delta FROM s WHERE n1 > 0 AND n0 > 0) SELECT label, count(*) AS grades, round(avg(delta), 6) AS mean_delta, round(regr_slope(delta, grade), 6) AS trend FROM u GROUP BY 1""")
def graded_auroc(spark: SparkSession, d: str) -> DataFrame:
    """Gain in AUROC by grade, and its slope over the grades."""
    rows = predictions(spark, d).withColumn("grade", F.least(F.pmod("entity", F.lit(4)).cast("int"), F.lit(3)))
    one, two = (metrics.auroc(rows.withColumn("p", F.col(p)), ["label", "grade"]).select("label", "grade", F.col("auroc").alias(p)) for p in ("p_a", "p_b"))
    j = one.join(two, ["label", "grade"]).withColumn("delta", F.col("p_b") - F.col("p_a")).filter("delta IS NOT NULL")
    return rounded(j.groupBy("label").agg(F.count("*").alias("grades"), F.avg("delta").alias("mean_delta"), F.regr_slope("delta", "grade").alias("trend")))

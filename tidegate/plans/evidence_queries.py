"""Registered queries on evidence, findings, grades and labels from anchored events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators import evidence
from tidegate.plans.tables import INDEX, events, index, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def document_verdict():
    return evidence.verdict(F.col("source"), F.col("text"), F.col("source"), F.col("n_chars") / 1000, ["src0"], r"(^| )tion( |$)|die", ["SRC4", "SRC9"], 12)


VERDICT = r"vd AS (SELECT *, CASE WHEN coalesce(source = 'src0', false) THEN 'source' WHEN coalesce(regexp_matches(lower(text), '(^| )tion( |$)|die'), false) THEN 'text' WHEN coalesce(starts_with(upper(source), 'SRC4') OR starts_with(upper(source), 'SRC9'), false) THEN 'code' WHEN coalesce(n_chars / 1000 > 12, false) THEN 'hours' END AS reason FROM documents)"


@query("sf09_verdicts", "WITH " + VERDICT + " SELECT doc_id, reason FROM vd")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", document_verdict().alias("reason"))


@query("lb05_removed", "WITH " + VERDICT + " SELECT reason, count(*) AS n FROM vd WHERE reason IS NOT NULL GROUP BY 1")
def removed(spark: SparkSession, d: str) -> DataFrame:
    return evidence.removed(table(spark, d, "documents"), document_verdict())[1]


@query("lb12_banned_only", "WITH r AS (SELECT l_orderkey, l_returnflag AS label, bool_and(l_discount >= 0.08 OR l_quantity < 5) AS a FROM lineitem GROUP BY 1, 2) SELECT label, count(*) AS n, count(*) FILTER (a) AS n_banned, round(count(*) FILTER (a) / count(*), 6) AS share FROM r GROUP BY 1")
def banned_only(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "label")
    reason = F.when(F.col("l_discount") >= 0.08, "discount").when(F.col("l_quantity") < 5, "small")
    return evidence.banned_only(rows, reason, "l_orderkey", "label").withColumn("share", F.round("share", 6))


@query("sf10_cells", "SELECT l_returnflag AS cell, l_returnflag <> 'N' AS asserted, CASE WHEN l_returnflag = 'N' THEN false END AS truth, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'R' THEN ' R' ELSE l_returnflag END AS l_returnflag FROM lineitem) GROUP BY ALL")
def cells(spark: SparkSession, d: str) -> DataFrame:
    """Return flags as cells of a form; N counts as no."""
    cell = F.when(F.col("l_returnflag") == "R", " R").otherwise(F.col("l_returnflag"))
    rows = table(spark, d, "lineitem").groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    said = F.when(F.col("cell") == "N", "no").otherwise(F.col("cell"))
    return rows.select("cell", evidence.asserted(said).alias("asserted"), evidence.truth(said).alias("truth"), "n")


@query("sf11_grades", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN 3 WHEN o_totalprice > 300000 THEN 2 WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS grade, CASE CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN 3 WHEN o_totalprice > 300000 THEN 2 WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END WHEN 3 THEN 3 WHEN 2 THEN 8 WHEN 1 THEN 12 ELSE 15 END AS score, date_trunc('day', o_orderdate) AS day FROM orders")
def grades(spark: SparkSession, d: str) -> DataFrame:
    g = evidence.grade([(3, F.expr("o_orderpriority = '1-URGENT' AND o_totalprice > 300000")), (2, F.expr("o_totalprice > 300000")), (1, F.expr("o_orderstatus = 'O'"))])
    score = F.element_at(F.array(*map(F.lit, (15, 12, 8, 3))), F.col("grade") + 1)
    return table(spark, d, "orders").withColumn("grade", g).select("o_orderkey", "grade", score.alias("score"), F.date_trunc("DAY", "o_orderdate").cast("timestamp_ntz").alias("day"))


@query("sf12_findings", r"WITH x AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN NOT (regexp_matches(t, 'the|le|der') AND NOT regexp_matches(t, 'nnth')) OR regexp_matches(t, '(^| )(no|ne|nicht)( |$)') THEN 'none' WHEN regexp_matches(t, '(^| )(or|ou|oder)( |$)') THEN 'indeterminate' WHEN regexp_matches(t, 'tion') THEN 'chronic' ELSE 'positive' END AS class FROM x")
def findings(spark: SparkSession, d: str) -> DataFrame:
    kind = evidence.finding(F.col("text"), "the|le|der", "nnth", r"(^| )(no|ne|nicht)( |$)", r"(^| )(or|ou|oder)( |$)", "tion")
    return table(spark, d, "conversations").select("conv_id", "turn", kind.alias("class"))


@query("sf13_case_names", "WITH h AS (SELECT c_custkey, ('0x' || substr(md5('11|' || c_custkey), 1, 7))::bigint AS h FROM customer) SELECT c_custkey, 'C' || lpad(h::varchar, 9, '0') || chr((65 + (h * 7 + 3) % 26)::int) AS case_name FROM h")
def case_names(spark: SparkSession, d: str) -> DataFrame:
    return evidence.pseudonymous(table(spark, d, "customer").select("c_custkey"), "c_custkey", 11)


def cases(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).select(F.col("entity_id").alias("case_id"), "entity_id", "t0")


def anchors(spark: SparkSession, d: str, extra: bool = False) -> DataFrame:
    e = events(spark, d)
    no = F.lit(None).cast("double")
    quantity = e.filter("domain = 'error' AND value > 30").select("entity_id", F.lit("fault").alias("item"), "value", "t_event", F.lit("quantitative").alias("kind"))
    quality = e.filter("domain = 'click'").select("entity_id", F.col("key").alias("item"), no.alias("value"), "t_event", F.lit("qualitative").alias("kind"))
    code = e.filter("domain = 'view'").select("entity_id", F.lit("seen").alias("item"), "value", "t_event", F.lit("code").alias("kind"))
    other = e.filter("domain = 'signup' AND value > 10").select("entity_id", F.lit("k1").alias("item"), "value", "t_event", F.lit("extra").alias("kind"))
    return evidence.anchored(cases(spark, d), [quantity, quality, code], (-72, 48), other if extra else None)


ANCHORS = INDEX + """, ax AS (SELECT entity_id, 'fault' AS item, value, t_event, 'quantitative' AS kind FROM ev WHERE domain = 'error' AND value > 30 UNION ALL SELECT entity_id, key, NULL, t_event, 'qualitative' FROM ev WHERE domain = 'click'
    UNION ALL SELECT entity_id, 'seen', value, t_event, 'code' FROM ev WHERE domain = 'view'),
  ay AS (SELECT entity_id, 'k1' AS item, value, t_event, 'extra' AS kind FROM ev WHERE domain = 'signup' AND value > 10),
  aw AS (SELECT ix.entity_id AS case_id, item, value, kind, date_diff('microsecond', t0, x.t_event) / 3.6e9 AS hours FROM (SELECT * FROM ax{extra}) x JOIN ix ON ix.entity_id = x.entity_id), an AS (SELECT * FROM aw WHERE hours BETWEEN -72 AND 48)"""
PLAIN, EXTRA = ANCHORS.replace("{extra}", ""), ANCHORS.replace("{extra}", " UNION ALL SELECT * FROM ay")
LEAVES = {"fault_early": "item = 'fault' AND hours <= 0", "fault_high": "item = 'fault' AND value > 40", "k1": "item = 'k1'", "k2_late": "item = 'k2' AND hours > 0", "never": "item = 'nothing'"}
ITEMS = {"fault_early": "fault", "fault_high": "fault", "k1": "k1", "k2_late": "k2", "never": "nothing"}
RULES = {"acute": ["or", "fault_high", ["and", "fault_early", "k1"]], "late": ["and", "k2_late", ["or", "fault_early", "never"]], "odd": ["and", "never", "k1"]}
FLAGS = ", fl AS (SELECT ix.entity_id AS case_id, " + ", ".join(f"coalesce(bool_or({c}), false) AS {n}" for n, c in LEAVES.items()) + " FROM ix LEFT JOIN an ON an.case_id = ix.entity_id GROUP BY 1)"


@query("lb03_anchors", "WITH " + PLAIN + " SELECT case_id, item, kind, count(*) AS n, round(min(hours), 6) AS first, round(max(value), 6) AS high FROM an GROUP BY ALL")
def anchor_events(spark: SparkSession, d: str) -> DataFrame:
    return anchors(spark, d).groupBy("case_id", "item", "kind").agg(F.count("*").alias("n"), F.round(F.min("hours"), 6).alias("first"), F.round(F.max("value"), 6).alias("high"))


@query("lb04_exposure", "WITH " + PLAIN + ", s AS (SELECT entity_id, -24 - entity_id % 24 AS start FROM ix) SELECT case_id, item, bool_or(hours >= start) AS inside, bool_or(hours < start) AS outside FROM an JOIN s ON s.entity_id = case_id GROUP BY ALL")
def exposures(spark: SparkSession, d: str) -> DataFrame:
    return evidence.exposure(anchors(spark, d).withColumn("start", -24 - F.col("case_id") % 24), "start")


@query("lb07_coverage", "WITH " + PLAIN + ", l(leaf, item, m) AS (VALUES ('fault_early', 'fault', true), ('fault_high', 'fault', true), ('k1', 'k1', true), ('k2_late', 'k2', true), ('never', 'nothing', false)) SELECT leaf, l.item, count(an.item) AS n, CASE WHEN NOT m THEN 'unmapped' WHEN count(an.item) = 0 THEN 'unobserved' ELSE 'observed' END AS status FROM l LEFT JOIN an USING (item) GROUP BY leaf, l.item, m")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return evidence.coverage(anchors(spark, d), LEAVES, ITEMS, {"fault", "k1", "k2"})


@query("lb08_labels", "WITH " + PLAIN + FLAGS + " SELECT case_id, fault_high OR (fault_early AND k1) AS acute, k2_late AND (fault_early OR never) AS late, NULL::boolean AS odd FROM fl")
def extracted(spark: SparkSession, d: str) -> DataFrame:
    """From events to labels: anchors, coverage, leaves, rules."""
    a = anchors(spark, d)
    can = evidence.satisfiable(evidence.coverage(a, LEAVES, ITEMS, {"fault", "k1", "k2"}), RULES)
    return evidence.labels(evidence.leaf_flags(a, cases(spark, d), LEAVES), RULES, can)


#: What is no evidence: readings out of range, and old qualitative events.
GONE = "CASE WHEN kind = 'quantitative' AND value > 80 THEN 'extreme' WHEN kind = 'qualitative' AND hours < -48 THEN 'old' END"
CHAIN = "WITH " + PLAIN + ", ok AS (SELECT * FROM an WHERE " + GONE + " IS NULL)" + FLAGS.replace("LEFT JOIN an ON an.case_id", "LEFT JOIN ok ON ok.case_id") + """,
  so AS (SELECT ix.entity_id AS case_id, ix.entity_id % 4 AS bin, coalesce(bool_or(item = 'seen' AND hours BETWEEN -12 AND 12), false) AS has FROM ix LEFT JOIN an ON an.case_id = ix.entity_id GROUP BY 1),
  sh AS (SELECT bin, avg(has::int) AS share FROM so GROUP BY 1), lb AS (SELECT case_id, fault_high OR (fault_early AND k1) AS acute, k2_late AND (fault_early OR never) AS late FROM fl),
  av AS (SELECT case_id, CASE WHEN acute OR share >= 0.3 OR has THEN acute END AS acute, CASE WHEN late OR share >= 0.3 OR has THEN late END AS late FROM lb JOIN so USING (case_id) JOIN sh USING (bin))
"""


def chain(spark: SparkSession, d: str) -> evidence.Extraction:
    a = anchors(spark, d)
    reason = F.when((F.col("kind") == "quantitative") & (F.col("value") > 80), "extreme").when((F.col("kind") == "qualitative") & (F.col("hours") < -48), "old")
    seen = a.groupBy("case_id").agg(F.bool_or((F.col("item") == "seen") & F.col("hours").between(-12, 12)).alias("has_source"))
    sources = cases(spark, d).select("case_id", (F.col("case_id") % 4).alias("bin")).join(seen, "case_id", "left")
    derived = {"either": F.coalesce("acute", F.lit(False)) | F.coalesce("late", F.lit(False)), "both": F.col("acute") & F.col("late")}
    return evidence.extract(a, cases(spark, d), reason, LEAVES, ITEMS, {"fault", "k1", "k2"}, RULES, derived, sources, 0.3, keep_if_present=True)


@query("lb08_chain", CHAIN + " SELECT case_id, acute, late, NULL::boolean AS odd, coalesce(acute, false) OR coalesce(late, false) AS either, acute AND late AS both FROM av")
def label_chain(spark: SparkSession, d: str) -> DataFrame:
    """Events to labels with all that the chain has: evidence that goes, thin sources, derived labels."""
    return chain(spark, d).labels


@query("lb08_removed", "WITH " + PLAIN + ", g AS (SELECT " + GONE + " AS reason FROM an) SELECT reason, count(*) AS n FROM g WHERE reason IS NOT NULL GROUP BY 1")
def chain_removed(spark: SparkSession, d: str) -> DataFrame:
    return chain(spark, d).removed


@query("lb10_nodes", "WITH " + PLAIN + FLAGS + " SELECT case_id, fault_high OR (fault_early AND k1) AS acute, fault_high AS acute_0, fault_early AND k1 AS acute_1, fault_early AS acute_1_0, k1 AS acute_1_1 FROM fl")
def rule_nodes(spark: SparkSession, d: str) -> DataFrame:
    return evidence.nodes(evidence.leaf_flags(anchors(spark, d), cases(spark, d), LEAVES), {"acute": RULES["acute"]})


@query("ud02_extra_events", "WITH " + EXTRA + FLAGS + " SELECT case_id, fault_high OR (fault_early AND k1) AS acute FROM fl")
def with_extra_events(spark: SparkSession, d: str) -> DataFrame:
    return evidence.labels(evidence.leaf_flags(anchors(spark, d, True), cases(spark, d), LEAVES), {"acute": RULES["acute"]})

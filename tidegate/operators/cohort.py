"""Cohorts: ordered exclusions in one pass, their flow, and the rows that pass them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reason(rules: list[tuple[str, str]]) -> Column:
    """Name of the first rule (name, condition to stay) that a row fails, else included. An unknown condition fails."""
    out = F.lit("included")
    for name, keep in reversed(rules):
        out = F.when(F.coalesce(F.expr(keep), F.lit(False)), out).otherwise(F.lit(name))
    return out


def flow(rows: DataFrame, rules: list[tuple[str, str]], site: str) -> DataFrame:
    """site (null: all), stage, step, dropped, remaining after it. The counts are few: a row for each site and rule."""
    names = [n for n, _ in rules]
    stage = F.array_position(F.array(*map(F.lit, names)), F.col("reason")).cast("int")
    counts = rows.withColumn("reason", reason(rules)).rollup(site, "reason").agg(F.count("*").alias("n"), F.grouping("reason").alias("g"), F.grouping(site).alias("s"))
    total = counts.filter("g = 1").select(F.col(site).alias("_site"), F.col("n").alias("total"), F.col("s").alias("_s"))
    each = rows.withColumn("reason", reason(rules)).groupingSets([[F.col(site), F.col("reason")], [F.col("reason")]], site, "reason").agg(F.count("*").alias("n"), F.grouping(site).alias("s"))
    each = each.filter("reason <> 'included'").join(total, (F.col("s") == F.col("_s")) & F.col(site).eqNullSafe(F.col("_site")))
    w = Window.partitionBy("s", site).orderBy("stage").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("stage", stage).select(F.col(site).alias("site"), "stage", F.col("reason").alias("step"), F.col("n").alias("dropped"), (F.col("total") - F.sum("n").over(w)).alias("remaining"))


def plausible(rows: DataFrame, ranges: DataFrame, drop: bool) -> DataFrame:
    """rows (item, value) held to ranges (item, lo, hi): values outside become null, or their rows go. Items without a range stay."""
    j = rows.join(ranges.select("item", "lo", "hi"), "item", "left")
    ok = F.col("lo").isNull() | F.col("value").between(F.col("lo"), F.col("hi"))
    return (j.filter(ok) if drop else j.withColumn("value", F.when(ok, F.col("value")))).drop("lo", "hi")


def prepared(rows: DataFrame) -> DataFrame:
    """case_id, entity_id, t0, site of cases with a known time; raises if a case occurs twice."""
    out = rows.filter(F.col("t0").isNotNull()).select("case_id", "entity_id", "t0", F.col("site").cast("string").alias("site"))
    if not out.groupBy("case_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("a case occurs more than once")
    return out


def allowed(names: list[str], forbidden: set[str]) -> list[str]:
    """The names themselves; raises before anything is read if one is forbidden."""
    if bad := sorted(n for n in names if n.lower() in {f.lower() for f in forbidden}):
        raise ValueError(f"never to be loaded: {', '.join(bad)}")
    return names


def column_sets(frame: DataFrame, sets: dict[str, list[str]], chosen: str, keep: list[str]) -> DataFrame:
    """keep and the columns of a named set with those of the sets before it, as far as each is there; sets are nested in their order."""
    names, wanted = list(sets), []
    for name in names[: names.index(chosen) + 1]:
        wanted += [c for c in sets[name] if c not in wanted]
    return frame.select(*keep, *[c for c in wanted if c in frame.columns and c not in keep])


def known(condition: str) -> Column:
    """A condition, false where it is unknown."""
    return F.coalesce(F.expr(condition), F.lit(False))


def qualifying(rows: DataFrame, required: list[str], parts: dict[str, str]) -> DataFrame:
    """Rows that meet all requirements and one part at least, with a column for each part; what is unknown isn't met."""
    out = rows.withColumns({name: known(c) for name, c in parts.items()})
    for c in required:
        out = out.filter(known(c))
    return out.filter(F.array_contains(F.array(*parts), True))


def of_kind(rows: DataFrame, column: str, kinds: list[tuple[str, str]]) -> DataFrame:
    """Rows whose wording has a kind, with the first such one; each distinct wording is tried once."""
    names = rows.select(column).distinct()
    kind = F.lit(None).cast("string")
    for pattern, name in reversed(kinds):
        kind = F.when(F.lower(column).rlike(pattern), name).otherwise(kind)
    names = names.withColumn("kind", kind).filter("kind IS NOT NULL")
    return rows.join(names, column)


def conjunctions(rows: DataFrame, flags: dict[str, str], variants: dict[str, list[str]]) -> DataFrame:
    """A column for each variant: all of its flags are met. An unknown flag counts as not met."""
    out = {}
    for name, parts in variants.items():
        whole = F.lit(True)
        for p in parts:
            whole = whole & known(flags[p])
        out[name] = whole
    return rows.withColumns(out)


def components(rows: DataFrame, flags: dict[str, str]) -> DataFrame:
    """component, known, met, unknown, and whether it is optional: unknown for some rows."""
    wide = rows.select(*[F.expr(c).alias(n) for n, c in flags.items()])
    long = wide.unpivot([], list(flags), "component", "v")
    n = F.count("*")
    return long.groupBy("component").agg(F.count("v").alias("known"), F.count_if("v").alias("met"), (n - F.count("v")).alias("unknown"), (F.count("v") < n).alias("optional"))


def phenotype(cases: DataFrame, codes: DataFrame, pattern: str, after_h: float) -> DataFrame:
    """case_id, phenotype: a code of the pattern from the encounter's start to some hours after t0. Only matching codes meet the cases."""
    code = F.regexp_replace(F.upper("code"), "[^A-Z0-9]", "")
    hits = codes.filter(code.rlike(pattern)).select(F.col("entity_id").alias("_e"), F.col("t").alias("_t"))
    until = F.timestamp_add("SECOND", F.lit(int(after_h * 3600)), F.col("t0"))
    inside = (F.col("entity_id") == F.col("_e")) & (F.col("_t") >= F.col("start")) & (F.col("_t") <= until)
    found = cases.join(hits, inside, "left_semi").select("case_id").distinct().withColumn("_hit", F.lit(True))
    return cases.join(found, "case_id", "left").select("case_id", F.coalesce("_hit", F.lit(False)).alias("phenotype"))


def comparator(cases: DataFrame, findings: DataFrame, tolerance: float) -> DataFrame:
    """cases (case_id, key, entity_id, t), findings (key, entity_id, t, label): any label of the same key; without a key, of about the same time."""
    f = findings.select(F.col("key").alias("_k"), F.col("entity_id").alias("_e"), F.col("t").alias("_t"), "label")
    by_key = cases.filter("key IS NOT NULL").join(f, F.col("key") == F.col("_k"))
    by_time = cases.filter("key IS NULL").join(f, (F.col("entity_id") == F.col("_e")) & (F.abs(F.col("_t") - F.col("t")) <= tolerance))
    return by_key.unionByName(by_time).groupBy("case_id").agg(F.bool_or("label").alias("label"))


def assembled(cohort: DataFrame, blocks: dict[str, DataFrame], key: str = "entity_id") -> DataFrame:
    """The cohort with each block's columns, has_<block>, and complete: all blocks are there."""
    out = cohort
    for name, block in blocks.items():
        out = out.join(block.withColumn(f"has_{name}", F.lit(True)), key, "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    whole = F.lit(True)
    for name in blocks:
        whole = whole & F.col(f"has_{name}")
    return out.withColumn("complete", whole)


def usable_labels(rows: DataFrame, labels: list[str], site: str, least: int = 11) -> DataFrame:
    """label, usable: at least so many positives and negatives at every site."""
    long = rows.unpivot([site], labels, "label", "y").filter("y IS NOT NULL")
    each = long.groupBy("label", site).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    return each.groupBy("label").agg((F.least(F.min("pos"), F.min("neg")) >= least).alias("usable"))


def subset(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(keys.select(*by), by, "left_semi")


def linkage(a: DataFrame, b: DataFrame, leading: str) -> DataFrame:
    """Of two sources (id, born): distinct ids of each and of both by normal form, and pairs whose births are a day apart at most."""
    normal = F.ltrim(F.regexp_replace(F.upper("id"), "[^A-Z0-9]", ""), F.lit(leading))
    x, y = (s.select(normal.alias("k"), "born").distinct() for s in (a, b))
    both = x.join(y.withColumnRenamed("born", "other"), "k").agg(F.count_distinct("k").alias("n_both"), F.count_if(F.abs(F.datediff("born", "other")) <= 1).alias("n_agree"))
    n = lambda s, name: s.agg(F.count_distinct("k").alias(name))
    return n(x, "n_a").crossJoin(n(y, "n_b")).crossJoin(both)  # one row each


def selected_concepts(concepts: DataFrame, domains: list[str], classes: list[tuple[str, str]], used: DataFrame) -> DataFrame:
    """concept_id, name, class of the domains' concepts by their names, and of further ones that rows refer to."""
    kind = F.lit(None).cast("string")
    for pattern, name in reversed(classes):
        kind = F.when(F.lower("name").rlike(pattern), name).otherwise(kind)
    own = F.when(F.col("domain").isin(domains), kind)
    marked = concepts.join(used.select("concept_id").distinct().withColumn("_used", F.lit(True)), "concept_id", "left").withColumn("class", F.coalesce(own, F.when(F.col("_used"), "referenced")))
    return marked.filter("class IS NOT NULL").select("concept_id", "name", "class").distinct()


def built(qualified: DataFrame, intervals: DataFrame, windows_h: list[float]) -> DataFrame:
    """The first qualifying case of each entity with its covered start, hours from there to t0, and whether these are within each window."""
    order = F.struct("t0", "case_id")
    first = qualified.groupBy("entity_id").agg(F.min(order).alias("_m")).select("entity_id", "_m.t0", "_m.case_id")
    cover = first.join(intervals.select("entity_id", "t_start", "t_end"), "entity_id").filter((F.col("t_start") <= F.col("t0")) & (F.col("t_end") >= F.col("t0")))
    cover = cover.groupBy("case_id").agg(F.min("t_start").alias("_covered"))
    out = first.join(cover, "case_id", "left").withColumn("start", F.coalesce("_covered", "t0"))
    out = out.withColumn("hours", F.timestamp_diff("MICROSECOND", F.col("start"), F.col("t0")) / F.lit(3.6e9))
    return out.select("case_id", "entity_id", "t0", "start", "hours", *[(F.col("hours") <= h).alias(f"onset_le_{h}h") for h in windows_h])


def eligible(rows: DataFrame, strata: list[tuple[str, str]], labels: list[str]) -> DataFrame:
    """case_id, entity_id, stratum, pattern: one case of each entity in a stratum, by stratum, time and id; pattern has a digit for each label."""
    stratum = F.lit(None).cast("string")
    for name, condition in reversed(strata):
        stratum = F.when(known(condition), name).otherwise(stratum)
    pattern = F.concat(*[F.when(F.expr(c).isNull(), "-").when(F.expr(c), "1").otherwise("0") for c in labels])
    marked = rows.withColumns({"stratum": stratum, "pattern": pattern}).filter("stratum IS NOT NULL")
    return marked.groupBy("entity_id").agg(F.min(F.struct("stratum", "t", "case_id", "pattern")).alias("_m")).select("_m.case_id", "entity_id", "_m.stratum", "_m.pattern")

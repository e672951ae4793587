"""Events from the tables of a record system: each builder gives rows (entity_id, domain, key, t_event, t_avail, basis, ..) for the gate.

Wordings are classified once for each distinct one; lags and concepts are small tables, whose size Spark knows when it joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.expressions import hours_between, normal_code
from tidegate.operators import lexicon

LONG_AGO = "1900-01-01"
COLUMNS = ["entity_id", "domain", "key", "value", "t_event", "t_avail", "basis"]


def after(t: str | Column, hours: Column | float) -> Column:
    """A time some hours later."""
    h = hours if isinstance(hours, Column) else F.lit(hours)
    return F.timestamp_add("SECOND", F.round(h * 3600).cast("long"), F.col(t) if isinstance(t, str) else t)


def interval_events(rows: DataFrame, ingredients: list[tuple[str, str]], admin: str) -> DataFrame:
    """rows (entity_id, name, concept_name, t_start, t_end, t_ordered, quantity): an event for each ingredient in the name or its concept's.

    Given rows are available when they start; ordered ones, when they were ordered, and they end where they begin.
    """
    return ingredient_events(ingredient_hits(rows, ingredients), admin)


def ingredient_hits(rows: DataFrame, ingredients: list[tuple[str, str]]) -> DataFrame:
    """rows (name, concept_name, ..) with the key of each ingredient in the name or its concept's: a table of products may be asked once."""
    return lexicon.all_matches(rows.withColumn("_text", F.lower(F.concat_ws(" ", "name", "concept_name"))), "_text", ingredients, "key").drop("_text")


def ingredient_events(rows: DataFrame, admin: str) -> DataFrame:
    """``interval_events`` of rows that have their key already."""
    hits = rows.withColumn("basis", F.when(F.expr(admin), "given").otherwise("ordered"))
    given = F.col("basis") == "given"
    return hits.select(
        "entity_id", F.lit("drug").alias("domain"), "key", F.col("quantity").alias("value"),
        F.when(given, F.col("t_start")).otherwise(F.col("t_ordered")).alias("t_event"),
        F.when(given, F.col("t_start")).otherwise(F.col("t_ordered")).alias("t_avail"),
        "basis", F.when(given, F.col("t_end")).otherwise(F.col("t_ordered")).alias("t_end_raw"),
    )


def measurement_events(rows: DataFrame, registry: DataFrame, units: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows (entity_id, name, value, unit, t_collected, t_result) by registry (name, domain, key, lag_h): canonical values and their status.

    A value is available at its result, else at its collection and the lag; never before it was collected. A collection at midnight is approx.
    """
    known = rows.join(registry, "name").withColumn("item", F.col("key"))
    out = lexicon.converted(known, units, ranges)
    avail = F.greatest(F.coalesce("t_result", after("t_collected", F.col("lag_h"))), F.col("t_collected"))
    return out.select(
        "entity_id", "domain", "key", F.col("canonical").alias("value"), F.col("t_collected").alias("t_event"), avail.alias("t_avail"),
        F.when(F.col("t_result").isNotNull(), "result").otherwise("lag").alias("basis"), "status",
        (F.date_trunc("DAY", "t_collected") == F.col("t_collected")).alias("approx"),
    )


def code_events(codes: DataFrame, rules: DataFrame, visits: DataFrame | None = None, unbounded: tuple[str, ...] = ()) -> DataFrame:
    """codes (entity_id, code, t, visit_id) as events of the items of rules (prefix, exclude, item).

    A code without a time has its visit's start; without that, items with unbounded lookback count as long ago, and others fall out.
    """
    return item_events(code_items(codes, rules), visits, unbounded)


def code_items(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (code, ..) with the items of their codes: a table of products or concepts may be asked once."""
    return lexicon.code_hits(rows.withColumn("_c", normal_code(F.col("code"))), "_c", rules).drop("_c")


def item_events(hits: DataFrame, visits: DataFrame | None = None, unbounded: tuple[str, ...] = ()) -> DataFrame:
    """``code_events`` of rows (entity_id, item, t, visit_id) that have their item already. Rows that need no visit's start, as they have
    a time or no visit, are dealt by their entity and time: they don't meet in the task of one null."""
    kind = hits.schema["t"].dataType
    if visits is not None:
        v = visits.filter("visit_id IS NOT NULL").select(F.col("visit_id").alias("_v"), F.col("t_start").alias("_s"), (F.hash("visit_id") % 1).cast("long").alias("_z"))
        asks = F.when(F.col("t").isNull(), F.col("visit_id"))
        hits = hits.withColumn("_asks", asks).withColumn("_spread", F.when(F.col("_asks").isNotNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("entity_id", "t", "item")))
        hits = hits.join(v, (F.col("_asks") == F.col("_v")) & (F.col("_spread") == F.col("_z")), "left")
    else:
        hits = hits.withColumn("_s", F.lit(None).cast(kind))
    own, start = F.col("t").isNotNull(), F.col("_s").isNotNull()
    ago = F.when(F.col("item").isin(*unbounded), F.lit(LONG_AGO).cast(kind))
    when = F.coalesce("t", "_s", ago)
    out = hits.select(
        "entity_id", F.lit("code").alias("domain"), F.col("item").alias("key"), F.lit(None).cast("double").alias("value"), when.alias("t_event"),
        when.alias("t_avail"), F.when(own, "own").when(start, "visit").otherwise("unknown").alias("basis"),
    )
    return out.filter(F.col("t_event").isNotNull())


def wording_events(rows: DataFrame, wordings: list[tuple[str, str]], negation: str) -> DataFrame:
    """rows (entity_id, text, t): events of the first wording that a text has, unless it negates it."""
    kept = rows.filter(~F.coalesce(F.lower("text").rlike(negation), F.lit(False)))
    hits = lexicon.classified(kept.withColumn("_text", F.lower("text")), "_text", wordings, "key").filter("key IS NOT NULL")
    return hits.select("entity_id", F.lit("observation").alias("domain"), "key", F.lit(None).cast("double").alias("value"), F.col("t").alias("t_event"), F.col("t").alias("t_avail"), F.lit("text").alias("basis"))


def study_events(studies: DataFrame, lags: DataFrame) -> DataFrame:
    """studies (entity_id, modality, t_study, t_final) by lags (modality, lag_h): available when final, else some hours after the study."""
    out = studies.join(lags, "modality", "left")
    avail = F.coalesce("t_final", after("t_study", F.coalesce("lag_h", F.lit(24.0))))
    return out.select(
        "entity_id", F.lit("study").alias("domain"), F.col("modality").alias("key"), F.lit(None).cast("double").alias("value"), F.col("t_study").alias("t_event"),
        F.greatest(avail, "t_study").alias("t_avail"), F.when(F.col("t_final").isNotNull(), "final").otherwise("lag").alias("basis"),
    )


def drug_groups(rows: DataFrame, groups: list[tuple[str, str]], routes: dict[str, str], column: str = "name", route: str = "route") -> DataFrame:
    """Rows with the group of each matching name; a group that names a route needs it in the row's route, where that is known."""
    hits = lexicon.all_matches(rows.withColumn("_text", F.lower(column)), "_text", groups, "item").drop("_text")
    ok = F.lit(True)
    for item, pattern in routes.items():
        ok = ok & ((F.col("item") != item) | F.col(route).isNull() | F.lower(route).rlike(pattern))
    return hits.filter(ok)


def built(builders: list[DataFrame], starts: DataFrame, exempt: list[str]) -> DataFrame:
    """All builders' events of entities with a start, from that start on; exempt domains whatever their age."""
    union = reduce(DataFrame.unionByName, [b.select(*COLUMNS) for b in builders])
    s = starts.select("entity_id", F.col("start").alias("_start"))
    return union.join(s, "entity_id").filter((F.col("t_event") >= F.col("_start")) | F.col("domain").isin(exempt)).drop("_start")


def by_route(rows: DataFrame, concepts: DataFrame, rules: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """rows (row_id, concept_id, source_id, code, name) with item and basis: by concept, else source concept, else code, else name."""
    c = concepts.select(F.col("concept_id").alias("_c"), F.col("item").alias("_ci"))
    s = concepts.select(F.col("concept_id").alias("_s"), F.col("item").alias("_si"))
    coded = rows.select("row_id", normal_code(F.col("code")).alias("_k")).filter("_k IS NOT NULL")
    coded = lexicon.code_hits(coded, "_k", rules).groupBy(F.col("row_id").alias("_r")).agg(F.min("item").alias("_ki"))
    out = rows.join(c, rows["concept_id"] == c["_c"], "left").join(s, rows["source_id"] == s["_s"], "left").join(coded, F.col("row_id") == F.col("_r"), "left")
    out = lexicon.classified(out.withColumn("_n", F.lower("name")), "_n", names, "_ni")
    basis = F.when(F.col("_ci").isNotNull(), "concept").when(F.col("_si").isNotNull(), "source").when(F.col("_ki").isNotNull(), "code").when(F.col("_ni").isNotNull(), "name")
    return out.select("row_id", F.coalesce("_ci", "_si", "_ki", "_ni").alias("item"), basis.alias("basis"))


def visit_class(concept: Column, source: Column, ids: dict[int, str], keywords: list[tuple[str, str]]) -> Column:
    """By concept id if it is a known one, else by the first keyword in the source's wording; null if neither says anything."""
    known = F.lit(None).cast("string")
    for number, name in ids.items():
        known = F.when(concept == number, name).otherwise(known)
    return F.coalesce(known, lexicon.first_match(keywords, F.lower(source)))


def record_type(name: Column) -> Column:
    """administration, order or other."""
    low = F.lower(name)
    return F.when(low.rlike("admin|dispens|given"), "administration").when(low.rlike("order|prescri|request"), "order").otherwise("other")


def proxies(index: DataFrame, events: DataFrame, flags: dict[str, tuple[str, float]]) -> DataFrame:
    """entity_id and, for each flag, whether an event that meets its condition started within its hours before t0 or still runs in them."""
    near = index.select("entity_id", "t0").join(events, "entity_id").withColumns({"_s": hours_between("t0", "t_event"), "_e": hours_between("t0", F.coalesce("t_end_raw", "t_event"))})
    hit = {name: F.coalesce(F.bool_or(F.expr(condition) & (F.col("_s") <= 0) & (F.greatest("_e", "_s") >= -hours)), F.lit(False)) for name, (condition, hours) in flags.items()}
    seen = near.groupBy("entity_id").agg(*[c.alias(n) for n, c in hit.items()])
    return index.select("entity_id").join(seen, "entity_id", "left").select("entity_id", *[F.coalesce(n, F.lit(False)).alias(n) for n in flags])

"""Evidence: verdicts on rows that may or may not support a label, findings, grades, and labels from anchored events by rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.expressions import hours_between, normal_code


def verdict(source: Column, text: Column, code: Column, hours: Column, sources: list[str], wording: str, prefixes: list[str], late_h: float) -> Column:
    """Why a row is no evidence, first reason first: its source, its wording, its code, or a time too late; null if it may stay."""
    c = normal_code(code)
    coded = reduce(lambda a, p: a | c.startswith(p), prefixes, F.lit(False))
    reasons = (("source", source.isin(sources)), ("text", F.lower(text).rlike(wording)), ("code", coded), ("hours", hours > late_h))
    out = F.lit(None).cast("string")
    for name, bad in reversed(reasons):
        out = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(out)
    return out


def removed(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and reason, n of the others."""
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def banned_only(rows: DataFrame, reason: Column, case: str, label: str) -> DataFrame:
    """label, n positives, n_banned: positives all of whose rows have a reason, and their share."""
    each = rows.withColumn("_bad", reason.isNotNull()).groupBy(case, label).agg(F.bool_and("_bad").alias("all_banned"))
    return each.groupBy(label).agg(F.count("*").alias("n"), F.count_if("all_banned").alias("n_banned")).withColumn("share", F.col("n_banned") / F.col("n"))


def asserted(cell: Column) -> Column:
    """Whether a finding's cell says anything but no."""
    return ~F.coalesce(F.lower(F.trim(cell)).isin("", "0", "no", "none", "absent", "false", "n/a"), F.lit(True))


def truth(cell: Column) -> Column:
    """yes and no wordings as a boolean, anything else as unknown."""
    low = F.lower(F.trim(cell))
    return F.when(low.isin("yes", "y", "true", "1"), True).when(low.isin("no", "n", "false", "0"), False)


def finding(text: Column, include: str, exclude: str | None, negation: str, hedge: str, chronic: str) -> Column:
    """positive, indeterminate, chronic or none of a finding's whole wording."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = low.rlike(include) & ~(low.rlike(exclude) if exclude else F.lit(False))
    return F.when(~hit | low.rlike(negation), "none").when(low.rlike(hedge), "indeterminate").when(low.rlike(chronic), "chronic").otherwise("positive")


def grade(flags: list[tuple[int, Column]]) -> Column:
    """The grade of the first condition that is met, 0 if none is; unknown conditions aren't met."""
    out = F.lit(0)
    for g, c in reversed(flags):
        out = F.when(F.coalesce(c, F.lit(False)), g).otherwise(out)
    return out


def check_letter(number: Column) -> Column:
    return F.char(65 + F.pmod(number * 7 + 3, F.lit(26)))


def pseudonymous(rows: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Adds case_name: a hash of seed and id, and a letter that tells misspelt ones."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 7), 16, 10).cast("long")
    return rows.withColumn("case_name", F.concat(F.lit("C"), F.lpad(h.cast("string"), 9, "0"), check_letter(h)))


def anchored(cases: DataFrame, sources: list[DataFrame], widest_h: tuple[float, float], extra: DataFrame | None = None) -> DataFrame:
    """All sources' events (entity_id, item, value, t_event, kind) of the cases (case_id, entity_id, t0) within the widest window, with hours from t0.

    Events of other systems can be given as extra ones; they are treated alike.
    """
    columns = ["entity_id", "item", "value", "t_event", "kind"]
    union = reduce(DataFrame.unionByName, [s.select(*columns) for s in [*sources, *([extra] if extra is not None else [])]])
    near = union.join(cases.select("case_id", "entity_id", "t0"), "entity_id").withColumn("hours", hours_between("t0", "t_event"))
    return near.filter(F.col("hours").between(*widest_h)).select("case_id", "item", "value", "kind", "hours")


def exposure(anchors: DataFrame, start_h: str) -> DataFrame:
    """case_id, item, inside, outside: whether an item occurs since the encounter's start, and before it."""
    inside = F.col("hours") >= F.col(start_h)
    return anchors.groupBy("case_id", "item").agg(F.bool_or(inside).alias("inside"), F.bool_or(~inside).alias("outside"))


def leaf_flags(anchors: DataFrame, cases: DataFrame, leaves: dict[str, str]) -> DataFrame:
    """case_id and a column for each leaf: whether an event meets its condition."""
    seen = anchors.groupBy("case_id").agg(*[F.coalesce(F.bool_or(F.expr(c)), F.lit(False)).alias(n) for n, c in leaves.items()])
    return cases.select("case_id").join(seen, "case_id", "left").select("case_id", *[F.coalesce(n, F.lit(False)).alias(n) for n in leaves])


def tree(node, leaf) -> Column:
    """A rule as nested lists, ['or', a, ['and', b, c]], over what leaf gives for a name."""
    if isinstance(node, str):
        return leaf(node)
    op, *parts = node
    return reduce((lambda a, b: a | b) if op == "or" else (lambda a, b: a & b), [tree(p, leaf) for p in parts])


def labels(flags: DataFrame, rules: dict[str, object], satisfiable: dict[str, bool] | None = None) -> DataFrame:
    """case_id and each label by its rule; null throughout where its rule can't be met by what is mapped and observed."""
    can = satisfiable or {}
    return flags.select("case_id", *[(tree(r, F.col) if can.get(n, True) else F.lit(None).cast("boolean")).alias(n) for n, r in rules.items()])


def coverage(anchors: DataFrame, leaves: dict[str, str], items: dict[str, str], mapped: set[str]) -> DataFrame:
    """leaf, item, n rows of the item, status: unmapped, unobserved or observed."""
    spark = anchors.sparkSession
    rows = spark.createDataFrame([(n, items[n], items[n] in mapped) for n in leaves], "leaf string, item string, mapped boolean")
    counts = anchors.groupBy("item").agg(F.count("*").alias("n"))
    out = rows.join(counts, "item", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("leaf", "item", "n", F.when(~F.col("mapped"), "unmapped").when(F.col("n") == 0, "unobserved").otherwise("observed").alias("status"))


def satisfiable(status: DataFrame, rules: dict[str, object]) -> dict[str, bool]:
    """Of each rule, whether the observed leaves can meet it. Leaves are those of the rules: a few rows."""
    seen = {r["leaf"] for r in status.filter("status = 'observed'").collect()}

    def can(node) -> bool:
        if isinstance(node, str):
            return node in seen
        op, *parts = node
        return any(map(can, parts)) if op == "or" else all(map(can, parts))

    return {name: can(rule) for name, rule in rules.items()}


def nodes(flags: DataFrame, rules: dict[str, object]) -> DataFrame:
    """case_id and every node of every rule by itself, named by its path: rule, then the number of each part."""
    out: dict[str, Column] = {}

    def walk(name: str, node) -> None:
        out[name] = tree(node, F.col)
        if not isinstance(node, str):
            for i, part in enumerate(node[1:]):
                walk(f"{name}_{i}", part)

    for name, rule in rules.items():
        walk(name, rule)
    return flags.select("case_id", *[c.alias(n) for n, c in out.items()])


@dataclass(frozen=True)
class Extraction:
    """labels (case_id and a column each), how many events had a reason to go, and how the leaves are covered by what stayed."""

    labels: DataFrame
    removed: DataFrame
    coverage: DataFrame


def extract(
    anchors: DataFrame,
    cases: DataFrame,
    reason: Column,
    leaves: dict[str, str],
    items: dict[str, str],
    mapped: set[str],
    rules: dict[str, object],
    derived: dict[str, Column] | None = None,
    sources: DataFrame | None = None,
    least: float = 0.5,
    keep_if_present: bool = False,
) -> Extraction:
    """From anchored events to labels: events with a reason are no evidence and go; rules are asked of what stays, and are null where
    that can't meet them; a label that isn't positive is null in a bin of cases where its source is seldom there; then labels that
    derive from labels.

    sources (case_id, bin, has_source): a bin's share of cases with a source must be ``least``; a case's own source may speak for it.
    """
    kept, gone = removed(anchors, reason)
    status = coverage(kept, leaves, items, mapped)
    out = labels(leaf_flags(kept, cases, leaves), rules, satisfiable(status, rules))
    if sources is not None:
        shares = sources.groupBy(F.col("bin").alias("_bin")).agg(F.avg(F.coalesce(F.col("has_source"), F.lit(False)).cast("double")).alias("_share"))
        own = sources.select(F.col("case_id").alias("_case"), "bin", F.coalesce(F.col("has_source"), F.lit(False)).alias("_has")).join(shares, F.col("bin").eqNullSafe(F.col("_bin")))
        thin = F.coalesce(F.col("_share") < least, F.lit(False))
        if keep_if_present:
            thin = thin & ~F.coalesce("_has", F.lit(False))
        marked = out.join(own.select("_case", "_share", "_has"), F.col("case_id") == F.col("_case"), "left")
        out = marked.select("case_id", *[F.when(~thin | F.coalesce(n, F.lit(False)), F.col(n)).alias(n) for n in rules])
    return Extraction(out.withColumns(derived or {}), gone, status)

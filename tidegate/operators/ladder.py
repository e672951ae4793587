"""Models scored out of fold: imputation and scaling fitted on training rows only, logistic heads, controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.expressions import log_loss, logit, portable_hash
from tidegate.operators import fits, isotonic, ranks


def fitted(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float]]:
    """Median, and mean and deviation after imputing by it, of each column: three numbers a column."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")).select("v.*")
    m = dict.fromkeys(columns) | {r["c"]: r["m"] for r in ranks.quantiles(long, ["c"], "x", {"m": 0.5}).collect()}
    filled = train.select(*[F.coalesce(c, F.lit(m[c])).alias(c) for c in columns])
    s = filled.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (m[c], s[f"m_{c}"], s[f"s_{c}"]) for c in columns}


def prepared(rows: DataFrame, params: dict[str, tuple[float, float, float]], keep: list[str], clip: float = 5.0) -> DataFrame:
    """Imputed, scaled and clipped columns with indicators of what was missing; constant and empty columns go."""
    out = [F.col(k) for k in keep]
    for c, (median, mean, sd) in params.items():
        if median is not None and sd:
            out.append(F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.coalesce(c, F.lit(median)) - mean) / sd)).alias(c))
            out.append(F.col(c).isNull().cast("double").alias(f"{c}__miss"))
    return rows.select(*out)


def out_of_fold(rows: DataFrame, columns: list[str], y: str, fold: str, entity: str, reg: float = 0.01, least: int = 3) -> DataFrame:
    """entity, fold, y, p: each fold's rows scored by a logistic head of the others, or by their smoothed share if a class is thin.

    Folds are a handful: a loop over them on the driver, each step a distributed fit.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scored = None
    for (f,) in rows.select(fold).distinct().orderBy(fold).collect():
        dev, held = rows.filter((F.col(fold) != f) & F.col(y).isNotNull()), rows.filter(F.col(fold) == f)
        n, n1 = dev.agg(F.count("*"), F.sum(y)).first()
        if min(n1 or 0, n - (n1 or 0)) < least:
            one = held.select(entity, fold, y, F.lit(((n1 or 0) + 0.5) / (n + 1)).alias("p"))
        else:
            params = fitted(dev, columns)
            keep = [entity, fold, y]
            a, b = prepared(dev, params, keep), prepared(held, params, keep)
            vector = VectorAssembler(inputCols=[c for c in a.columns if c not in keep], outputCol="_x")
            head = LogisticRegression(featuresCol="_x", labelCol=y, regParam=reg, standardization=False, maxIter=50).fit(vector.transform(a))
            p = head.transform(vector.transform(b))
            one = p.select(entity, fold, y, F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
        scored = one if scored is None else scored.unionByName(one)
    return scored


def drawn_roles(rows: DataFrame, site: str, entity: str, dev: float, seed: int) -> DataFrame:
    """role dev for the first rounded share of each site by hash, eval for the rest."""
    placed = ranks.ranked(rows.withColumn("_h", portable_hash(F.lit(str(seed)), F.col(entity).cast("string"))), [site], ["_h", entity])
    return placed.withColumn("role", F.when(F.col("_rank") <= F.round(F.col("_size") * dev), "dev").otherwise("eval")).drop("_h", "_rank", "_size")


def permuted(rows: DataFrame, within: list[str], entity: str, value: str, seed: int) -> DataFrame:
    """value dealt anew within groups: the row that is k-th by id gets the value of the k-th by hash."""
    a = ranks.ranked(rows.drop(value), within, [entity]).drop("_size")
    hashed = rows.select(*within, entity, value, portable_hash(F.lit(str(seed)), F.col(entity).cast("string")).alias("_h"))
    b = ranks.ranked(hashed, within, ["_h", entity]).select(*within, value, "_rank")
    return a.join(b, [*within, "_rank"]).drop("_rank")


def concentration(deltas: DataFrame, site: str) -> DataFrame:
    """The largest site's share of all gain, of rows (site, delta); a delta below zero is a gain."""
    gain = deltas.groupBy(site).agg(F.greatest(F.lit(0.0), -F.sum("delta")).alias("g"))
    return gain.agg(F.count("*").alias("sites"), F.try_divide(F.max("g"), F.sum("g")).alias("share"))


def recalibrated(rows: DataFrame, label: str, role: str, p: str = "p", y: str = "y", least: int = 20, method: str = "platt") -> DataFrame:
    """Adds recalibrated, fitted on each label's dev rows and applied to all: a line in the logit (platt, with a penalty of 1/1000 on
    its slope, so that a separating p has a line too) or steps (isotonic). p itself where dev has fewer than ``least`` of either outcome.
    """
    assert method in ("platt", "isotonic", "none"), method
    dev = rows.filter((F.col(role) == "dev") & F.col(y).isNotNull() & F.col(p).isNotNull())
    enough = dev.groupBy(F.col(label).alias("_l")).agg(F.count_if(F.col(y) == 1).alias("_a"), F.count_if(F.col(y) == 0).alias("_b")).filter((F.col("_a") >= least) & (F.col("_b") >= least)).select("_l")
    if method == "none":
        return rows.withColumn("recalibrated", F.col(p))
    dev = dev.join(enough, F.col(label).eqNullSafe(F.col("_l"))).drop("_l")
    if method == "isotonic":
        out = isotonic.applied(rows, label, p, isotonic.steps(dev, label, p, y), "_iso")
        return out.withColumn("recalibrated", F.coalesce("_iso", p)).drop("_iso")
    found = fits.logistic(fits.design(dev, [label], F.col(y), [F.lit(1.0), logit(F.col(p))]), 2, [fits.Variant((0, 1), ridge=(0.0, 1e-3))])
    lines = {key: (float(f.coef[0]), float(f.coef[1])) for (key, _), f in found.items() if f.converged}
    table = fits.told(rows.sparkSession, lines, fits.groups(dev, [label]).withColumnRenamed(label, "_l"), ["_i", "_s"], "_i double, _s double")
    out = rows.join(table, F.col(label).eqNullSafe(F.col("_l")), "left")
    return out.withColumn("recalibrated", F.coalesce(1 / (1 + F.exp(-(F.col("_i") + F.col("_s") * logit(F.col(p))))), F.col(p))).drop("_i", "_s", "_l")


def exposure_accounting(rows: DataFrame, exposures: DataFrame, site: str, entity: str) -> DataFrame:
    """component, site, n, n_exposed: rows whose entity a component has seen. Rows without a site are counted under null."""
    seen = exposures.select(F.col("component"), F.col(entity).alias("_e")).distinct()
    names = exposures.select("component").distinct()
    totals = rows.groupBy(site).agg(F.count("*").alias("n"))
    hit = rows.join(seen, F.col(entity) == F.col("_e")).groupBy(F.col("component").alias("_c"), F.col(site).alias("_s")).agg(F.count("*").alias("_k"))
    every = totals.crossJoin(names)  # components and sites are a few each
    return every.join(hit, (F.col("component") == F.col("_c")) & F.col(site).eqNullSafe(F.col("_s")), "left").select("component", F.col(site).alias("site"), "n", F.coalesce("_k", F.lit(0)).alias("n_exposed"))


def scored_subgroups(rows: DataFrame, masks: dict[str, str], a: str, b: str, y: str) -> DataFrame:
    """subgroup, n, loss_a, loss_b, delta of the same predictions: nothing is fitted again. A row counts in each subgroup that it is in."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(m), F.lit(False)), F.lit(n)) for n, m in masks.items()]))
    long = rows.filter(F.col(y).isNotNull()).withColumn("subgroup", F.explode(names))
    la, lb = F.avg(log_loss(F.col(y), F.col(a))), F.avg(log_loss(F.col(y), F.col(b)))
    return long.groupBy("subgroup").agg(F.count("*").alias("n"), la.alias("loss_a"), lb.alias("loss_b"), (lb - la).alias("delta"))


def aggregate_table(results: DataFrame, by: list[str], n: str, values: list[str], k: int = 11) -> DataFrame:
    """by, n and values; a row of fewer than k has neither, and says so."""
    small = F.coalesce(F.col(n) < k, F.lit(True))
    return results.select(*by, F.when(~small, F.col(n)).alias(n), *[F.when(~small, F.col(v)).alias(v) for v in values], small.alias("suppressed"))

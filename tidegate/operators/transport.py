"""Transport weights: a domain model that never saw the row it scores, inverse odds trimmed at ranked percentiles, and balance."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.expressions import portable_hash
from tidegate.operators import fits, ranks
from tidegate.sources.shared import written

TRIM = (0.01, 0.99)


def filled(rows: DataFrame, covariates: list[str]) -> tuple[DataFrame, list[str]]:
    """Covariates as doubles, unknown ones as the median with a column <name>_missing where there are any; constant columns go."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in covariates])).alias("v")).select("v.*")
    median = {r["c"]: r["m"] for r in ranks.quantiles(long.filter(~F.isnan("x")), ["c"], "x", {"m": 0.5}).collect()}
    known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in covariates}
    out = rows.withColumns({f"{c}_missing": known[c].isNull().cast("double") for c in covariates}).withColumns({c: F.coalesce(known[c], F.lit(median.get(c, 0.0))) for c in covariates})
    names = [n for c in covariates for n in (c, f"{c}_missing")]
    r = out.agg(*[F.min(n).alias(f"a_{n}") for n in names], *[F.max(n).alias(f"b_{n}") for n in names]).first()
    varied = [n for n in names if r[f"a_{n}"] is not None and r[f"a_{n}"] < r[f"b_{n}"]]
    return out.drop(*[n for n in names if n not in varied and n.endswith("_missing")]), varied


def dealt(rows: DataFrame, z: str, site: str, entity: str, folds: int, seed: int) -> tuple[DataFrame, int]:
    """Adds fold, even over each (site, z); over z alone if a stratum is too small for two folds. The number of folds is 0 if that fails."""
    for by in ([site, z], [z]):
        sizes = rows.groupBy(*by).count().agg(F.min("count").alias("m"), F.count_distinct(z).alias("k")).first()
        k = min(folds, sizes["m"] or 0) if sizes["k"] == 2 else 0
        if k > 1:
            placed = ranks.ranked(rows.withColumn("_h", portable_hash(F.lit(str(seed)), F.col(entity).cast("string"))), by, ["_h", entity])
            return placed.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_h", "_rank", "_size"), k
    return rows.withColumn("fold", F.lit(None).cast("int")), 0


def domain_scores(rows: DataFrame, covariates: list[str], z: str, site: str, entity: str, folds: int = 5, seed: int = 0, ridge: float = 1.0) -> tuple[DataFrame, list[str]]:
    """Rows with filled covariates, fold and p: P(z = 1) by a logistic model of the other folds' rows, in columns scaled on these, with
    a penalty on all but the intercept; and the columns in use. All folds' models share their passes. p is null where there are too few
    rows of a class."""
    full, names = filled(rows.filter(F.col(z).isNotNull()), covariates)
    full, k = dealt(full, z, site, entity, folds, seed)
    full = written(full, "domain")
    if not k or not names:
        return full.withColumn("p", F.lit(None).cast("double")), names
    columns = [F.lit(1.0), *[F.col(n) for n in names]]
    sums = full.groupBy("fold").agg(F.count("*").alias("n"), *[f(n).alias(f"{a}{i}") for i, n in enumerate(names) for a, f in (("s", F.sum), ("q", lambda c: F.sum(F.col(c) * F.col(c))))]).collect()
    data = fits.design(full, ["fold"], F.col(z).cast("double"), columns)
    models = []
    for f in range(k):
        others = [r for r in sums if r["fold"] != f]
        n = sum(r["n"] for r in others)
        mean = np.array([sum(r[f"s{i}"] for r in others) / n for i in range(len(names))])
        sd2 = np.array([sum(r[f"q{i}"] for r in others) / n for i in range(len(names))]) - mean**2
        # a penalty on the scaled column's coefficient; one that is constant in these rows is held at nothing
        penalty = [ridge * float(v) if v > 1e-12 * (1 + m * m) else 1e12 for v, m in zip(sd2, mean)]
        models.append(fits.Model(fits.Variant(tuple(range(len(columns))), ridge=(0.0, *penalty)), frozenset(json.dumps([str(g)], separators=(",", ":")) for g in range(k) if g != f)))
    found = [(f, fit.coef.tolist()) for f, fit in enumerate(fits.many(data, len(columns), models)) if fit is not None and fit.converged]
    table = rows.sparkSession.createDataFrame(found, "_f int, _b array<double>")  # a row for each fold
    eta = F.aggregate(F.zip_with(F.array(*columns), "_b", lambda x, b: x * b), F.lit(0.0), lambda a, x: a + x)
    return full.join(table, F.col("fold") == F.col("_f"), "left").withColumn("p", 1 / (1 + F.exp(-eta))).drop("_f", "_b"), names


def inverse_odds(rows: DataFrame, z: str, p: str, trim: tuple[float, float] = TRIM, eps: float = 1e-3) -> DataFrame:
    """Adds raw, w and trimmed: rows with z = 1 weigh 1, others the odds of p over those of the share of z = 1, held within percentiles
    of these; null where p is unknown."""
    scored = rows.filter(F.col(z).isNotNull() & F.col(p).isNotNull())
    pi = scored.agg(F.avg(F.col(z).cast("double"))).first()[0]
    odds = pi / (1 - pi) if pi is not None and 0 < pi < 1 else None
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    out = rows.withColumn("raw", q / (1 - q) / F.lit(odds).cast("double"))
    other = F.col(z).cast("int") == 0
    low, high = trim
    cut = ranks.quantiles(out.filter(other & F.col(p).isNotNull()).withColumn("_one", F.lit(1)), ["_one"], "raw", {"low": low, "high": high}).first()
    a, b = (F.lit(cut["low"] if cut else None).cast("double"), F.lit(cut["high"] if cut else None).cast("double"))
    held = F.when(F.col("raw").isNotNull() & a.isNotNull(), F.least(F.greatest(F.col("raw"), a), b))
    return out.withColumns({"w": F.when(other, held).when(F.col(z).cast("int") == 1, F.lit(1.0)), "trimmed": F.coalesce(other & ((F.col("raw") < a) | (F.col("raw") > b)), F.lit(False))})


def balance(weighted: DataFrame, covariates: list[str], z: str, w: str = "w") -> DataFrame:
    """covariate, smd_before, smd_after: mean of z = 1 less that of the others, over the root of the mean variance; 0 where both are constant."""
    long = weighted.filter(F.col(w).isNotNull()).select(F.col(z).cast("int").alias("z"), F.col(w).alias("w"), F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in covariates])).alias("v")).select("z", "w", "v.*")
    one, other = F.col("z") == 1, F.col("z") == 0
    x, u = F.col("x"), F.col("w")
    mean = lambda side, weight: F.sum(F.when(side, weight * x)) / F.sum(F.when(side, weight))
    square = lambda side, weight: F.sum(F.when(side, weight * x * x)) / F.sum(F.when(side, weight))
    parts = {"a": (one, F.lit(1.0)), "b": (other, F.lit(1.0)), "c": (other, u)}
    sums = long.groupBy("covariate").agg(*[f(*v).alias(f"{n}{k}") for k, v in parts.items() for n, f in (("m", mean), ("q", square))])
    spread = lambda k: F.greatest(F.lit(0.0), F.col(f"q{k}") - F.col(f"m{k}") * F.col(f"m{k}"))
    smd = lambda k: F.when((spread("a") + spread(k)) > 0, (F.col("ma") - F.col(f"m{k}")) / F.sqrt((spread("a") + spread(k)) / 2)).otherwise(0.0)
    return sums.select("covariate", smd("b").alias("smd_before"), smd("c").alias("smd_after"))


def effective_size(w: Column) -> Column:
    """The number of equal weights that tell as much: aggregate."""
    return F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w))


def weighted_delta(rows: DataFrame, by: list[str], delta: str, w: str) -> DataFrame:
    """by, n, ess, delta (weighted mean) and unweighted, of rows with a known delta and weight."""
    known = rows.filter(F.col(delta).isNotNull() & F.col(w).isNotNull())
    return known.groupBy(*by).agg(F.count("*").alias("n"), effective_size(F.col(w)).alias("ess"), (F.sum(F.col(w) * F.col(delta)) / F.sum(w)).alias("delta"), F.avg(delta).alias("unweighted"))

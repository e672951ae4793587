"""Logistic and linear fits by sums over rows: many fits of the same rows at once, each knowing whether it failed.

A step of all fits is one pass: tasks add up gradients, curvatures and likelihoods of their rows for every group and variant, the sums
meet in two levels, and the driver, which holds a few numbers for each fit and refuses more than ``LIMIT``, makes the steps. A step
that lowers the likelihood is halved. A fit that doesn't settle, is singular, or without a penalty reaches a coefficient above
``LARGEST`` (outcomes that a line separates) hasn't converged and gives no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.expressions import clipped, logit
from tidegate.sources.shared import Scratch

PASSES, LARGEST, SETTLED = 100, 30.0, 1e-8
#: Numbers that all fits together may bring to the driver in a pass, and parts of a fit's sums that are added before they meet.
LIMIT, PARTS = 4_000_000, 32


@dataclass(frozen=True)
class Variant:
    """Which of the columns are free; which are fixed at a coefficient (an offset has 1); the penalty, half of it times the square."""

    free: tuple[int, ...]
    fixed: tuple[tuple[int, float], ...] = ()
    ridge: tuple[float, ...] = ()  # of each free column; none if empty

    def penalty(self) -> np.ndarray:
        return np.array(self.ridge or [0.0] * len(self.free))


@dataclass
class Fit:
    """coef of the free columns and their covariance; likelihood of the rows without the penalty; None where it failed."""

    n: int
    beta: np.ndarray
    best: np.ndarray
    step: np.ndarray
    high: float = -math.inf
    likelihood: float = 0.0
    converged: bool = False
    over: bool = False
    cov: np.ndarray | None = None
    passes: int = field(default=0)

    @property
    def coef(self) -> np.ndarray | None:
        return self.best if self.converged else None


def design(rows: DataFrame, by: list[str], y: Column, columns: list[Column], weight: Column | None = None) -> DataFrame:
    """key (the group as text), y, x, w of the rows whose outcome is known; ``summed`` leaves out those with an unknown column. A first
    column of ones is the intercept."""
    key = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in by])) if by else F.lit("[]")
    x = F.array(*[c.cast("double") for c in columns])
    out = rows.select(key.alias("key"), y.cast("double").alias("y"), x.alias("x"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    return out.filter(F.col("y").isNotNull())


def summed(data: DataFrame, width: int, of_rows) -> dict[tuple[str, int], np.ndarray]:
    """of_rows(key, X, y, w) gives (number, sums) for rows of a group; the sums of all rows, for each group and number."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            y, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            keys = b.column("key").dictionary_encode()
            # a filter in Spark on so many columns would be rewritten in every combination of their aliases
            known = np.isfinite(x).all(1) & np.isfinite(y) & np.isfinite(w)
            number = np.where(known, keys.indices.to_numpy(), -1)
            for i, key in enumerate(keys.dictionary.to_pylist()):
                at = number == i
                if not at.any():
                    continue
                for k, s in of_rows(key, x[at], y[at], w[at]):
                    total[key, k] = total[key, k] + s if (key, k) in total else s
        if total:
            yield sums_batch([(k, v, s) for (k, v), s in total.items()])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in batches:
            out = []
            for key, number, s in zip(b.column("key").to_pylist(), b.column("number").to_pylist(), b.column("s").to_pylist()):
                if (key, number) != now:
                    if now is not None:
                        out.append((*now, total))
                    now, total = (key, number), np.zeros(len(s))
                total = total + np.array(s)
            if out:
                yield sums_batch(out)
        if now is not None:
            yield sums_batch([(*now, total)])

    kind = "key string, number int, s array<double>"
    first = data.mapInArrow(parts, kind).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    second = first.repartition("key", "number", "part").sortWithinPartitions("key", "number", "part").select("key", "number", "s").mapInArrow(added, kind)
    out: dict[tuple[str, int], np.ndarray] = {}
    for r in second.toLocalIterator():
        k = (r["key"], r["number"])
        out[k] = out[k] + np.array(r["s"]) if k in out else np.array(r["s"])
        if sum(v.size for v in out.values()) > LIMIT:
            raise ValueError(f"these fits need more than {LIMIT} numbers at once: fit fewer groups, variants or columns together")
    return out


def sums_batch(rows: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
    a, b, c = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array([x.tolist() for x in c], pa.list_(pa.float64()))], ["key", "number", "s"])


def logistic(data: DataFrame, width: int, variants: list[Variant]) -> dict[tuple[str, int], Fit]:
    """Fits of each group of a design() and variant, by the group's key and the variant's number."""
    keep = Scratch(data.sparkSession)
    data = keep(data, "design")
    fits: dict[tuple[str, int], Fit] = {}
    starts = {i: np.zeros(len(v.free)) for i, v in enumerate(variants)}
    for _ in range(PASSES):
        active = {k: f.beta for k, f in fits.items() if not f.over}
        if fits and not active:
            break
        first = not fits

        def of_rows(key, x, y, w):
            for i, v in enumerate(variants):
                beta = starts[i] if first else active.get((key, i))
                if beta is None:
                    continue
                free = x[:, list(v.free)]
                eta = free @ beta + sum((x[:, c] * b for c, b in v.fixed), np.zeros(len(y)))
                mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                h = (free * (w * mu * (1 - mu))[:, None]).T @ free
                yield i, np.concatenate([[len(y), (w * (y * eta - np.logaddexp(0, eta))).sum()], free.T @ (w * (y - mu)), h.ravel()])

        for (key, i), s in summed(data, width, of_rows).items():
            v, p = variants[i], len(variants[i].free)
            f = fits.setdefault((key, i), Fit(int(s[0]), starts[i], starts[i], np.zeros(p)))
            moved(f, v, s[1], s[2 : 2 + p], s[2 + p :].reshape(p, p))
    keep.drop(data)
    return fits


def moved(f: Fit, v: Variant, likelihood: float, gradient: np.ndarray, curvature: np.ndarray) -> None:
    """One fit's next place, or its end."""
    f.passes += 1
    penalty = v.penalty()
    high = likelihood - 0.5 * float((penalty * f.beta**2).sum())
    if not math.isfinite(high) or high < f.high - 1e-10 * (1 + abs(f.high)):
        f.step = f.step / 2
        f.beta = f.best + f.step
        f.over = abs(f.step).max(initial=0) < SETTLED * 1e-3  # no step raises it
        return
    f.best, f.high, f.likelihood = f.beta, high, likelihood
    h = curvature + np.diag(penalty)
    try:
        f.step = np.linalg.solve(h, gradient - penalty * f.beta)
        f.cov = np.linalg.inv(h)
    except np.linalg.LinAlgError:
        f.over = True
        return
    if not np.isfinite(f.step).all() or (abs(f.best).max(initial=0) > LARGEST and not penalty.any()):
        f.over = True
    elif abs(f.step).max(initial=0) < SETTLED:
        f.over = f.converged = True
    else:
        f.beta = f.best + f.step


def linear(data: DataFrame, width: int) -> dict[str, tuple[int, np.ndarray | None]]:
    """Least squares of each group of a design(): rows, and coefficients by the normal equations; None where they are singular."""

    def of_rows(key, x, y, w):
        yield 0, np.concatenate([[len(y)], x.T @ (w * y), ((x * w[:, None]).T @ x).ravel()])

    out = {}
    for (key, _), s in summed(data, width, of_rows).items():
        h = s[1 + width :].reshape(width, width)
        scale = np.sqrt(np.maximum(np.diag(h), 1e-300))
        singular = np.linalg.matrix_rank(h / np.outer(scale, scale), hermitian=True) < width
        out[key] = (int(s[0]), None if singular else np.linalg.solve(h, s[1 : 1 + width]))
    return out


def told(spark, found: dict[str, tuple], by: DataFrame, columns: list[str], kinds: str) -> DataFrame:
    """Rows of the groups in ``by`` (with their key) with what was found for each."""
    table = spark.createDataFrame([(k, *v) for k, v in found.items()], "_key string, " + kinds)
    return by.join(table, by["key"] == table["_key"], "left").drop("key", "_key").select(*[c for c in by.columns if c != "key" and c not in columns], *columns)


def groups(rows: DataFrame, by: list[str], *measures: Column) -> DataFrame:
    """Each group with its key as design() has it, and measures."""
    key = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in by])) if by else F.lit("[]")
    return (rows.groupBy(*by).agg(*measures) if measures else rows.select(*by).distinct()).withColumn("key", key)


def number(x: float | None) -> float | None:
    return None if x is None or not math.isfinite(x) else float(x)


def calibration_line(rows: DataFrame, by: list[str], y: str = "y", p: str = "p", level: float = 0.95) -> DataFrame:
    """by, n, n_events, observed_expected; slope with se, low and high, intercept; large (the intercept at slope 1) with se; converged.

    The line's numbers are null where its fit failed, as on outcomes that p separates; large's where one outcome is all there is.
    """
    known = rows.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    data = design(known, by, F.col(y), [F.lit(1.0), logit(F.col(p))])
    got = logistic(data, 2, [Variant((0, 1)), Variant((0,), ((1, 1.0),))])
    z = NormalDist().inv_cdf((1 + level) / 2)
    found = {}
    for key in {k for k, _ in got}:
        line, large = got[key, 0], got[key, 1]
        se = [math.sqrt(c) if c > 0 else None for c in np.diag(line.cov)] if line.converged else [None, None]
        b = line.coef if line.converged and se[1] is not None else [None, None]
        low, high = (b[1] - z * se[1], b[1] + z * se[1]) if b[1] is not None else (None, None)
        c = (large.coef[0], math.sqrt(large.cov[0, 0])) if large.converged else (None, None)
        found[key] = (*map(number, (b[1], se[1], low, high, b[0], *c)), bool(line.converged))
    events = F.sum(F.col(y).cast("double"))
    each = groups(known, by, F.count("*").alias("n"), events.cast("long").alias("n_events"), (events / F.sum(clipped(F.col(p)))).alias("observed_expected"))
    columns = ["slope", "slope_se", "slope_low", "slope_high", "intercept", "large", "large_se"]
    kinds = ", ".join(f"{c} double" for c in columns) + ", converged boolean"
    return told(rows.sparkSession, found, each, ["n", "n_events", "observed_expected", *columns, "converged"], kinds)


def shifts(rows: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """by, n, shift: the intercept that fits y to logit p at slope 1; null where one outcome is all there is."""
    known = rows.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    got = logistic(design(known, by, F.col(y), [F.lit(1.0), logit(F.col(p))]), 2, [Variant((0,), ((1, 1.0),))])
    found = {key: (number(f.coef[0]) if f.converged else None,) for (key, _), f in got.items()}
    return told(rows.sparkSession, found, groups(known, by, F.count("*").alias("n")), ["n", "shift"], "shift double")


def cross_shifts(rows: DataFrame, by: list[str], site: str, y: str, p: str, least: int = 11) -> DataFrame:
    """by, site, mode, shift: of each site, fitted on the others of the group (cross) if there are two or more and each has at least
    ``least`` rows of either outcome, else on all rows (insample). A row counts for each other site, of which there are few."""
    known = rows.filter(F.col(y).isNotNull() & F.col(p).isNotNull() & F.col(site).isNotNull())
    own = known.groupBy(*by, site).agg(F.count_if(F.col(y) == 1).alias("_a"), F.count_if(F.col(y) == 0).alias("_b"))
    modes = own.groupBy(*by).agg(F.when((F.count("*") > 1) & F.bool_and((F.col("_a") >= least) & (F.col("_b") >= least)), "cross").otherwise("insample").alias("mode"), F.collect_set(site).alias("_sites"))
    same = lambda c: F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    named = modes.select(*[F.col(c).alias(f"_by_{c}") for c in by], "mode", "_sites")
    on = reduce(lambda a, b: a & b, [same(c) for c in by], F.lit(True))
    each = known.join(named, on).withColumn("_for", F.explode("_sites")).filter((F.col("mode") == "insample") | (F.col("_for") != F.col(site)))
    out = shifts(each.select(*by, "_for", "mode", y, p), [*by, "_for", "mode"], y, p)
    return out.select(*by, F.col("_for").alias(site), "mode", "shift")


def adjusted_interaction(rows: DataFrame, by: list[str], delta: str, early: str, covariates: list[Column]) -> DataFrame:
    """by, n, n_early, n_late, adjusted: the coefficient of ``early`` in a linear fit of a delta on it and the covariates.

    Null if one side is empty or the columns are dependent.
    """
    e = F.expr(early)
    known = rows.filter(F.col(delta).isNotNull() & e.isNotNull())
    columns = [F.lit(1.0), e.cast("double"), *covariates]
    found = {key: (n, number(b[1]) if b is not None else None) for key, (n, b) in linear(design(known, by, F.col(delta), columns), len(columns)).items()}
    each = groups(known, by, F.count_if(e).alias("n_early"), F.count_if(~e).alias("n_late"))
    return told(rows.sparkSession, found, each, ["n", "n_early", "n_late", "adjusted"], "n long, adjusted double")


@dataclass(frozen=True)
class Model:
    """A variant fitted to the rows of some groups together."""

    variant: Variant
    keys: frozenset[str]


def many(data: DataFrame, width: int, models: list[Model]) -> list[Fit | None]:
    """Fits of models that share the rows of a design(): each step of all of them is one pass. None where a model has no row."""
    fits: list[Fit | None] = [None] * len(models)
    for _ in range(PASSES):
        betas = [np.zeros(len(m.variant.free)) if f is None else f.beta for m, f in zip(models, fits)]
        active = [i for i, f in enumerate(fits) if f is None or not f.over]
        if not active:
            break

        def of_rows(key, x, y, w):
            for i in active:
                if key not in models[i].keys:
                    continue
                v = models[i].variant
                free = x[:, list(v.free)]
                eta = free @ betas[i] + sum((x[:, c] * b for c, b in v.fixed), np.zeros(len(y)))
                mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                h = (free * (w * mu * (1 - mu))[:, None]).T @ free
                yield i, np.concatenate([[len(y), (w * (y * eta - np.logaddexp(0, eta))).sum()], free.T @ (w * (y - mu)), h.ravel()])

        got = together(summed(data, width, of_rows))
        for i in active:
            if i not in got:
                continue
            s, p = got[i], len(models[i].variant.free)
            if fits[i] is None:
                fits[i] = Fit(int(s[0]), betas[i], betas[i], np.zeros(p))
            moved(fits[i], models[i].variant, s[1], s[2 : 2 + p], s[2 + p :].reshape(p, p))
        if all(f is None for f in fits):
            break
    return fits


def together(sums: dict[tuple[str, int], np.ndarray]) -> dict[int, np.ndarray]:
    """Sums of each number over the groups."""
    out: dict[int, np.ndarray] = {}
    for (_, i), s in sums.items():
        out[i] = out[i] + s if i in out else s
    return out


def losses(data: DataFrame, width: int, scored: list[tuple[Variant, np.ndarray, frozenset[str]]]) -> list[float | None]:
    """Weighted mean log loss of each (variant, coefficients) on the rows of its groups, in one pass; None without rows."""

    def of_rows(key, x, y, w):
        for i, (v, beta, keys) in enumerate(scored):
            if key in keys:
                eta = x[:, list(v.free)] @ beta + sum((x[:, c] * b for c, b in v.fixed), np.zeros(len(y)))
                yield i, np.array([w.sum(), (w * (np.logaddexp(0, eta) - y * eta)).sum()])

    got = together(summed(data, width, of_rows))
    return [float(got[i][1] / got[i][0]) if i in got and got[i][0] > 0 else None for i in range(len(scored))]

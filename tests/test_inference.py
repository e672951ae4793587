"""Fits and intervals against plain versions and known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import fits, inference, isotonic, ladder


def plain_line(y, x, slope_free=True):
    """Newton steps on all rows: intercept and slope, or the intercept at slope 1."""
    b = np.array([0.0, 0.0 if slope_free else 1.0])
    for _ in range(100):
        mu = 1 / (1 + np.exp(-(b[0] + b[1] * x)))
        design = np.stack([np.ones_like(x), x], 1)[:, : 2 if slope_free else 1]
        step = np.linalg.solve(design.T @ (design * (mu * (1 - mu))[:, None]), design.T @ (y - mu))
        b[: step.size] += step
    return b


def test_calibration_lines_equal_a_plain_fit(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for g, (a, b, n) in {"a": (0.3, 0.6, 400), "b": (-1.0, 1.8, 90)}.items():
        p = rng.uniform(0.03, 0.97, n)
        x = np.log(p / (1 - p))
        y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(a + b * x)))).astype(float)
        rows += [(g, float(i), float(j)) for i, j in zip(y, p)]
        line, large = plain_line(y, x), plain_line(y, x, False)[0]
        mu = 1 / (1 + np.exp(-(line[0] + line[1] * x)))
        design = np.stack([np.ones_like(x), x], 1)
        se = np.sqrt(np.linalg.inv(design.T @ (design * (mu * (1 - mu))[:, None]))[1, 1])
        nu = 1 / (1 + np.exp(-(large + x)))
        want[g] = [line[1], se, line[1] - 1.959964 * se, line[1] + 1.959964 * se, line[0], large, 1 / np.sqrt((nu * (1 - nu)).sum()), y.sum() / p.sum()]
    rows += [("one sided", 1.0, 0.4), ("one sided", 1.0, 0.7), ("a", None, 0.5), ("b", 1.0, None), (None, 1.0, 0.5)]
    apart = [("apart", float(p > 0.5), p) for p in rng.uniform(0.03, 0.97, 200).tolist()]
    got = {r["g"]: r for r in fits.calibration_line(spark.createDataFrame(rows + apart, "g string, y double, p double").repartition(5), ["g"]).collect()}
    names = ["slope", "slope_se", "slope_low", "slope_high", "intercept", "large", "large_se", "observed_expected"]
    for g, line in want.items():
        assert got[g]["converged"] and np.allclose([got[g][c] for c in names], line, atol=1e-6)
    assert got["a"]["n"] == 400 and set(got) == {"a", "b", "one sided", "apart", None}
    # outcomes that p separates, and a single outcome, have no line
    for g in ("apart", "one sided", None):
        assert not got[g]["converged"] and got[g]["slope"] is None and got[g]["slope_se"] is None and got[g]["intercept"] is None
    assert got["apart"]["large"] is not None and got["one sided"]["large"] is None and abs(got["one sided"]["observed_expected"] - 2 / 1.1) < 1e-9


def test_many_fits_of_one_pass(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 3))
    y = (rng.uniform(size=500) < 1 / (1 + np.exp(-x @ [1.0, -2.0, 0.0]))).astype(float)
    group = rng.integers(0, 2, 500)
    df = spark.createDataFrame([(int(g), float(b), *map(float, a)) for g, b, a in zip(group, y, x)], "g int, y double, a double, b double, c double").repartition(3)
    variants = [fits.Variant((0, 1, 2, 3)), fits.Variant((0, 1, 3)), fits.Variant((0, 2), ridge=(0.0, 5.0)), fits.Variant((0, 1), fixed=((2, -2.0),))]
    data = fits.design(df, ["g"], F.col("y"), [F.lit(1.0), F.col("a"), F.col("b"), F.col("c")])
    got = fits.logistic(data, 4, variants)
    for g in (0, 1):
        full, t = np.c_[np.ones((group == g).sum()), x[group == g]], y[group == g]
        for i, v in enumerate(variants):
            d, off, pen = full[:, list(v.free)], sum((full[:, c] * k for c, k in v.fixed), np.zeros(len(t))), v.penalty()
            b = np.zeros(len(v.free))
            for _ in range(60):
                mu = 1 / (1 + np.exp(-(d @ b + off)))
                b = b + np.linalg.solve(d.T @ (d * (mu * (1 - mu))[:, None]) + np.diag(pen), d.T @ (t - mu) - pen * b)
            f = got[f'["{g}"]', i]
            assert f.converged and np.allclose(f.coef, b, atol=1e-7) and f.n == len(t)
            assert abs(f.likelihood - (t * np.log(mu) + (1 - t) * np.log(1 - mu)).sum()) < 1e-6
    assert fits.logistic(data.filter("false"), 4, variants) == {}


def test_adjusted_interaction_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    early, z = rng.integers(0, 2, 300), rng.normal(size=(300, 2))
    d = 0.4 * early + z @ [1.0, -0.5] + rng.normal(size=300)
    rows = [("a", float(v), int(e), float(p), float(q)) for v, e, p, q in zip(d, early, z[:, 0], z[:, 1])] + [("late", 1.0, 0, 0.0, float(i)) for i in range(5)] + [("a", None, 1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, d double, e int, z double, q double").repartition(4)
    got = {r["g"]: r for r in fits.adjusted_interaction(df, ["g"], "d", "e = 1", [F.col("z"), F.col("q")]).collect()}
    want = np.linalg.lstsq(np.c_[np.ones(300), early, z], d, rcond=None)[0][1]
    assert abs(got["a"]["adjusted"] - want) < 1e-9 and (got["a"]["n"], got["a"]["n_early"]) == (300, early.sum()) and got["late"]["adjusted"] is None


def test_cross_fitted_shifts(spark):
    rng = np.random.default_rng(11)
    rows = [(g, s, float(rng.uniform() < 0.2 + 0.5 * p), p) for g, sites in {"big": "xyz", "one": "x", "thin": "xy"}.items() for s in sites for p in rng.uniform(0.1, 0.9, 8 if g == "thin" else 150).tolist()]
    got = {(r["g"], r["s"]): r for r in fits.cross_shifts(spark.createDataFrame(rows, "g string, s string, y double, p double"), ["g"], "s", "y", "p").collect()}
    assert {k: r["mode"] for k, r in got.items()} == {("big", "x"): "cross", ("big", "y"): "cross", ("big", "z"): "cross", ("one", "x"): "insample", ("thin", "x"): "insample", ("thin", "y"): "insample"}
    for (g, s), r in got.items():
        part = np.array([(y, p) for h, t, y, p in rows if h == g and (r["mode"] == "insample" or t != s)])
        assert abs(r["shift"] - plain_line(part[:, 0], np.log(part[:, 1] / (1 - part[:, 1])), False)[0]) < 1e-6


def plain_steps(x, y):
    """Least-squares nondecreasing fit at each distinct x, by the min-max formula of averages."""
    at = sorted(set(x))
    s = np.array([sum(b for a, b in zip(x, y) if a == v) for v in at], float)
    n = np.array([sum(a == v for a in x) for v in at], float)
    cs, cn = np.r_[0, s.cumsum()], np.r_[0, n.cumsum()]
    value = [max(min((cs[k + 1] - cs[j]) / (cn[k + 1] - cn[j]) for k in range(i, len(at))) for j in range(i + 1)) for i in range(len(at))]
    return np.array(at), np.array(value)


@pytest.mark.parametrize("held", [1_000_000, 0])
def test_isotonic_steps_equal_a_plain_fit(spark, held, monkeypatch):
    monkeypatch.setattr(isotonic, "HELD", held)
    rng = np.random.default_rng(5)
    labels = {"free": rng.uniform(size=120), "tied": rng.integers(0, 9, 150) / 10, "apart": rng.uniform(size=60)}
    rows = [(g, "dev" if i % 3 else "eval", float(x > 0.5) if g == "apart" else float(rng.uniform() < x), float(x)) for g, xs in labels.items() for i, x in enumerate(xs)]
    rows += [("thin", "dev", 1.0, 0.7), ("free", "eval", None, 0.0), ("free", "eval", None, 1.0), ("free", "eval", None, None)]
    df = spark.createDataFrame(rows, "label string, role string, y double, p double").repartition(6)
    got = ladder.recalibrated(df, "label", "role", method="isotonic", least=5).collect()
    assert len(got) == len(rows)
    for g in labels:
        dev = [(p, y) for h, r, y, p in rows if h == g and r == "dev"]
        at, value = plain_steps(*zip(*dev))
        for r in got:
            if r["label"] == g and r["p"] is not None:
                assert abs(r["recalibrated"] - np.interp(r["p"], at, np.clip(value, 1e-6, 1 - 1e-6))) < 1e-9
    assert [r["recalibrated"] for r in got if r["label"] == "thin"] == [0.7] and [r["recalibrated"] for r in got if r["p"] is None] == [None]


@pytest.mark.parametrize("df, q, want", [(1, 0.975, 12.7062), (4, 0.975, 2.776445), (9, 0.95, 1.833113), (30, 0.995, 2.749996), (2, 0.9, 1.885618)])
def test_t_quantiles(df, q, want):
    assert abs(inference.t_quantile(q, df) - want) < 2e-4 * want


def test_site_mean(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "v double")
    r = inference.site_mean(rows, "v").first()
    se = np.std([1, 2, 4], ddof=1) / np.sqrt(3)
    assert (r["n"], r["df"]) == (3, 2) and np.allclose([r["mean"], r["low"], r["high"]], [7 / 3, 7 / 3 - 4.302653 * se, 7 / 3 + 4.302653 * se], atol=1e-4)
    one = inference.site_mean(rows.limit(1), "v").first()
    assert one["n"] == 1 and one["low"] is None


def test_fleiss_by_hand(spark):
    rows = [("l", c, v) for c, vs in {1: [1, 1, 1], 2: [0, 0, 0], 3: [1, 0, 1], 4: [0, 0, 1], 5: [1]}.items() for v in vs]
    r = inference.fleiss(spark.createDataFrame(rows, "label string, case long, v int"), "label", "case", "v").first()
    observed, p = np.mean([1, 1, 1 / 3, 1 / 3]), 6 / 12
    assert r["cases"] == 4 and abs(r["kappa"] - (observed - 0.5) / 0.5) < 1e-9 and p == 0.5


def test_recalibration_equals_a_plain_fit(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        p = float(rng.uniform(0.05, 0.95))
        rows.append(("a", "dev" if i % 2 else "eval", float(rng.uniform() < 0.3 + 0.4 * p), p))
        rows.append(("apart", "dev" if i % 2 else "eval", float(p > 0.5), p))
    rows += [("thin", "dev", 1.0, 0.7), ("thin", "eval", None, 0.2)]
    df = spark.createDataFrame(rows, "label string, role string, y double, p double")
    line = {}
    for label in ("a", "apart"):
        y, p = np.array([(y, p) for g, r, y, p in rows if g == label and r == "dev"]).T
        d, b, pen = np.c_[np.ones_like(p), np.log(p / (1 - p))], np.zeros(2), np.array([0, 1e-3])
        for _ in range(200):  # the penalised likelihood has a top even where p separates the outcomes
            mu = 1 / (1 + np.exp(-d @ b))
            b = b + np.clip(np.linalg.solve(d.T @ (d * (mu * (1 - mu))[:, None]) + np.diag(pen), d.T @ (y - mu) - pen * b), -0.5, 0.5)
        line[label] = b
    for r in ladder.recalibrated(df, "label", "role").collect():
        x = np.log(r["p"] / (1 - r["p"]))
        want = r["p"] if r["label"] == "thin" else 1 / (1 + np.exp(-(line[r["label"]][0] + line[r["label"]][1] * x)))
        assert abs(r["recalibrated"] - want) < 1e-5

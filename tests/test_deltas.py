"""Deltas by stratum and grade, and correlated columns, against plain numpy."""

import numpy as np
from pyspark.sql import functions as F

from tidegate.operators import deltas, summaries


def test_strata_rule(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"s{i % 2}", k, float(rng.normal(m, 0.3))) for k, m, n in (("a", -0.5, 60), ("b", 0.0, 60), ("c", -0.4, 60), ("few", -9.0, 5)) for i in range(n)] + [(99, "s0", "a", None), (98, "s0", None, 1.0)]
    df = spark.createDataFrame(rows, "id int, site string, k string, d double").repartition(3)
    each, rule = deltas.strata_rule(df, "k", "site", "id", "d", 2, 11, 300, 1)
    got = {r["k"]: r for r in each.filter("k IS NOT NULL").collect()}
    for k in "abc":
        x = np.array([r[3] for r in rows if r[2] == k and r[3] is not None])
        assert abs(got[k]["delta"] - x.mean()) < 1e-9 and got[k]["low"] < x.mean() < got[k]["high"] and got[k]["gains"] == (k != "b")
    assert got["few"]["delta"] is None and got["few"]["low"] is None and not got["few"]["gains"]
    r = rule.first()
    assert (r["gaining"], r["met"]) == (2, True)
    assert not deltas.strata_rule(df, "k", "site", "id", "d", 3, 11, 300, 1)[1].first()["met"]


def test_graded(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{i % 3}", int(g), float(-0.2 * g + (i % 3) + rng.normal())) for i, g in enumerate(rng.integers(0, 4, 200))]
    df = spark.createDataFrame([*rows, ("s0", None, 1.0), ("s1", 2, None)], "site string, g int, d double").repartition(3)
    r = deltas.graded(df, "g", "d", "site", 2).first()
    g, d, s = np.array([x[1] for x in rows], float), np.array([x[2] for x in rows]), np.array([x[0] for x in rows])
    cg, cd = g.copy(), d.copy()
    for v in set(s):
        cg[s == v] -= g[s == v].mean()
        cd[s == v] -= d[s == v].mean()
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    want = [np.polyfit(g, d, 1)[0], (cg * cd).sum() / (cg * cg).sum(), d[g < 2].mean(), d[g >= 2].mean(), d[g >= 2].mean() - d[g < 2].mean(), np.corrcoef(rank(g), rank(d))[0, 1]]
    assert np.allclose([r[c] for c in ("slope", "within_site", "light", "heavy", "difference", "spearman")], want)
    empty = deltas.graded(df.limit(0), "g", "d", "site", 2).collect()
    assert len(empty) == 1 and empty[0]["slope"] is None and empty[0]["spearman"] is None
    s = deltas.over_sites(df, "site", "d").first()
    means = [d[np.array([x[0] for x in rows]) == v].mean() for v in ("s0", "s1", "s2")]
    assert s["sites"] == 3 and s["every_site"] == all(m < 0 for m in means)


def test_top_correlated_over_labels(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(80, 5)), rng.integers(0, 2, (80, 2))
    x[:, 2] += 2 * y[:, 1]
    x[:, 4] = 1.0
    rows = [(f"c{j}", f"l{k}", float(x[i, j]), int(y[i, k])) for i in range(80) for j in range(5) for k in range(2)]
    got = summaries.top_correlated(spark.createDataFrame(rows, "f string, l string, x double, y int").repartition(3), "f", "l", "x", "y", 2, ["c0"]).collect()
    best = {f"c{j}": max(abs(np.corrcoef(x[:, j], y[:, k])[0, 1]) for k in range(2)) for j in range(4)}
    order = sorted((c for c in best if c != "c0"), key=lambda c: -best[c])[:2]
    assert [(r["f"], r["rank"]) for r in got if not r["protected"]] == [(c, i + 1) for i, c in enumerate(order)] and order[0] == "c2"
    assert all(abs(r["corr"] - best[r["f"]]) < 1e-8 for r in got) and [r["f"] for r in got if r["protected"]] == ["c0"]


def test_forms_bins_and_modes(spark):
    df = spark.createDataFrame([(1, True, 2.0), (2, None, 4.0), (3, False, None)], "c int, ok boolean, m double")
    r = summaries.form_checks(df, {"ok": F.col("ok")}, "m").first()
    assert (r["forms"], r["ok"], r["q25"], r["q50"], r["q75"]) == (3, 1, 2.5, 3.0, 3.5)
    r = summaries.form_checks(df.limit(0), {"ok": F.col("ok")}, "m").first()
    assert (r["forms"], r["ok"], r["q50"]) == (0, 0, None)
    v = spark.createDataFrame([(1, "hr", 0.5, 3.0), (1, "hr", 1.5, 5.0), (1, "hr", 2.5, None), (1, "hr", -0.5, 9.0)], "c int, i string, h double, v double")
    got = {r["bin"]: (r["n"], r["median"], r["low"], r["high"]) for r in summaries.binned_values(v, "c", "i", F.col("h"), "v", 2.0).collect()}
    assert got == {0: (2, 4.0, 3.0, 5.0), -1: (1, 9.0, 9.0, 9.0)}
    top = summaries.top_class_shares(spark.createDataFrame([("s", c) for c in "aaabbbccd"] + [("t", None)], "s string, c string"), "s", "c", 2)
    assert {(r["s"], r["c"]): r["n"] for r in top.collect()} == {("s", "a"): 3, ("s", "b"): 3, ("s", "other"): 3, ("t", "other"): 1, (None, "a"): 3, (None, "b"): 3, (None, "other"): 4}

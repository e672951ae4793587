"""Resampled and ranked statistics against plain numpy: the same draws, all pairs, brute-force ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import concordance, metrics, ranks, resample


def plain_auroc(y, s, w):
    one, two = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pair = w[one][:, None] * w[two][None, :]
    won = (s[one][:, None] > s[two][None, :]) + 0.5 * (s[one][:, None] == s[two][None, :])
    return (pair * won).sum() / pair.sum() if pair.sum() else None


def plain_kappa(a, b, w):
    n, o = w.sum(), (w * (a == b)).sum()
    e = ((w * a).sum() * (w * b).sum() + (w * (1 - a)).sum() * (w * (1 - b)).sum()) / n / n
    return (o / n - e) / (1 - e) if e < 1 else None


@pytest.fixture(scope="module")
def rated(spark):
    rng = np.random.default_rng(2)
    rows = [(i, ["x", "y", None][i % 3] if i % 2 else "x", int(rng.uniform() < 0.6), round(float(rng.normal()), 1)) for i in range(300)]
    rows = [(i, s, a, a if rng.uniform() < 0.8 else 1 - a, z + a) for i, s, a, z in rows]
    return rows, spark.createDataFrame([*rows, (999, "x", None, None, None)], "id long, site string, a int, b int, z double").repartition(5)


@pytest.mark.parametrize("mode", metrics.MODES)
@pytest.mark.parametrize("piece", [1 << 16, 60])
def test_replicates_equal_plain_statistics_of_the_same_draws(spark, rated, mode, piece, monkeypatch):
    rows, df = rated
    monkeypatch.setattr(resample, "PIECE", piece)
    for name, statistic in (("kappa", resample.kappa("a", "b")), ("auroc", resample.auroc("a", "z")), ("mean", resample.mean("z")), ("ratio", resample.ratio("a", "b"))):
        got = {r["rep"]: r["stat"] for r in resample.replicated(df, [], "site", "id", statistic, 40, 3, mode).collect()}
        where = {r["id"]: r["piece"] for r in resample.placed(df, [], "site", "id", statistic).collect()}
        part = [(where[i], s or "", i, a, b, z) for i, s, a, b, z in rows]
        sizes = {s: [sum(p[1] == s and p[0] == k for p in part) for k in range(max(where.values()) + 1)] for s in {p[1] for p in part}}
        weights = {}
        for k in sorted(set(where.values())):
            mine = sorted([p for p in part if p[0] == k], key=lambda p: (p[5], p[1], p[2]) if name == "auroc" else (p[1], p[2]))
            drawn = np.concatenate([c for _, c in resample.counts(np.array([p[1] for p in mine]), sizes, k, 40, mode, (3,))])
            weights |= {p[2]: drawn[:, j] for j, p in enumerate(mine)}
        assert len(got) == 40 and (len(set(where.values())) > 1) == (piece < 300)
        a, b, z = (np.array([r[c] for r in rows], float) for c in (2, 3, 4))
        w = np.stack([weights[r[0]] for r in rows], 1)
        if mode == "within_site":
            for s in sizes:  # every replicate draws as many rows of a site as it has
                assert (w[:, [j for j, r in enumerate(rows) if (r[1] or "") == s]].sum(1) == sum(sizes[s])).all()
        plain = {"kappa": lambda v: plain_kappa(a, b, v), "auroc": lambda v: plain_auroc(a, z, v), "mean": lambda v: (v * z).sum() / v.sum(), "ratio": lambda v: (v * a).sum() / (v * b).sum()}[name]
        for rep in range(40):
            want = plain(w[rep])
            assert (got[rep] is None and want is None) or abs(got[rep] - want) < 1e-9


def test_intervals_and_reruns(spark, rated):
    rows, df = rated
    one = resample.replicated(df, ["site"], "site", "id", resample.auroc("a", "z"), 200, 1)
    again = resample.replicated(df.repartition(2), ["site"], "site", "id", resample.auroc("a", "z"), 200, 1)
    assert sorted(map(str, one.collect())) == sorted(map(str, again.collect()))
    stats = [r["stat"] for r in one.filter("site = 'x'").collect()]
    r = resample.interval(one, ["site"]).filter("site = 'x'").first()
    assert np.allclose([r["low"], r["high"]], np.quantile(stats, [0.025, 0.975])) and r["reps"] == 200
    a, z = (np.array([r[c] for r in rows if r[1] == "x"], float) for c in (2, 4))
    assert r["low"] < plain_auroc(a, z, np.ones(len(a))) < r["high"]
    same = resample.difference(one, again, ["site"]).agg(F.max(F.abs("stat"))).first()[0]
    assert same == 0
    with pytest.raises(Exception, match="at least 2 sites"):
        resample.replicated(df.filter("site = 'x'"), [], "site", "id", resample.mean("z"), 10, 1, "cluster").collect()
    assert resample.replicated(df.limit(0), [], "site", "id", resample.mean("z"), 10).count() == 0


def test_draws_have_the_right_spread():
    """A row's count is that of n draws on n rows: mean 1, variance 1 - 1/n, whatever the pieces."""
    sizes = {"s": [30, 50, 20]}
    w = np.concatenate([np.concatenate([c for _, c in resample.counts(np.array(["s"] * n), sizes, k, 4000, "within_site", (5,))]) for k, n in enumerate(sizes["s"])], axis=1)
    assert (w.sum(1) == 100).all() and abs(w.mean() - 1) < 1e-12 and abs(w.var(0).mean() - 0.99) < 0.02
    assert abs(np.cov(w[:, 0], w[:, 99])[0, 1] + 0.01) < 0.06


def plain_tau(x, y):
    c = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    a, b = (np.sign(v[:, None] - v) ** 2 for v in (x, y))
    return c.sum() / np.sqrt(a.sum() * b.sum()) if a.sum() * b.sum() else None


def average_ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


@pytest.mark.parametrize("cells", [50_000, 40])
def test_tau_and_spearman_equal_plain_ones(spark, cells, monkeypatch):
    monkeypatch.setattr(concordance, "CELLS", cells)
    rng = np.random.default_rng(1)
    made = {"tied": (rng.integers(0, 5, 200), rng.integers(0, 4, 200)), "free": (rng.normal(size=200), rng.normal(size=200)), "hot": (np.where(rng.uniform(size=150) < 0.6, 0.0, rng.normal(size=150)), rng.normal(size=150)), "same": (np.ones(9), np.arange(9)), "alone": (np.ones(1), np.ones(1))}
    made["down"] = (made["free"][0], -made["free"][0])
    rows = [(None if g == "hot" else g, float(a), float(b)) for g, (x, y) in made.items() for a, b in zip(x, y)] + [("free", None, 1.0), ("free", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(6)
    tau = {r["g"] or "hot": r for r in concordance.kendall(df, ["g"], "x", "y").collect()}
    rho = {r["g"] or "hot": r for r in concordance.spearman(df, ["g"], "x", "y").collect()}
    for g, (x, y) in made.items():
        x, y = np.asarray(x, float), np.asarray(y, float)
        want = plain_tau(x, y)
        assert tau[g]["n"] == len(x) and ((want is None and tau[g]["tau"] is None) or abs(tau[g]["tau"] - want) < 1e-9)
        if g in ("same", "alone"):
            assert rho[g]["rho"] is None
        else:
            assert abs(rho[g]["rho"] - np.corrcoef(average_ranks(x), average_ranks(y))[0, 1]) < 1e-9
    whole = concordance.kendall(df, [], "x", "y").first()
    x, y = (np.array([r[c] for r in rows if None not in r[1:]]) for c in (1, 2))
    assert abs(whole["tau"] - plain_tau(x, y)) < 1e-9


def test_inversions():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 7, 64, 101):
        key, w = rng.integers(0, 9, n), rng.integers(1, 4, n).astype(float)
        assert concordance.inversions(key, w) == sum(w[i] * w[j] for i in range(n) for j in range(i + 1, n) if key[i] > key[j])


def test_ranks_of_common_values_and_distinct_ones_spread(spark):
    """A common value is one row of the ranks; distinct scores of one label lie in many partitions."""
    rng = np.random.default_rng(6)
    x = np.where(rng.uniform(size=4000) < 0.5, 0.0, rng.normal(size=4000))
    df = spark.createDataFrame([("g", float(v), int(v > rng.normal())) for v in x], "g string, v double, y int").repartition(5)
    tied = ranks.tied(df, ["g"], "v")
    got = {r["v"]: r["rank"] for r in tied.collect()}
    assert len(got) == len(set(x)) and abs(got[0.0] - ((x < 0).sum() + ((x == 0).sum() + 1) / 2)) < 1e-9
    plan = tied._jdf.queryExecution().toString()
    assert "rangepartitioning" in ranks.tied(df, ["g"], "v")._jdf.queryExecution().toString() or "ranked-" in plan  # dealt by range before it is written
    q = ranks.quantiles(df, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.93}).first()
    assert q["n"] == 4000 and np.allclose([q["a"], q["m"], q["z"]], np.quantile(x, [0.1, 0.5, 0.93]))
    y = np.array([r["y"] for r in df.collect()]), np.array([r["v"] for r in df.collect()])
    assert abs(metrics.auroc(df, ["g"], "y", "v").first()["auroc"] - plain_auroc(*y, np.ones(4000))) < 1e-9


def test_top_of_a_site_limits_before_the_shuffle(spark):
    from tidegate.operators import audits, runs

    rng = np.random.default_rng(3)
    rows = [(None if i % 9 == 0 else "hot", f"w{int(rng.zipf(1.5)) % 60}", bool(i % 2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "site string, w string, ok boolean").repartition(4)
    top = audits.top_wordings(df, "site", "w", "ok", 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    count = {}
    for s, w, ok in rows:
        count.setdefault((s, ok), {}).setdefault(w, 0)
        count[s, ok][w] += 1
    want = {(s, ok, w, n) for (s, ok), c in count.items() for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:3]}
    assert {(r["site"], r["matched"], r["w"], r["n"]) for r in top.collect()} == want
    got = {(r["site"], r["label"]): r["n"] for r in runs.top_values(df, "site", "w", 2).collect()}
    assert sum(got.values()) == 3000 and len(got) == 6


def test_a_piece_holds_few_draws_at_a_time(monkeypatch):
    import tracemalloc

    import numpy as np
    import pandas as pd

    from tidegate.operators import resample

    n = resample.PIECE
    rng = np.random.default_rng(2)
    part = pd.DataFrame({"y": rng.integers(0, 2, n), "p": np.sort(rng.integers(0, 101, n) / 101)})
    sums = resample.auroc("y", "p").sums
    site = np.full(n, "")
    all_of = lambda: np.concatenate([sums(part, c) for _, c in resample.counts(site, {"": [n]}, 0, 70, "within_site", (3, "a"))])
    tracemalloc.start()
    got = all_of()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    # how many are held at a time changes no draw
    monkeypatch.setattr(resample, "TOGETHER", 1 << 21)
    assert (all_of() == got).all()

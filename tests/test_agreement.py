"""Agreement of raters against plain numpy."""

import random

import numpy as np
import pytest

from tidegate.operators import agreement


def plain_kappa(a, b, w=None):
    a, b = np.array(a), np.array(b)
    w = np.ones(len(a)) if w is None else np.array(w, float)
    o = (w * (a == b)).sum() / w.sum()
    e = sum((w * (a == c)).sum() * (w * (b == c)).sum() for c in set(a.tolist()) | set(b.tolist())) / w.sum() ** 2
    return (o - e) / (1 - e) if e < 1 else None


RATING = "c int, l string, r string, v int"


@pytest.fixture(scope="module")
def rated():
    rng = random.Random(5)
    rows = []
    for c in range(240):
        for l, share in (("a", 0.5), ("b", 0.3), ("rare", 0.02)):
            truth = rng.random() < share
            for r in ("r1", "r2", "r3"):
                if r != "r3" or rng.random() < 0.3:
                    rows.append((c, l, r, None if rng.random() < 0.05 else int(truth if rng.random() < 0.85 else not truth)))
    return rows


def both(rows, l, r, s):
    v = {(c, x): y for c, k, x, y in rows if k == l}
    return [(c, v[c, r], v[c, s]) for c in range(1000) if v.get((c, r)) is not None and v.get((c, s)) is not None]


def test_categorical_kappa(spark):
    rng = random.Random(2)
    rows = [("g", rng.choice("xyz"), rng.choice("xyzw")) for _ in range(200)] + [(None, "x", "x")] * 3 + [("g", None, "x"), ("one", "x", "y")]
    got = {r["g"]: r for r in agreement.categorical_kappa(spark.createDataFrame(rows, "g string, a string, b string").repartition(4), ["g"], "a", "b").collect()}
    known = [(a, b) for g, a, b in rows if g == "g" and a]
    assert got["g"]["n"] == 200 and abs(got["g"]["kappa"] - plain_kappa(*zip(*known))) < 1e-9
    assert got[None]["kappa"] is None and got[None]["agree"] == 1 and got["one"]["kappa"] == 0


def test_pairs_and_repeated_cases(spark, rated):
    df = spark.createDataFrame(rated, RATING).repartition(4)
    got = {(r["l"], r["a"], r["b"]): r for r in agreement.pair_kappas(df, "c", "l", "r", "v").collect()}
    assert set(got) == {(l, a, b) for l in ("a", "b", "rare") for a, b in (("r1", "r2"), ("r1", "r3"), ("r2", "r3"))}
    for (l, a, b), r in got.items():
        pairs = both(rated, l, a, b)
        want = plain_kappa([p[1] for p in pairs], [p[2] for p in pairs])
        assert r["n"] == len(pairs) and ((want is None and r["kappa"] is None) or abs(r["kappa"] - want) < 1e-9)
    copies = spark.createDataFrame([(c, c + 100) for c in range(100)], "c int, copy int")
    got = {(r["l"], r["r"]): r for r in agreement.intrarater(df, copies, "c", "l", "r", "v").collect()}
    v = {(c, l, r): y for c, l, r, y in rated}
    for (l, r), x in got.items():
        pairs = [(v[c, l, r], v[c + 100, l, r]) for c in range(100) if v.get((c, l, r)) is not None and v.get((c + 100, l, r)) is not None]
        want = plain_kappa(*zip(*pairs))
        assert x["n"] == len(pairs) and ((want is None and x["kappa"] is None) or abs(x["kappa"] - want) < 1e-9)


def test_report_and_queue(spark, rated):
    df = spark.createDataFrame(rated, RATING).repartition(4)
    cases = spark.createDataFrame([(c, f"s{c % 3}", 1.0 + c % 2) for c in range(230)], "c int, s string, w double")
    got = {r["l"]: r for r in agreement.report(df, cases, ("r1", "r2"), "c", "l", "r", "v", "s", "w", 300, 1).collect()}
    rows = [r for r in rated if r[0] < 230]
    for l in ("a", "b"):
        pairs, r = both(rows, l, "r1", "r2"), got[l]
        a, b = [p[1] for p in pairs], [p[2] for p in pairs]
        assert r["n"] == len(pairs) and abs(r["kappa"] - plain_kappa(a, b)) < 1e-9 and r["low"] < r["kappa"] < r["high"] and abs(r["agree"] - np.mean(np.equal(a, b))) < 1e-9
        assert abs(r["kappa_weighted"] - plain_kappa(a, b, [1.0 + p[0] % 2 for p in pairs])) < 1e-9
        by, count = {}, {"agreed": 0, "majority": 0, "pending": 0}
        for c, k, _, y in rows:
            if k == l:
                by.setdefault(c, []).append(y)
        gold = {}
        for c, ys in by.items():
            yes, no = ys.count(1), ys.count(0)
            status = "pending" if yes + no < 2 or (yes and no and yes == no) else "agreed" if not (yes and no) else "majority"
            count[status] += 1
            if status != "pending":
                gold[c] = yes > no
        assert all(r[f"n_{s}"] == (n if n >= 11 else None) for s, n in count.items())
        w = {c: 1.0 + c % 2 for c in gold}
        assert abs(r["prevalence"] - sum(w[c] * g for c, g in gold.items()) / sum(w.values())) < 1e-9
        assert r["passes"] == (r["kappa"] >= 0.6 and r["prevalence"] >= 0.1)
    assert got["rare"]["kappa"] is None or got["rare"]["n_positive"] >= 11
    few = {r["l"]: r for r in agreement.report(df, cases.filter("c < 8"), ("r1", "r2"), "c", "l", "r", "v", "s", "w", 50, 1).collect()}
    assert all(r["n"] is None and r["kappa"] is None and r["low"] is None and r["prevalence"] is None and not r["passes"] for r in few.values())
    queue = {r["c"]: r["labels"] for r in agreement.disputes(df, "r1", "r2", "c", "l", "r", "v").collect()}
    want = {}
    for l in ("a", "b", "rare"):
        for c, x, y in both(rated, l, "r1", "r2"):
            if x != y:
                want.setdefault(c, []).append(l)
    assert queue == {c: ", ".join(ls) for c, ls in want.items()}


def plain_fill(cells, total):
    """Deals one unit of water at a time in small steps: a cell rises with its share until its cap."""
    live = {k: (c, s) for k, c, s in cells if c > 0 and s > 0}
    n = min(total, sum(c for c, _ in live.values()))
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, mid * s) for c, s in live.values()) < n else (low, mid)
    return {k: min(c, high * s) for k, (c, s) in live.items()}, n


def test_waterfilling(spark):
    rng = random.Random(9)
    for _ in range(12):
        cells = [(f"k{i}", rng.choice([0, 1, 3, 10, 50]), rng.choice([0.0, 0.5, 1.0, 2.0, 7.0])) for i in range(rng.randrange(1, 9))]
        total = rng.choice([0, 1, 7, 40, 500])
        got = {r["k"]: r["take"] for r in agreement.waterfilled(spark.createDataFrame(cells, "k string, cap int, share double"), "k", "cap", "share", total).collect()}
        level, n = plain_fill(cells, total)
        assert sum(got.values()) == n and all(got[k] <= c for k, c, _ in cells)
        assert all(abs(got[k] - level.get(k, 0)) < 1 + 1e-6 for k in got)


def test_circularity(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label, follows in (("leaks", True), ("fine", False)):
        for i in range(250):
            c, y = rng.integers(0, 2, 2)
            rows.append((i, label, float(rng.normal() + 2 * (c if follows else y)), int(c), int(y)))
    rows += [(i, "few", 0.5, i % 2, 1) for i in range(6)] + [(i, "one", 0.5, i % 2, 1) for i in range(30)]
    df = spark.createDataFrame([*rows, (999, "fine", None, 1, 1)], "id int, label string, p double, c int, y int").repartition(3)
    got = {r["label"]: r for r in agreement.circularity(df, "label", "id", "p", "c", "y", 200, 1).collect()}
    for label in ("leaks", "fine"):
        r, part = got[label], [x for x in rows if x[1] == label]
        p = np.array([x[2] for x in part])
        auc = [np.mean([(a > b) + 0.5 * (a == b) for a in p[t == 1] for b in p[t == 0]]) for t in (np.array([x[3] for x in part]), np.array([x[4] for x in part]))]
        assert np.allclose([r["with_comparator"], r["with_label"], r["difference"]], [*auc, auc[0] - auc[1]]) and r["low"] < r["difference"] < r["high"]
    assert got["leaks"]["leak"] and got["leaks"]["sure"] and not got["fine"]["leak"] and not got["fine"]["sure"]
    assert got["few"]["n"] is None and got["few"]["leak"] is None and got["one"]["n"] == 30 and got["one"]["difference"] is None

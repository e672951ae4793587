"""Transport weights and choices within folds, against plain loops on all rows."""

import hashlib
import json

import numpy as np
import pytest

from tidegate.operators import selection, transport


def plain_fit(x, y, penalty):
    b = np.zeros(x.shape[1])
    for _ in range(100):
        mu = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (mu * (1 - mu))[:, None]) + np.diag(penalty), x.T @ (y - mu) - penalty * b)
    return b


def plain_loss(y, eta):
    return np.logaddexp(0, eta) - y * eta


def draw(seed, entity):
    return int(hashlib.md5(f"{seed}|{entity}".encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def domain(spark):
    rng = np.random.default_rng(12)
    n = 400
    a, b = rng.normal(size=n), rng.uniform(size=n) * 1000
    z = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.8 * a + 0.002 * b - 2)))).astype(int)
    site = np.where(rng.uniform(size=n) < 0.6, "x", "y")
    rows = [(i, str(s), int(c), None if i % 17 == 0 else float(u), float(v), 3.0) for i, (s, c, u, v) in enumerate(zip(site, z, a, b))]
    return rows, spark.createDataFrame([*rows, (n, "x", None, 0.0, 0.0, 3.0)], "id int, site string, z int, a double, b double, same double").repartition(5)


def test_cross_fitted_scores_and_weights_equal_plain_ones(domain):
    rows, df = domain
    scored, names = transport.domain_scores(df, ["a", "b", "same"], "z", "site", "id", 5, 1, 1.0)
    assert names == ["a", "a_missing", "b"]
    got = {r["id"]: r for r in transport.inverse_odds(scored, "z", "p").collect()}
    assert set(got) == set(range(400))
    # folds are dealt evenly within each (site, z)
    for key in {(r[1], r[2]) for r in rows}:
        members = [r[0] for r in rows if (r[1], r[2]) == key]
        order = sorted(members, key=lambda i: (draw(1, i), i))
        assert [got[i]["fold"] for i in order] == [k % 5 for k in range(len(order))]
    median = np.median([r[3] for r in rows if r[3] is not None])
    x = np.array([[median if r[3] is None else r[3], float(r[3] is None), r[4]] for r in rows])
    z, fold = np.array([r[2] for r in rows], float), np.array([got[r[0]]["fold"] for r in rows])
    p = np.empty(400)
    for f in range(5):
        train = fold != f
        m, s = x[train].mean(0), x[train].std(0)
        beta = plain_fit(np.c_[np.ones(train.sum()), (x[train] - m) / s], z[train], np.array([0.0, 1, 1, 1]))
        p[~train] = 1 / (1 + np.exp(-np.c_[np.ones((~train).sum()), (x[~train] - m) / s] @ beta))
    assert max(abs(got[i]["p"] - p[i]) for i in range(400)) < 1e-7
    pi = z.mean()
    raw = p / (1 - p) / (pi / (1 - pi))
    low, high = np.percentile(raw[z == 0], [1, 99])
    w = np.where(z == 1, 1.0, np.clip(raw, low, high))
    assert max(abs(got[i]["w"] - w[i]) for i in range(400)) < 1e-6
    assert sum(r["trimmed"] for r in got.values()) == ((z == 0) & ((raw < low) | (raw > high))).sum() > 0
    told = {r["covariate"]: r for r in transport.balance(transport.inverse_odds(scored, "z", "p"), names, "z").collect()}
    for j, name in enumerate(names):
        one, other, u = x[z == 1, j], x[z == 0, j], w[z == 0]
        mb = (u * other).sum() / u.sum()
        vb = (u * (other - mb) ** 2).sum() / u.sum()
        assert abs(told[name]["smd_before"] - (one.mean() - other.mean()) / np.sqrt((one.var() + other.var()) / 2)) < 1e-9
        assert abs(told[name]["smd_after"] - (one.mean() - mb) / np.sqrt((one.var() + vb) / 2)) < 1e-5
    assert abs(told["a"]["smd_after"]) < 0.3 * abs(told["a"]["smd_before"])
    delta = transport.weighted_delta(transport.inverse_odds(scored, "z", "p").filter("z = 0"), [], "b", "w").first()
    u, d = w[z == 0], x[z == 0, 2]
    assert np.allclose([delta["ess"], delta["delta"], delta["unweighted"]], [u.sum() ** 2 / (u**2).sum(), (u * d).sum() / u.sum(), d.mean()], rtol=1e-5)


def test_too_few_rows_for_a_domain_model(spark, domain):
    _, df = domain
    for part in (df.filter("z = 0"), df.limit(0), df.filter("z = 0 OR id = " + str(next(r[0] for r in domain[0] if r[2] == 1)))):
        scored, _ = transport.domain_scores(part, ["a"], "z", "site", "id")
        assert {r["p"] for r in scored.collect()} <= {None}


@pytest.fixture(scope="module")
def heads():
    rng = np.random.default_rng(21)
    rows = []
    for i in range(240):
        x = rng.normal(size=4)
        for k, w in (("a", [1.5, 0, 0, 0.5]), ("b", [0, 0, 2.0, 0])):
            y = float(rng.uniform() < 1 / (1 + np.exp(-x @ w)))
            rows.append((i, k, None if (i + len(rows)) % 11 == 0 else y, *map(float, x)))
    return rows


HEAD = "id int, label string, y double, " + ", ".join(f"x{i} double" for i in range(4))


def test_penalty_is_chosen_as_a_plain_loop_does(spark, heads):
    cs, scales, names = (0.003, 0.1, 10.0), (0.25, 1.0), [f"x{i}" for i in range(4)]
    df = spark.createDataFrame(heads, HEAD).repartition(4)
    got = selection.select_penalty(df.filter("id < 150"), df.filter("id >= 150 AND id < 200"), "label", "y", "id", names, names[2:], cs, scales).collect()
    want = {}
    for c in cs:
        for s in scales:
            per = {}
            for k in "ab":
                train = np.array([(r[2], *r[3:]) for r in heads if r[1] == k and r[0] < 150 and r[2] is not None])
                scale = np.array([1, 1, 1, s, s])  # the block's columns multiplied, the penalty the same for all
                b = plain_fit(np.c_[np.ones(len(train)), train[:, 1:]] * scale, train[:, 0], np.array([0] + [1 / c] * 4))
                for r in heads:
                    if r[1] == k and 150 <= r[0] < 200 and r[2] is not None:
                        per.setdefault(r[0], []).append(plain_loss(r[2], (np.r_[1, r[3:]] * scale) @ b))
            want[c, s] = np.mean([np.mean(v) for v in per.values()])
    assert {(r["c"], r["scale"]) for r in got} == set(want) and max(abs(r["dev_loss"] - want[r["c"], r["scale"]]) for r in got) < 1e-7
    assert [(r["c"], r["scale"]) for r in got if r["chosen"]] == [min(want, key=want.get)]
    # held-out rows aren't read, and too few dev rows leave the default
    other = [(*r[:2], None if r[2] is None else 1 - r[2], *[v + 9 for v in r[3:]]) if r[0] >= 200 else r for r in heads]
    df = spark.createDataFrame(other, HEAD)
    again = selection.select_penalty(df.filter("id < 150"), df.filter("id >= 150 AND id < 200"), "label", "y", "id", names, names[2:], cs, scales).collect()
    assert [r["chosen"] for r in again] == [r["chosen"] for r in got]
    thin = selection.select_penalty(df.filter("id < 150"), df.filter("id = 150"), "label", "y", "id", names, names[2:], (1.0, 2.0), (1.0,), least=5).collect()
    assert [(r["dev_loss"], r["chosen"]) for r in thin] == [(None, True), (None, False)]


def test_channels_are_chosen_within_folds(spark, heads):
    channels = {"noise": ["x1"], "one": ["x0", "x1"], "two": ["x2"], "three": ["x3"]}
    rows = [(r[0], r[0] % 3, r[2], *r[3:]) for r in heads if r[1] == "a" and r[2] is not None]
    schema = "id int, fold int, y double, x0 double, x1 double, x2 double, x3 double"
    got = {}
    for r in selection.forward_channels(spark.createDataFrame(rows, schema).repartition(3), channels, "y", "fold", "id", 3, ridge=1.0).collect():
        got.setdefault(r["fold"], []).append((r["channel"], r["loss"]))
    at = {n: [int(c[1]) for c in cs] for n, cs in channels.items()}
    for f in range(3):
        part = [[r for r in rows if r[1] != f and (draw(0, r[0]) % 1000 < 250) == test] for test in (False, True)]
        chosen = []
        for step in range(3):
            tries = {}
            for c in channels:
                if c not in chosen:
                    cols = [i for n in [*chosen, c] for i in at[n]]
                    x, v = (np.array([[1, *[r[3 + i] for i in cols]] for r in p]) for p in part)
                    b = plain_fit(x, np.array([r[2] for r in part[0]]), np.array([0.0] + [1.0] * len(cols)))
                    tries[c] = plain_loss(np.array([r[2] for r in part[1]]), v @ b).mean()
            best = min(tries, key=tries.get)
            assert got[str(f)][step][0] == best and abs(got[str(f)][step][1] - tries[best]) < 1e-7
            chosen.append(best)
    # other outcomes and columns in a fold change nothing of what is chosen for it
    changed = [(i, f, 1 - y if f == 0 else y, *[v * (5 if f == 0 else 1) for v in x]) for i, f, y, *x in rows]
    again = [(r["channel"], r["loss"]) for r in selection.forward_channels(spark.createDataFrame(changed, schema), channels, "y", "fold", "id", 3).collect() if r["fold"] == "0"]
    assert [c for c, _ in again] == [c for c, _ in got["0"]] and np.allclose([v for _, v in again], [v for _, v in got["0"]])
    forced = [r["channel"] for r in selection.forward_channels(spark.createDataFrame(rows, schema), channels, "y", "fold", "id", 2, forced=["three"]).collect() if r["fold"] == "1"]
    assert forced[0] == "three" and len(forced) == 2
    with pytest.raises(ValueError, match="unknown"):
        selection.forward_channels(spark.createDataFrame(rows, schema), channels, "y", "fold", "id", 2, forced=["nine"])
    with pytest.raises(ValueError, match="k must"):
        selection.forward_channels(spark.createDataFrame(rows, schema), channels, "y", "fold", "id", 9)


def test_keys(spark):
    assert selection.key_of("a", 1) == json.dumps(["a", "1"], separators=(",", ":"))

"""Intervals that meet points by cells of time, against all pairs, and an entity with very many."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegate.operators import audits, intervals

START = datetime(2024, 1, 1)
POINT = "entity_id int, point_id int, t timestamp_ntz"
INTERVAL = "entity_id int, interval_id int, t_start timestamp_ntz, t_end timestamp_ntz, open boolean, class_rank int"


def hour(h):
    return START + timedelta(hours=h)


def made(seed, n=160):
    rng = random.Random(seed)
    points = [(rng.choice([1, 1, 2, 3]), i, hour(rng.choice([rng.uniform(-900, 900), rng.randrange(-30, 30) * 24]))) for i in range(n)]
    spans = []
    for i in range(n):
        a = rng.choice([rng.uniform(-900, 900), rng.randrange(-30, 30) * 24])
        spans.append((rng.choice([1, 1, 2, 4]), i, hour(a), hour(a + rng.choice([0, 1, 24, 100, 3000, 90_000, rng.uniform(0, 200)])), rng.random() < 0.3, rng.randrange(1, 5)))
    return points, spans


def gap(a, b):
    return (b - a).total_seconds() / 3600


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("slack", [24, 0])
def test_covers_and_chains_equal_all_pairs(spark, seed, slack):
    points, spans = made(seed)
    p, s = spark.createDataFrame(points, POINT).repartition(4), spark.createDataFrame(spans, INTERVAL).repartition(3)
    want, hops = {}, {}
    for e, i, t in points:
        fit = [x for x in spans if x[0] == e and gap(t, x[2]) <= slack and gap(x[3], t) <= slack]
        exact = lambda x: x[2] <= t <= x[3]  # noqa: E731, B023
        best = min(fit, key=lambda x: (not exact(x), gap(x[2], x[3]) < 24, x[2] > t, x[5], -(x[2] - START).total_seconds(), x[1]), default=None)
        want[i] = (best[1], best[2], "exact" if exact(best) else "slack") if best else (None, None, None)
        if best:
            earlier = [x[2] for x in spans if x[0] == e and not x[4] and x[5] <= 2 and x[2] <= best[2] and gap(x[3], best[2]) <= 48]
            hops[i] = min([*(earlier and [min(earlier)] or [best[2]]), t])
        else:
            hops[i] = t
    got = intervals.covering(p, s, slack)
    assert {r["point_id"]: (r["interval_id"], r["t_start"], r["cover"]) for r in got.collect()} == want
    chained = intervals.chained_start(got.join(p, "point_id"), s, 48, "class_rank <= 2")
    assert {r["point_id"]: r["start"] for r in chained.collect()} == hops


@pytest.mark.parametrize("seed", [4, 5])
def test_geometry_equals_all_pairs(spark, seed):
    points, spans = made(seed)
    rng = random.Random(seed)
    spans = [(e, i, a, None if rng.random() < 0.2 else b, o, c) for e, i, a, b, o, c in spans]
    got = {r["point_id"]: r for r in audits.geometry(spark.createDataFrame(points, POINT).repartition(3), spark.createDataFrame(spans, INTERVAL).select("entity_id", "t_start", "t_end"), 24).collect()}
    assert set(got) == {i for e, i, _ in points if e != 3}
    for e, i, t in points:
        if e == 3:
            continue
        own, r = [(x[2], x[3]) for x in spans if x[0] == e], got[i]
        midnight = lambda b: b is not None and (b.hour, b.minute, b.second, b.microsecond) == (0, 0, 0, 0)
        assert (r["n"], r["null_ends"], r["midnight_ends"]) == (len(own), sum(b is None for _, b in own), sum(midnight(b) for _, b in own))
        assert r["exact"] == any(b is not None and a <= t <= b for a, b in own)
        assert r["open_end"] == any(a <= t and (b is None or b >= t) for a, b in own)
        assert r["whole_day"] == any(b is not None and a <= t and b.date() >= t.date() for a, b in own)
        assert r["slack"] == any(b is not None and gap(t, a) <= 24 and gap(b, t) <= 24 for a, b in own)
        assert abs(r["nearest_start_h"] - min((gap(t, a) for a, _ in own), key=lambda h: (abs(h), h))) < 1e-6
        assert r["latest_start"] == max((a for a, _ in own if a <= t), default=None)


def test_an_entity_with_a_hundred_thousand_intervals(spark):
    span = lambda i: F.timestamp_add("HOUR", i, F.lit("2000-01-01").cast("timestamp_ntz"))
    s = spark.range(100_000).select(F.lit(1).alias("entity_id"), F.col("id").cast("int").alias("interval_id"), span(F.col("id")).alias("t_start"), span(F.col("id") + 30).alias("t_end"), F.lit(False).alias("open"), F.lit(1).alias("class_rank"))
    p = spark.range(20_000).select(F.lit(1).alias("entity_id"), F.col("id").cast("int").alias("point_id"), span(F.col("id") * 5).alias("t"))
    # the latest of the 31 that cover a point: two thousand million pairs would be made without the cells
    assert intervals.covering(p, s, 0).filter(F.col("interval_id") == F.col("point_id") * 5).count() == 20_000
    assert audits.geometry(p, s.select("entity_id", "t_start", "t_end"), 24).filter("exact AND nearest_start_h = 0").count() == 20_000


@pytest.mark.parametrize("name", ["jn03_covering", "jn04_chained_start", "ag23_geometry"])
def test_entities_with_few_rows_are_not_cut_into_blocks(spark, name):
    from tidegate.plans import registry

    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_crowded_entities_beside_others(spark, monkeypatch):
    points, spans = made(4)
    p, s = spark.createDataFrame(points, POINT), spark.createDataFrame(spans, INTERVAL)
    keys = lambda: sorted(map(tuple, intervals.covering(p, s, 24).collect()))
    told = []
    for many, few in ((10_000, 100), (0, 100), (90, 100), (90, 0)):
        monkeypatch.setattr(intervals, "MANY", many)
        monkeypatch.setattr(intervals, "FEW", few)
        told.append(keys())
    assert told[0] == told[1] == told[2] == told[3]

"""Hand-made cases: boundaries, leaks, repairs, ties, hidden cells, streams and sources."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import types as T
from pyspark.sql import functions as F

from tidegate.functions import text
from tidegate.operators import audits, builders, disclose, features, flow, gate, identity, intervals, metrics, nearest, ranks, rules, runs, sampling
from tidegate.sources import readers
from tidegate.streaming import incremental

T0 = datetime(2024, 1, 10, 12)
EVENTS = "event_id long, entity_id long, domain string, key string, value double, quantity double, t_event timestamp_ntz, t_avail timestamp_ntz, t_end_raw timestamp_ntz"


def hours(h):
    return T0 + timedelta(hours=h)


def made(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def index_of(spark):
    return spark.createDataFrame([(1, T0), (2, None)], "entity_id long, t0 timestamp_ntz")


BASE = [
    (1, 1, "lab", "a", 1.0, None, hours(-3), T0, None),
    (2, 1, "drug", "b", 2.0, 5.0, hours(-5), hours(-5), hours(9)),
    (3, 1, "drug", "b", 2.0, 5.0, hours(-9), hours(-9), hours(-1)),
    (4, 2, "lab", "a", 3.0, None, hours(-3), hours(-3), None),
    (5, 1, "lab", "a", 4.0, None, hours(-3), None, None),
]


def test_gate_boundary_and_censoring(spark):
    late = [(6, 1, "lab", "a", 9.0, None, hours(-3), T0 + timedelta(microseconds=1), None)]
    got = {r["event_id"]: r for r in gate.as_of(made(spark, BASE + late), index_of(spark)).collect()}
    assert set(got) == {1, 2, 3}
    assert got[2]["ongoing"] and got[2]["t_end"] is None and got[2]["quantity"] is None
    assert not got[3]["ongoing"] and got[3]["quantity"] == 5.0 and got[3]["hours_since_event"] == 9.0


def test_gate_ignores_all_that_comes_later(spark):
    leaks = [(100 + i, 1, d, "a", 7.0, 1.0, hours(h), hours(h), hours(h + 1)) for i, (d, h) in enumerate((d, h) for d in ("lab", "drug") for h in (0.001, 24, 9600))]
    edited = [r if r[0] != 2 else (*r[:5], 77.0, *r[6:8], hours(400)) for r in BASE]
    a = gate.as_of(made(spark, BASE), index_of(spark)).orderBy("event_id").collect()
    b = gate.as_of(made(spark, list(reversed(edited)) + leaks), index_of(spark)).orderBy("event_id").collect()
    assert a == b
    assert gate.violations(gate.as_of(made(spark, BASE), index_of(spark))).first()["late"] == 0
    with pytest.raises(ValueError):
        gate.violations(made(spark, BASE))
    assert gate.as_of(gate.pruned(made(spark, BASE + leaks), index_of(spark)), index_of(spark)).count() == len(a)


def test_cover_prefers_exact_and_long(spark):
    raw = spark.createDataFrame(
        [(1, 1, hours(-100), hours(100), 2, "F"), (1, 2, hours(-3), hours(-1), 1, "F"), (1, 3, hours(5), hours(4), 1, "F"), (1, 4, hours(-1), None, 1, "O")],
        "entity_id long, interval_id long, t_start timestamp_ntz, t_end timestamp_ntz, class_rank int, status string",
    )
    compact = intervals.compacted(raw, "status = 'O'", 2)
    ends = {r["interval_id"]: (r["t_end"], r["open"]) for r in compact.collect()}
    assert ends[3] == (hours(5), False) and ends[4] == (hours(47), True)
    point = spark.createDataFrame([(1, 9, T0)], "entity_id long, point_id long, t timestamp_ntz")
    best = intervals.covering(point, compact.filter("interval_id < 3"), 24).first()
    assert (best["interval_id"], best["cover"]) == (1, "exact")
    assert intervals.covering(point, compact.filter("interval_id = 2"), 24).first()["cover"] == "slack"


def test_nearest_tie_goes_to_the_earlier(spark):
    e = made(spark, [(1, 1, "s", "a", 5.0, None, hours(-2), hours(-2), None), (2, 1, "s", "a", 1.0, None, hours(2), hours(2), None)])
    assert nearest.nearest_gaps(index_of(spark), e).first()["gap_h"] == -2
    assert nearest.nearest_value(index_of(spark), e, 5, 5).first()["value"] == 5.0


def test_merge_chain_and_cycle(spark):
    h = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 1), (7, 8, 1), (8, 7, 1), (5, 6, 1), (5, 9, 2)], "old long, new long, mod int")
    got = {r["old"]: r["survivor"] for r in identity.resolved(h).collect()}
    assert got[1] == got[2] == got[3] == 4 and got[5] == 9 and got[7] in (7, 8)


def test_rule_windows_are_closed_and_all_of_ids_need_the_node(spark):
    tree = {"X": {"all_of": [{"id": "low", "item": "g", "lab_threshold": ("lt", 50), "window_hours": (-1, 2)}, {"id": "seen", "item": "d", "window_hours": (-1, 1)}]}}
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    ev = spark.createDataFrame([(1, "g", 49.0, 2.0), (1, "d", None, -1.0), (2, "g", 50.0, 0.0), (2, "d", 1.0, 0.0), (3, "g", 40.0, 2.1)], "case_id long, item string, value double, hours double")
    got = {r["case_id"]: (r["y"], r["fired"]) for r in rules.evaluated(cases, ev, tree).collect()}
    assert got == {1: (True, "low,seen"), 2: (False, ""), 3: (False, "")}


def test_availability_never_hides_a_positive(spark):
    labels = spark.createDataFrame([(1, "E", True), (2, "E", False), (3, "E", False)], "case_id long, label string, y boolean")
    bins = spark.createDataFrame([(1, 0, False), (2, 0, False), (3, 1, True)], "case_id long, bin int, has_source boolean")
    got = {r["case_id"]: r["y"] for r in rules.available(labels, bins, 0.5).collect()}
    assert got == {1: True, 2: None, 3: False}


def test_loss_leaves_out_entities_without_labels(spark):
    r = spark.createDataFrame([("s", 1, 1, 0.9), ("s", 1, 0, 0.2), ("s", 2, None, 0.5)], "site string, entity long, y int, p double")
    assert metrics.entity_loss(r, ["site"]).first()["n"] == 1


def test_hidden_parts_cant_be_worked_out(spark):
    cells = spark.createDataFrame([("g", "a", 3), ("g", "b", 20), ("g", "c", 30), ("h", "a", 40), ("h", "b", 50)], "g string, part string, n long")
    got = {(r["g"], r["part"]): r["suppressed"] for r in disclose.complementary(cells, ["g"], "part").collect()}
    assert got == {("g", "a"): True, ("g", "b"): True, ("g", "c"): False, ("h", "a"): False, ("h", "b"): False}
    with pytest.raises(ValueError):
        disclose.aggregate_only(spark.createDataFrame([(1, 2)], "person_id long, n long"))
    with pytest.raises(ValueError):
        disclose.aggregate_only(spark.createDataFrame([("12", 2)], "cell string, n long"), spark.createDataFrame([(12,)], "id long"))


def test_weights_sum_to_the_population(spark):
    frame = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("g"))
    takes = sampling.allocated(frame.groupBy("g").agg(F.count("*").alias("size")), "g", 10)
    got = sampling.drawn(frame, "g", "id", takes, 1)
    assert got.count() == 10 and abs(got.agg(F.sum("weight")).first()[0] - 100) < 1e-9


def test_day_islands_bridge_within_an_agent_only(spark):
    d = lambda a, n: (1, a, datetime(2024, 1, n).date())
    days = spark.createDataFrame([d("x", 1), d("x", 3), d("y", 4), d("y", 6)], "entity_id long, agent string, day date")
    got = runs.day_islands(days, 4).first()
    assert got["days"] == 6


def test_sentences_keep_decimals_and_abbreviations(spark):
    s = spark.createDataFrame([("seen by dr. no at 3.5 h. Licensed stuff! Done?",)], "t string").select(text.sentences(F.col("t")).alias("s")).first()["s"]
    assert s == ["seen by dr. no at 3.5 h.", "Licensed stuff!", "Done?"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("pid,val,secret\n1,2.5,x\n2,oops,y\n")
    (tmp_path / "b.csv").write_text("person_id,value,extra\n3,4,z\n")
    schema = T.StructType([T.StructField("person_id", T.LongType()), T.StructField("value", T.DoubleType())])
    got = readers.read_sites(spark, {"A": str(tmp_path / "a.csv"), "B": str(tmp_path / "b.csv")}, {"A": {"pid": "person_id", "val": "value", "secret": None}}, schema)
    assert sorted((r["person_id"], r["value"], r["site"]) for r in got.collect() if r["value"] is not None) == [(1, 2.5, "A"), (3, 4.0, "B")]
    assert got.count() == 3 and "secret" not in got.columns
    status = {r["column"]: r["status"] for r in readers.conformance(got, ["person_id", "gone"], "t").collect()}
    assert status == {"person_id": "present", "gone": "missing", "value": "unlisted", "site": "unlisted"}
    assert {r["extension"] for r in readers.inventory(spark, str(tmp_path)).collect()} == {"csv"}
    (tmp_path / "k.txt").write_text("Age: 12\nName: ann\n")
    kv = T.StructType([T.StructField("Age", T.LongType()), T.StructField("Name", T.StringType())])
    assert tuple(readers.key_values(spark, str(tmp_path / "k.txt"), kv).first()) == (12, "ann")
    readers.write_report(spark.createDataFrame([("g", 20)], "part string, n long"), str(tmp_path / "report"))
    with pytest.raises(ValueError):
        readers.write_report(spark.createDataFrame([(1,)], "patient_id long"), str(tmp_path / "bad"))


def test_streams(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    made(spark, BASE).coalesce(1).write.parquet(src)
    schema = made(spark, []).schema
    incremental.run_once(incremental.gated(incremental.new_files(spark, src, schema), index_of(spark)), out, ck)
    assert spark.read.parquet(out).count() == 3
    made(spark, [(9, 1, "lab", "a", 1.0, None, hours(-1), hours(-1), None), (10, 1, "lab", "a", 1.0, None, hours(-1), hours(1), None)]).coalesce(1).write.mode("append").parquet(src)
    incremental.run_once(incremental.gated(incremental.new_files(spark, src, schema), index_of(spark)), out, ck)
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 9]
    near, ck2 = str(tmp_path / "near"), str(tmp_path / "ck2")
    stream = lambda: incremental.nearest(incremental.new_files(spark, src, schema), index_of(spark))
    wanted = lambda: {(r["entity_id"], r["source"]): r["gap_h"] for r in nearest.nearest_gaps(index_of(spark).filter("t0 IS NOT NULL"), spark.read.parquet(src)).collect() if r["entity_id"] == 1}
    told = lambda: {(r["entity_id"], r["source"]): r["gap_h"] for r in spark.read.parquet(near).filter("entity_id = 1").collect()}
    incremental.kept(stream(), near, ck2)
    first = told()
    assert first == wanted()
    # only the new file is read, and the state of the first run goes on
    made(spark, [(11, 1, "lab", "a", 1.0, None, hours(-0.25), hours(0), None), (12, 1, "new", "a", 1.0, None, hours(50), hours(50), None)]).coalesce(1).write.mode("append").parquet(src)
    incremental.kept(stream(), near, ck2)
    assert told() == wanted() and told() != first and (1, "new") in told()


def test_bootstrap_modes_by_hand(spark):
    import hashlib

    values = {"a": [0.0, 1.0, 5.0], "b": [10.0, 12.0], "c": [-3.0]}
    draw = lambda n, *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) % n
    rows = spark.createDataFrame([(s, i, v) for s, x in values.items() for i, v in enumerate(x)], "site string, entity int, v double")
    sites = list(values)
    for mode in metrics.MODES:
        got = {r["rep"]: r["mean"] for r in metrics.bootstrap_means(rows, "site", "v", 120, 3, mode).collect()}
        assert sorted(got) == list(range(120))
        for rep in got:
            drawn = [(s, []) for s in sites] if mode == "within_site" else [(sites[draw(3, 3, rep, "site", p)], [p]) for p in range(3)]
            if mode == "cluster":
                want = [v for s, _ in drawn for v in values[s]]
            else:
                want = [values[s][draw(len(values[s]), 3, rep, *p, s, k)] for s, p in drawn for k in range(len(values[s]))]
            assert abs(got[rep] - sum(want) / len(want)) < 1e-9
    with pytest.raises(Exception, match="at least 2 sites"):
        metrics.bootstrap_means(rows.filter("site = 'a'"), "site", "v", 5, 3, "cluster").collect()


def test_bootstrap_draws_over_many_blocks(spark, monkeypatch):
    import hashlib

    import numpy as np

    heads, tails = [b"7|12|\xc3\xb1|", b"7|999|x|", b"h" * 8], [b"10", b"99"]
    wide = [b"s" * k + h for h in heads[1:] for k in (0, 48, 60, 130)]
    for h in [heads[0], *wide]:
        want = [[int(hashlib.md5(h + t).hexdigest()[:8], 16) for t in tails]]
        assert metrics.md5_numbers(np.array([list(h)]), np.array([list(t) for t in tails])).tolist() == want
    monkeypatch.setattr(metrics, "BLOCK", 64)
    monkeypatch.setattr(metrics, "SLOTS", 48)
    n, name = 300, "é" * 30
    draw = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) % n
    got = {}
    for start in range(0, n, 48):
        blocks, counts, offsets = metrics.packed_draws(5, name, n, range(start, min(n, start + 48)), [9, 10, 10], [2, 0, 1])
        for b, c, o in zip(blocks, counts, offsets):
            for i, x in zip(np.repeat(range(3), c), np.frombuffer(o, np.uint16)):
                got.setdefault(int(i), []).append(int(b) * 64 + int(x))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(draw(5, r, p, name, s) for s in range(n)) for i, (r, p) in enumerate([(9, 2), (10, 0), (10, 1)])}


def test_bootstrap_joins_no_draws(spark):
    rows = spark.range(40).selectExpr("CAST(id % 3 AS STRING) AS site", "id AS entity", "IF(id % 7 = 0, NULL, CAST(id AS DOUBLE)) AS v")
    plan = metrics.bootstrap_means(rows, "site", "v", 20, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("FlatMapCoGroupsInPandas")[-1] and "MapInArrow" in plan


def test_codes_without_visit_or_rare_stay_spread(spark):
    rules = spark.createDataFrame([("A", None, "low"), ("B", None, "high")], "prefix string, exclude string, item string")
    codes = spark.range(800).selectExpr("id AS entity_id", "IF(id % 8 = 0, 'B1', 'A1') AS code", "IF(id % 4 = 1, TIMESTAMP_NTZ '2024-01-01', NULL) AS t", "IF(id % 4 = 2, id, NULL) AS visit_id")
    visits = spark.range(0, 800, 6).selectExpr("id AS visit_id", "TIMESTAMP_NTZ '2024-02-01' AS t_start").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS visit_id, TIMESTAMP_NTZ '2020-01-01' AS t_start"))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = builders.code_events(codes, rules, visits, ("high",)).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    want = {}
    for i in range(800):
        b = i % 8 == 0
        basis = "own" if i % 4 == 1 else "visit" if i % 4 == 2 and i % 6 == 0 else "unknown"
        if basis != "unknown" or b:
            want[i] = ("high" if b else "low", basis)
    assert {r["entity_id"]: (r["key"], r["basis"]) for r in got} == want and len(got) == len(want)
    for basis in ("own", "unknown"):
        parts = [r["part"] for r in got if r["basis"] == basis]
        assert max(map(parts.count, set(parts))) < 0.6 * len(parts)


def test_built_events_read_line_items_once_each(spark):
    from tidegate.plans import registry

    plan = registry.queries()["ev06_built"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "l_orderkey" in line for line in plan.splitlines()) == 3


def plain_pools(sizes, k):
    """The smallest group joins the next smallest until all have k."""
    groups = sorted((n, s, [s]) for s, n in sizes.items() if n > 0)
    while len(groups) > 1 and groups[0][0] < k:
        (n, _, a), (m, first, b), *rest = groups
        groups = sorted([(n + m, first, b + a), *rest])
    pools = {s: "+".join(sorted(g)) for _, _, g in groups for s in g}
    return {s: pools.get(s, s) for s in sizes}


@pytest.mark.parametrize("sizes", [{"a": 4, "b": 9, "c": 9, "d": 50}, {"a": 4, "b": 3}, {"a": 12, "b": 10}, {"a": 0, "b": 5, "c": 11, "d": 2}, {"a": 5}, {c: i for i, c in enumerate("abcdefghij")}])
def test_no_pool_is_small(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "site string, n long")
    got = {r["site"]: r["pool"] for r in disclose.pooled_sites(rows, "site", 10).collect()}
    assert got == plain_pools(sizes, 10)
    total = {}
    for s, p in got.items():
        total[p] = total.get(p, 0) + sizes[s]
    assert all(n >= 10 or n == 0 for n in total.values()) or sum(sizes.values()) < 10


def followed(latest, a, max_hops):
    """One record after another, no further than the last id before one that was passed."""
    passed, at = {a}, latest[a]
    for _ in range(max_hops):
        onward = latest.get(at)
        if onward is None or onward in passed:
            return at
        passed.add(at)
        at = onward
    return at


def test_merges_equal_following_one_by_one(spark):
    pairs = {1: 2, 2: 3, 3: 4, 4: 1, 10: 11, 11: 12, 12: 10, 13: 10, 14: 13, 20: 20, 21: 20, 30: 31, 40: 41, 41: 40, 42: 41}
    pairs |= {k: k + 1 for k in range(100, 140)} | {200 + k: 200 + (k + 1) % 7 for k in range(7)} | {210: 203, 211: 210}
    old = [(k, k + 5000, 0) for k in pairs] + [(k, k + 6000, None) for k in pairs]
    rows = spark.createDataFrame([(k, v, 1) for k, v in pairs.items()] + old, "old long, new long, mod int")
    for hops in (20, 3, 1):
        got = {r["old"]: r["survivor"] for r in identity.resolved(rows, hops).collect()}
        assert got == {k: followed(pairs, k, hops) for k in pairs}
    assert identity.resolved(rows.limit(0)).count() == 0


def test_only_acute_intervals_are_hops(spark):
    rows = [(1, 1, hours(-90), hours(-40), False, 5), (1, 2, hours(-60), hours(-45), False, 1), (1, 3, hours(-30), hours(3), False, 1), (1, 4, hours(-99), hours(-31), True, 1)]
    i = spark.createDataFrame(rows, "entity_id long, interval_id long, t_start timestamp_ntz, t_end timestamp_ntz, open boolean, class_rank int")
    m = spark.createDataFrame([(7, 1, T0, hours(-30))], "point_id long, entity_id long, t timestamp_ntz, t_start timestamp_ntz")
    assert intervals.chained_start(m, i, 24, "class_rank <= 2").first()["start"] == hours(-60)
    assert intervals.chained_start(m, i, 24).first()["start"] == hours(-90)
    assert intervals.chained_start(m, i, 24, "class_rank > 9").first()["start"] == hours(-30)


def test_features_refuse_what_isnt_gated(spark):
    e, ix = made(spark, BASE), index_of(spark)
    f = [features.Feature("a", "latest", "lab", "a")]
    shown = gate.as_of_presentation(e, ix, ["lab", "drug"], 6)
    for frame in (e, shown, shown.withColumnRenamed("hours_before_t0_event", "hours_since_event")):
        with pytest.raises(ValueError):
            features.matrix(frame, ix, f)
        with pytest.raises(ValueError):
            gate.violations(frame)
    assert features.matrix(gate.as_of(e, ix), ix, f).count() == 2


STEPS = "site string, stage int, step string, unit string, remaining long, start boolean"


def some_flows(seed):
    rng, out = random.Random(seed), []
    for i in range(30):
        left = rng.choice([3, 12, 60, 300])
        for j in range(rng.randrange(1, 8)):
            left = max(0, left - rng.choice([0, 1, 4, 7, 15, 40])) if j else left
            out.append((f"r{i}", j, f"s{j}", "n" if j < 4 else "p", left, j == 0))
    rng.shuffle(out)
    return out


def holds_no_small_count(rows, k):
    """Neither a shown count nor what two shown remainders leave is between 1 and k - 1."""
    for r in rows:
        assert all(v is None or v == 0 or v >= k for v in (r["n_excluded"], r["n_remaining"]))
    known = [r["n_remaining"] for r in sorted(rows, key=lambda r: r["row"])]
    for a, b in zip(known, known[1:]):
        assert a is None or b is None or a - b == 0 or a - b >= k


def test_merged_flow_shows_no_small_count(spark):
    steps = some_flows(6)
    exact = {(s, name): n for s, _, name, _, n, _ in steps}
    order = {}
    for s, _, name, *_ in sorted(steps):
        order.setdefault(s, []).append(name)
    got = {}
    for r in flow.merged_flow(spark.createDataFrame(steps, STEPS), "site", 11).collect():
        got.setdefault(r["site"], []).append(r)
    assert set(got) == set(order)
    for s, rows in got.items():
        rows.sort(key=lambda r: r["row"])
        holds_no_small_count(rows, 11)
        if exact[s, order[s][0]] < 11:
            assert [(r["step"], r["n_remaining"]) for r in rows] == [("withheld", None)]
            continue
        assert [x for r in rows for x in r["step"].split(" + ")] == order[s]  # each step once, in order
        for a, b in zip(rows, rows[1:]):
            assert b["n_remaining"] is None or b["n_remaining"] == exact[s, b["step"].split(" + ")[-1]]
            if b["n_excluded"] is not None:
                assert b["n_excluded"] == exact[s, a["step"].split(" + ")[-1]] - exact[s, b["step"].split(" + ")[-1]]
            if b is not rows[-1]:
                assert b["n_excluded"] is not None  # only a last row is hidden
    by_hand = [("u", 0, "a", "n", 100, True), ("u", 1, "b", "n", 80, False), ("u", 2, "c", "n", 76, False), ("u", 3, "d", "p", 60, False), ("v", 0, "a", "n", 100, True), ("v", 1, "b", "n", 97, False), ("v", 2, "c", "n", 95, False), ("w", 0, "a", "n", 30, True), ("w", 1, "b", "n", 5, False)]
    got = flow.merged_flow(spark.createDataFrame(by_hand, STEPS), "site", 11).orderBy("site", "row").collect()
    assert [tuple(r)[2:] for r in got] == [
        ("a", "n", None, 100), ("b + c", "n", 24, 76), ("d", "p", 16, 60),  # the unit bars c from d
        ("a", "n", None, 100), ("b + c", "n", None, None),  # nothing excludes 11
        ("a", "n", None, 30), ("b", "n", None, None),  # 30 - 25 would tell 5
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_flow_report_gives_nothing_away_by_subtraction(spark, seed):
    steps = [x for x in some_flows(seed) if x[0] in {f"r{i}" for i in range(3 + 3 * seed)}]
    got = {}
    for r in flow.flow_report(spark.createDataFrame(steps, STEPS), "site", 11).collect():
        got.setdefault(r["group"], {})[r["row"]] = r
    assert "ALL" in got and {s for g in got if g != "ALL" for s in g.split("+")} == {s for s, *_ in steps}
    for rows in got.values():
        holds_no_small_count(list(rows.values()), 11)
    for row, r in got["ALL"].items():
        for c in ("n_excluded", "n_remaining"):
            others = [rows[row][c] if row in rows else None for g, rows in got.items() if g != "ALL"]
            if r[c] is not None and None in others:
                rest = r[c] - sum(x for x in others if x is not None)
                assert others.count(None) > 1 and (rest == 0 or rest >= 11)


def test_availability_gives_nothing_away(spark):
    rng = random.Random(4)
    rows = [(s, i < yes) for s, yes, n in (("a", 40, 90), ("b", 3, 50), ("c", 40, 80)) for i in range(n)]
    got = {r["site"]: r for r in audits.availability(spark.createDataFrame(rows, "site string, f boolean"), "site", ["f"]).collect()}
    assert got["b"]["n"] is None and got["b"]["why"] == "low" and got[None]["n"] is None and got[None]["why"] == "linked" and got[None]["total"] == 220
    for _ in range(6):
        sizes = {f"s{i}": (rng.choice([0, 5, 12, 40]), rng.choice([0, 5, 12, 40])) for i in range(rng.randrange(1, 5))}
        rows = [(s, j < yes) for s, (yes, no) in sizes.items() for j in range(yes + no)] or [("s0", True)]
        cells = audits.availability(spark.createDataFrame(rows, "site string, f boolean"), "site", ["f"]).collect()
        for c in ("n", "total"):
            shown = {r["site"]: r[c] for r in cells}
            assert all(v is None or v >= 11 for v in shown.values())
            assert shown[None] is None or None not in [v for s, v in shown.items() if s is not None]
        for r in cells:
            assert r["n"] is None or r["total"] - r["n"] >= 11


def test_ranks_of_a_group_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 7}", rng.randrange(40), i, None if i % 11 == 0 else rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "site string, day int, id long, x double").repartition(7)
    got = ranks.ranked(df, ["site"], [F.desc("day"), "id"], ("day",)).withColumn("tile", ranks.ntile(7)).collect()
    by = {}
    for site, day, i, _ in rows:
        by.setdefault(site, []).append((-day, i))
    for site, members in by.items():
        want, total, n = {}, 0, len(members)
        for k, (day, i) in enumerate(sorted(members)):
            total -= day
            base, more = divmod(n, 7)
            tile = k // (base + 1) if k < more * (base + 1) else more + (k - more * (base + 1)) // max(base, 1)
            want[i] = (k + 1, n, total, tile + 1)
        assert {r["id"]: (r["_rank"], r["_size"], r["_sum_day"], r["tile"]) for r in got if r["site"] == site} == want
    parts = ranks.ranked(df, ["site"], ["day", "id"]).filter("site = 'hot'").select(F.floor(F.col("_rank") / 400)).distinct().count()
    assert parts >= 4
    q = {r["site"]: (r["n"], r["m"], r["h"]) for r in ranks.quantiles(df, ["site"], "x", {"m": 0.5, "h": 0.9}).collect()}
    for site in by:
        x = [v for s, _, _, v in rows if s == site and v is not None]
        assert q[site][0] == len(x) and np.allclose(q[site][1:], np.quantile(x, [0.5, 0.9]))

"""Spectra, connectivity and pooling against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import signals

BANDS = {"low": (2.0, 9.0), "high": (9.0, 33.0)}


@pytest.mark.parametrize("taper", [True, False])
def test_connectivity_equals_plain_cross_spectra(spark, taper):
    rng = np.random.default_rng(4)
    x = {(r, c, e): rng.normal(size=32) for r in range(2) for c in range(4) for e in range(7)}
    for r in range(2):
        for e in range(7):
            x[r, 1, e] = 0.8 * np.roll(x[r, 0, e], 2) + 0.3 * x[r, 1, e]  # follows channel 0
    bad = {(0, 1, 2), (0, 3, 0), (1, 2, 1)} | {(1, 3, e) for e in range(6)}
    rows = [(r, c, e, v.tolist(), (r, c, e) in bad) for (r, c, e), v in x.items()] + [(0, 0, 99, None, False), (0, 1, 99, [float("nan")] * 32, False)]
    df = spark.createDataFrame(rows, "rec int, ch int, epoch int, x array<double>, bad boolean").repartition(4)
    got = {(r["rec"], r["pair"], r["band"]): r for r in signals.connectivity(df, [("0-1", 0, 1), ("2-3", 2, 3), ("0-9", 0, 9)], 64.0, BANDS, 3, taper).collect()}
    hz, w = np.fft.rfftfreq(32, 1 / 64), np.hanning(32) if taper else 1.0
    for r in range(2):
        for pair, a, b in (("0-1", 0, 1), ("2-3", 2, 3)):
            f = [[np.fft.rfft((x[r, c, e] - x[r, c, e].mean()) * w) for e in range(7) if (r, a, e) not in bad and (r, b, e) not in bad] for c in (a, b)]
            f = np.array(f)
            s = f[0] * np.conj(f[1])
            coh = abs(s.mean(0)) ** 2 / ((abs(f[0]) ** 2).mean(0) * (abs(f[1]) ** 2).mean(0))
            pli = abs(s.imag.mean(0)) / np.maximum(abs(s.imag).mean(0), 1e-24)
            for band, (lo, hi) in BANDS.items():
                g, at = got[r, pair, band], (hz >= lo) & (hz < hi)
                assert g["segments"] == f.shape[1]
                if f.shape[1] < 3:
                    assert g["coherence"] is None and g["wpli"] is None
                else:
                    assert abs(g["coherence"] - coh[at].mean()) < 1e-9 and abs(g["wpli"] - pli[at].mean()) < 1e-9
    assert not [k for k in got if k[1] == "0-9"] and got[0, "0-1", "high"]["coherence"] > 0.5
    sets = {r["set"]: r["coherence"] for r in signals.pair_means(signals.connectivity(df, [("0-1", 0, 1), ("2-3", 2, 3)], 64.0, BANDS, 3, taper), {"all": ["0-1", "2-3"], "one": ["0-1"]}).filter("rec = 0 AND band = 'low'").collect()}
    assert abs(sets["all"] - (got[0, "0-1", "low"]["coherence"] + got[0, "2-3", "low"]["coherence"]) / 2) < 1e-9 and abs(sets["one"] - got[0, "0-1", "low"]["coherence"]) < 1e-9
    assert signals.connectivity(df.limit(0), [("0-1", 0, 1)], 64.0, BANDS).count() == 0


@pytest.mark.parametrize("tau", [1.0, 0.1, 0.001])
def test_attention_pooling_equals_plain_softmax(spark, tau):
    rng = np.random.default_rng(7)
    made = {"a": rng.normal(size=(40, 6)) + 1, None: rng.normal(size=(15, 6)), "one": rng.normal(size=(1, 6))}
    rows = [(g, v.tolist()) for g, vs in made.items() for v in vs] + [("a", None), ("a", [None] * 6), ("none", None)]
    got = {}
    for r in signals.attention_pooled(spark.createDataFrame(rows, "g string, v array<double>").repartition(5), "g", "v", tau).collect():
        got.setdefault(r["g"], {})[r["dim"]] = r
    assert set(got) == set(made)
    for g, e in made.items():
        m = e.mean(0)
        s = (e @ m) / (np.linalg.norm(e, axis=1) * np.linalg.norm(m) + 1e-12) / tau
        w = np.exp(s - s.max())
        for dim in range(6):
            r = got[g][dim]
            assert r["n"] == len(e) and abs(r["mean"] - m[dim]) < 1e-9 and abs(r["pooled"] - (w @ e / w.sum())[dim]) < 1e-8


def plain_phrases(bits):
    """Words of the exhaustive history: each is the shortest that doesn't occur in all before its own last letter."""
    s, start, n = "".join(map(str, bits)), 0, 0
    while start < len(s):
        end = start + 1
        while end <= len(s) and s[start:end] in s[: end - 1]:
            end += 1
        start, n = end, n + 1
    return n


def test_spectra_and_complexity_equal_plain_ones(spark):
    rng = np.random.default_rng(2)
    t = np.arange(64) / 64
    made = [np.sin(2 * np.pi * 10 * t), rng.normal(size=64), np.ones(64), np.sin(2 * np.pi * 2 * t) + 0.1 * rng.normal(size=64)]
    rows = [(i, v.tolist()) for i, v in enumerate(made)] + [(9, None), (10, [1.0])]
    got = {r["i"]: r for r in signals.complexity(signals.spectra(spark.createDataFrame(rows, "i int, x array<double>"), 64.0)).collect()}
    for i, v in enumerate(made):
        k = np.arange(33)
        power = np.array([abs((v - v.mean()) @ np.exp(-2j * np.pi * f * np.arange(64) / 64)) ** 2 for f in k])
        for band, (lo, hi) in signals.BANDS.items():
            assert abs(got[i][band] - (power[(k >= lo) & (k < hi)].sum() / (power.sum() or 1) if i != 2 else 0)) < 1e-6
        if i != 2:
            assert power[: int(got[i]["edge"]) + 1].sum() >= 0.95 * power.sum() - 1e-6 > power[: int(got[i]["edge"])].sum() - 1e-6
        assert abs(got[i]["complexity"] - plain_phrases((v > np.median(v)).astype(int)) * 6 / 64) < 1e-9
    assert got[9]["alpha"] is None and got[10]["alpha"] is None and got[9]["complexity"] is None and got[0]["alpha"] > 0.99


def test_registered_spectra_equal_plain_ones(spark):
    from tidegate.plans import registry

    d = "/root/testdata/sf0.001"
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    got = registry.queries()["sg08_spectra"](spark, d).collect()
    assert {r["vec_id"] for r in got} == set(x)
    for r in got:
        v = x[r["vec_id"]]
        f = np.fft.rfft(v - v.mean())
        p = abs(f) ** 2
        assert abs(r["beta"] - p[(np.arange(33) >= 13) & (np.arange(33) < 30)].sum() / p.sum()) < 2e-6
        assert abs(r["complexity"] - plain_phrases((v > np.median(v)).astype(int)) * 6 / 64) < 2e-6


def test_spectra_hold_no_objects():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tidegate.operators import signals

    rng = np.random.default_rng(1)
    rows = [rng.normal(size=64).tolist() for _ in range(1000)] + [None, [], [1.0], [1.0, None, 2.0], [1.0, float("nan")], [1.0, 2.0, 4.0]]
    x = pa.array([[9.0], *rows], pa.list_(pa.float64())).slice(1)
    tracemalloc.start()
    got = signals.transformed(x, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6  # 33 pairs of 1,000 arrays are 0.5 MB of numbers
    got = got.to_pylist()
    for i in (0, 999, 1005):
        a = np.asarray(rows[i])
        want = np.fft.rfft((a - a.mean()) * np.hanning(a.size))
        assert np.allclose([complex(v["re"], v["im"]) for v in got[i]], want)
    assert got[1000:1005] == [None] * 5

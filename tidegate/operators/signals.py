"""Signals as rows of arrays: artifact flags, window quality, onset, average reference, spectra, complexity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)}


def epoch_flags(epochs: DataFrame, flat: float, extreme: float) -> DataFrame:
    """Adds flat, extreme, clipped (three or more samples at the top or bottom) and bad to rows (rec, ch, epoch, x)."""
    hi, lo = F.array_max("x"), F.array_min("x")
    at_end = F.size(F.filter("x", lambda v: (v == hi) | (v == lo)))
    flags = {"flat": hi - lo < flat, "extreme": F.greatest(F.abs(hi), F.abs(lo)) > extreme, "clipped": (hi > lo) & (at_end >= 4)}
    return epochs.withColumns(flags).withColumn("bad", F.col("flat") | F.col("extreme") | F.col("clipped"))


def window_quality(flags: DataFrame, windows: DataFrame, least_channels: int, least_share: float) -> DataFrame:
    """rec, window, usable share of epochs with enough good channels, ok. windows (window, lo, hi) are a short list."""
    good = flags.groupBy("rec", "epoch").agg(F.count(F.when(~F.col("bad"), 1)).alias("good"))
    inside = good.join(F.broadcast(windows), (F.col("epoch") >= F.col("lo")) & (F.col("epoch") < F.col("hi")))
    out = inside.groupBy("rec", "window").agg(F.avg((F.col("good") >= least_channels).cast("double")).alias("usable"), F.count("*").alias("n"))
    return out.withColumn("ok", F.col("usable") >= least_share)


def onset(flags: DataFrame, run: int, least_live: int, least_channels: int, grid: int) -> DataFrame:
    """rec, onset: the first epoch of the grid from which enough channels live in most of the next epochs."""
    w = Window.partitionBy("rec", "ch").orderBy("epoch").rowsBetween(0, run - 1)
    r = flags.withColumns({"_live": F.sum((~F.col("flat")).cast("int")).over(w), "_n": F.count("*").over(w)})
    ok = r.filter((F.col("_n") == run) & (F.col("_live") >= least_live) & (F.col("epoch") % grid == 0)).groupBy("rec", "epoch").agg(F.count("*").alias("c"))
    return flags.select("rec").distinct().join(ok.filter(F.col("c") >= least_channels).groupBy("rec").agg(F.min("epoch").alias("onset")), "rec", "left")


def average_reference(samples: DataFrame) -> DataFrame:
    """rec, ch, t, x less the mean of the good channels at that time. samples: rec, ch, t, x, bad."""
    mean = F.avg(F.when(~F.col("bad"), F.col("x"))).over(Window.partitionBy("rec", "t"))
    return samples.select("rec", "ch", "t", (F.col("x") - mean).alias("x"))


def spectra(rows: DataFrame, fs: float) -> DataFrame:
    """Adds relative power of each band and the frequency below which 95 % of the power lies; each row is one array x."""
    kind = "struct<" + ",".join(f"{b}:double" for b in BANDS) + ",edge:double>"

    @F.pandas_udf(kind)
    def power(xs: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in xs:
            out = []
            for x in s:
                x = np.asarray(x if x is not None else [], float)
                if x.size < 2 or not np.isfinite(x).all():
                    out.append((None,) * (len(BANDS) + 1))
                    continue
                p = np.abs(np.fft.rfft(x - x.mean())) ** 2
                f, total = np.fft.rfftfreq(x.size, 1 / fs), p.sum() or 1.0
                edge = f[min(np.searchsorted(p.cumsum(), 0.95 * p.sum()), f.size - 1)]
                out.append((*[float(p[(f >= a) & (f < b)].sum() / total) for a, b in BANDS.values()], float(edge)))
            yield pd.DataFrame(out, columns=[*BANDS, "edge"])

    return rows.withColumn("_p", power("x")).select("*", "_p.*").drop("_p")


def phrases(bits: np.ndarray) -> int:
    """Phrases of the exhaustive history of a binary sequence."""
    s, i, n = bits.astype(np.uint8).tobytes(), 0, 0
    while i < len(s):
        k = 1
        while i + k <= len(s) and s[i : i + k] in s[: i + k - 1]:
            k += 1
        i, n = i + k, n + 1
    return n


def complexity(rows: DataFrame) -> DataFrame:
    """Adds complexity: phrases about the median, scaled by n / log2 n."""

    @F.pandas_udf("double")
    def scaled(xs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in xs:
            yield pd.Series([None if x is None or len(x) < 2 else phrases(np.asarray(x) > np.median(x)) * np.log2(len(x)) / len(x) for x in s], dtype="float64")

    return rows.withColumn("complexity", scaled("x"))


def attention_pooled(rows: DataFrame, by: str, vector: str, tau: float = 0.1) -> DataFrame:
    """by, dim, n, mean and pooled: the vectors of a group weighed by the softmax of their cosine to the mean vector, over tau.

    All vectors of a group have one length; null ones, and those with an unknown component, take no part. A group's sums are aggregates
    by dimension: only its mean vector meets its rows.
    """
    good = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x))
    known = rows.select(F.col(by).alias("g"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull()).filter(good)
    means = known.select("g", F.posexplode("v").alias("dim", "x")).groupBy("g", "dim").agg(F.avg("x").alias("mean"))
    centre = means.groupBy(F.col("g").alias("cg")).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda m: m["mean"]).alias("m"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("v", "m") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("m", "m")) + F.lit(1e-12))
    scored = known.join(centre, F.col("g").eqNullSafe(F.col("cg"))).select("g", "v", (cosine / tau).alias("s"))
    top = scored.groupBy(F.col("g").alias("tg")).agg(F.max("s").alias("top"))
    weighed = scored.join(top, F.col("g").eqNullSafe(F.col("tg"))).select("g", "v", F.exp(F.col("s") - F.col("top")).alias("w"))
    sums = weighed.select("g", "w", F.posexplode("v").alias("dim", "x")).groupBy("g", "dim")
    out = sums.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("pooled"))
    return out.select(F.col("g").alias(by), F.col("dim").cast("long").alias("dim"), "n", "mean", "pooled")


#: Arrays that are transformed at a time.
TOGETHER = 1024


def transformed(x: pa.ListArray, taper: bool) -> pa.ListArray:
    """The spectra of arrays, those of one length together; no number becomes an object."""
    start, ends = x.offsets.to_numpy()[:-1], x.offsets.to_numpy()[1:]
    size = np.where(x.is_valid().to_numpy(zero_copy_only=False), ends - start, 0)
    values = x.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    found, known = {}, np.zeros(len(x), bool)
    for n in np.unique(size[size >= 2]):
        at = np.flatnonzero(size == n)
        some = values[start[at][:, None] + np.arange(n)]
        fine = np.isfinite(some).all(axis=1)
        at, some = at[fine], some[fine]
        known[at] = True
        found[n] = at, np.fft.rfft((some - some.mean(axis=1, keepdims=True)) * (np.hanning(n) if taper else 1.0), axis=1)
    offsets = np.r_[0, np.cumsum(np.where(known, size // 2 + 1, 0))]
    flat = np.empty(offsets[-1], np.complex128)
    for at, f in found.values():
        flat[offsets[at][:, None] + np.arange(f.shape[1])] = f
    pairs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat.real)), pa.array(np.ascontiguousarray(flat.imag))], ["re", "im"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs, mask=pa.array(~known))


def fourier(rows: DataFrame, taper: bool = True) -> DataFrame:
    """Adds f, an array of (re, im) from frequency 0 up, of x less its mean, under a Hann window if asked; null where x is short or odd."""

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(first, TOGETHER)
                yield pa.RecordBatch.from_arrays([*some.columns, transformed(some.column("x"), taper)], [*some.schema.names, "f"])

    kind = T.ArrayType(T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]))
    return rows.mapInArrow(transform, T.StructType([*rows.schema.fields, T.StructField("f", kind)]))


def connectivity(segments: DataFrame, pairs: list[tuple[str, object, object]], fs: float, bands: dict[str, tuple[float, float]], least: int = 2, taper: bool = True) -> DataFrame:
    """rec, pair, band, segments, coherence, wpli over the segments (rec, ch, epoch, x, bad) in which both channels of a pair are good.

    Each segment is transformed once. Two channels meet by recording and segment, and what they have in common is added up by
    frequency over the segments: no recording is in one row. Fewer than ``least`` segments give null. All segments have one length.
    """
    spark = segments.sparkSession
    spectra_of = fourier(segments.filter(~F.coalesce(F.col("bad"), F.lit(False))).select("rec", "ch", "epoch", "x"), taper).filter("f IS NOT NULL").select("rec", "ch", "epoch", F.size("x").alias("size"), "f")
    kind = segments.schema["ch"].dataType.simpleString()
    listed = spark.createDataFrame(pairs, f"pair string, a {kind}, b {kind}")  # a row for each pair of channels
    one = spectra_of.join(listed, F.col("ch") == F.col("a")).select("rec", "epoch", "pair", "b", "size", F.col("f").alias("fa"))
    other = spectra_of.select(F.col("rec").alias("orec"), F.col("epoch").alias("oe"), F.col("ch").alias("oc"), F.col("f").alias("fb"))
    met = one.join(other, (F.col("rec") == F.col("orec")) & (F.col("epoch") == F.col("oe")) & (F.col("b") == F.col("oc")))
    square = lambda x: x["re"] * x["re"] + x["im"] * x["im"]
    crossed = F.zip_with("fa", "fb", lambda x, y: F.struct((x["re"] * y["re"] + x["im"] * y["im"]).alias("re"), (x["im"] * y["re"] - x["re"] * y["im"]).alias("im"), square(x).alias("xx"), square(y).alias("yy")))
    each = met.select("rec", "pair", "size", F.posexplode(crossed).alias("k", "s")).select("rec", "pair", "size", "k", "s.*")
    means = each.groupBy("rec", "pair", "size", "k").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("re", "im", "xx", "yy")], F.avg(F.abs("im")).alias("ai"))
    tiny = F.lit(1e-24)
    by_frequency = means.select(
        "rec", "pair", "n", (F.col("k") * fs / F.col("size")).alias("hz"),
        ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.greatest(F.col("xx") * F.col("yy"), tiny)).alias("coh"), (F.abs("im") / F.greatest(F.col("ai"), tiny)).alias("pli"),
    )
    named = F.array_compact(F.array(*[F.when((F.col("hz") >= lo) & (F.col("hz") < hi), F.lit(b)) for b, (lo, hi) in bands.items()]))
    enough = F.max("n") >= least
    return by_frequency.withColumn("band", F.explode(named)).groupBy("rec", "pair", "band").agg(
        F.max("n").alias("segments"), F.when(enough, F.avg("coh")).alias("coherence"), F.when(enough, F.avg("pli")).alias("wpli")
    )


def pair_means(connected: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """rec, band, set, coherence, wpli: means of known values over each set of pairs."""
    member = F.array_compact(F.array(*[F.when(F.col("pair").isin(pairs), F.lit(s)) for s, pairs in sets.items()]))
    return connected.withColumn("set", F.explode(member)).groupBy("rec", "band", "set").agg(F.avg("coherence").alias("coherence"), F.avg("wpli").alias("wpli"))

"""Bootstrap of any statistic that merges: each row carries how often every replicate draws it, and only sums leave a task.

Rows are dealt to pieces of about ``PIECE`` rows, by the hash of their entity or, for statistics of ranks, by ranges of a score. A site's
draws are split between its pieces by a tree of binomials, each keyed by seed, group, site and range, so that a piece knows its own
share by itself and all shares add up; within a piece the draws fall on its rows. That is drawing rows with replacement, exactly. A
piece turns the counts of some replicates at a time into a few sums for each replicate, and pieces add up. No row meets a replicate in
a shuffle. Pieces follow the data alone: reruns agree, whatever the partitions are.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.operators import ranks
from tidegate.operators.metrics import MODES, REPLICATES
from tidegate.sources.shared import written

#: Rows of a piece on average, and draws that a piece holds at a time.
PIECE, TOGETHER = 1 << 16, 1 << 18


@dataclass(frozen=True)
class Statistic:
    """names of the sums; sums(columns, counts) of a piece's rows, ordered by ``order`` if there is one, with counts (replicates x rows);
    merged(df) adds ``stat`` to rows (by, rep) with the pieces' sums added up, or by ``across`` before they are."""

    columns: tuple[str, ...]
    names: tuple[str, ...]
    sums: Callable[[pd.DataFrame, np.ndarray], np.ndarray]
    value: Column
    order: str | None = None
    across: Callable[[list[str]], dict[str, Column]] | None = None


def mean(x: str) -> Statistic:
    return ratio(x, None)


def ratio(a: str, b: str | None) -> Statistic:
    """Sum of a over sum of b, or over the number of rows."""

    def sums(rows: pd.DataFrame, counts: np.ndarray) -> np.ndarray:
        below = rows[b].to_numpy(np.float64) if b else np.ones(len(rows))
        return counts @ np.stack([rows[a].to_numpy(np.float64), below], 1)

    return Statistic((a, *([b] if b else [])), ("s", "n"), sums, F.try_divide("s", "n"))


def kappa(a: str, b: str) -> Statistic:
    """Of two raters' zeros and ones; null where chance alone agrees."""

    def sums(rows: pd.DataFrame, counts: np.ndarray) -> np.ndarray:
        x, y = rows[a].to_numpy(np.float64), rows[b].to_numpy(np.float64)
        return counts @ np.stack([x * y, x * (1 - y), (1 - x) * y, (1 - x) * (1 - y)], 1)

    n = F.expr("n11 + n10 + n01 + n00")
    agree = F.try_divide(F.expr("n11 + n00"), n)
    chance = F.try_divide(F.expr("(n11 + n10) * (n11 + n01) + (n00 + n01) * (n00 + n10)"), n * n)
    return Statistic((a, b), ("n11", "n10", "n01", "n00"), sums, F.when(chance < 1, (agree - chance) / (1 - chance)))


def auroc(y: str, score: str) -> Statistic:
    """Of outcomes 0 and 1 by a score, ties by halves; null where a replicate has one outcome only."""

    def sums(rows: pd.DataFrame, counts: np.ndarray) -> np.ndarray:
        s, one = rows[score].to_numpy(np.float64), rows[y].to_numpy(np.float64)
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        p, n = np.add.reduceat(counts * one, start, axis=1), np.add.reduceat(counts * (1 - one), start, axis=1)
        below = np.cumsum(n, axis=1) - n
        return np.stack([p.sum(1), n.sum(1), (p * (below + n / 2)).sum(1)], 1)

    def across(by: list[str]) -> dict[str, Column]:
        before = Window.partitionBy(*by, "rep").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        return {"u": F.col("u") + F.col("p") * F.coalesce(F.sum("n").over(before), F.lit(0.0))}

    return Statistic((y, score), ("p", "n", "u"), sums, F.try_divide("u", F.expr("p * n")), score, across)


def stream(*of: object) -> np.random.Generator:
    return np.random.default_rng([zlib.crc32(str(x).encode()) for x in of])


def share(sizes: list[int], piece: int, draws: np.ndarray, key: tuple) -> np.ndarray:
    """Of a site's draws in each replicate, those that fall on one piece; sizes are the site's rows in each piece."""
    total = np.r_[0, np.cumsum(sizes)]
    low, high = 0, len(sizes)
    while high - low > 1:
        mid = (low + high) // 2
        rows = total[high] - total[low]
        left = stream(*key, low, high).binomial(draws, (total[mid] - total[low]) / rows if rows else 0.0)
        draws, low, high = (left, low, mid) if piece < mid else (draws - left, mid, high)
    return draws


def site_draws(sites: list[str], replicates: int, mode: str, key: tuple) -> dict[str, np.ndarray]:
    """How often each replicate takes each site: once, or as drawn with replacement."""
    if mode == "within_site":
        return {s: np.ones(replicates, np.int64) for s in sites}
    if len(sites) < 2:
        raise ValueError("this mode needs at least 2 sites")
    picks = stream(*key, "sites").integers(0, len(sites), (replicates, len(sites)))
    return {s: (picks == i).sum(1) for i, s in enumerate(sites)}


def counts(site: np.ndarray, sizes: dict[str, list[int]], piece: int, replicates: int, mode: str, key: tuple) -> Iterator[tuple[int, np.ndarray]]:
    """(first replicate, counts of replicates x rows) of a piece's rows, some replicates at a time."""
    times = site_draws(sorted(sizes), replicates, mode, key)
    at = {s: np.flatnonzero(site == s) for s in sizes}
    drawn = {s: share(n, piece, times[s] * sum(n), (*key, s)) for s, n in sizes.items()} if mode != "cluster" else {}
    step = max(1, TOGETHER // max(1, len(site)))
    rng = {s: stream(*key, s, "piece", piece) for s in sizes}
    for first in range(0, replicates, step):
        some = slice(first, min(first + step, replicates))
        k = some.stop - first
        out = np.zeros((k, len(site)))
        for s, rows in at.items():
            if not rows.size:
                continue
            if mode == "cluster":
                out[:, rows] = times[s][some, None]
                continue
            n = drawn[s][some]
            hit = rng[s].integers(0, rows.size, int(n.sum())) + np.repeat(np.arange(k) * rows.size, n)
            out[:, rows] = np.bincount(hit, minlength=k * rows.size).reshape(k, rows.size)
        yield first, out


def placed(rows: DataFrame, by: list[str], site: str, entity: str, statistic: Statistic) -> DataFrame:
    """by, site, entity, the statistic's columns and piece, of the rows where all of these columns are known; an unknown site is one."""
    names = list(dict.fromkeys([*by, entity, *statistic.columns]))
    known = rows.select(*names, F.coalesce(F.col(site).cast("string"), F.lit("")).alias("_site"))
    for c in statistic.columns:
        known = known.filter(F.col(c).isNotNull())
    if statistic.order is None:
        size = known.groupBy(*by).agg(F.ceil(F.count("*") / PIECE).alias("_pieces"))
        out = known.join(size, by) if by else known.crossJoin(size)  # size is one row
        return out.withColumn("piece", F.pmod(F.xxhash64(entity), F.col("_pieces")).cast("int")).drop("_pieces")
    # rows of one score share a piece; a score's place is that of its first row
    tied = ranks.tied(known, by, statistic.order)
    cut = tied.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(statistic.order).alias("_o"), F.floor((F.col("rank") - (F.col("n") + 1) / 2) / PIECE).cast("int").alias("piece"))
    on = F.col(statistic.order) == F.col("_o")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return known.join(cut, on).drop("_o", *[f"_by_{c}" for c in by])


def replicated(rows: DataFrame, by: list[str], site: str, entity: str, statistic: Statistic, replicates: int = REPLICATES, seed: int = 0, mode: str = "within_site") -> DataFrame:
    """by, rep, stat of each replicate: rows drawn within sites, whole sites, or sites and then rows within each."""
    assert mode in MODES, f"mode must be one of {MODES}"
    dealt = written(placed(rows, by, site, entity, statistic), "pieces")
    sizes: dict[tuple, dict[str, list[int]]] = {}
    # a row for each piece of a site, which holds thousands of rows
    for r in dealt.groupBy(*by, "_site", "piece").agg(F.count("*").alias("n")).toLocalIterator():
        of = sizes.setdefault(tuple(str(r[c]) for c in by), {}).setdefault(r["_site"], [])
        of.extend([0] * (r["piece"] + 1 - len(of)))
        of[r["piece"]] = r["n"]
    for of in sizes.values():
        most = max(map(len, of.values()))
        for n in of.values():
            n.extend([0] * (most - len(n)))
    order = [c for c in (statistic.order, "_site", entity) if c]
    add, names = statistic.sums, list(statistic.names)

    def piece(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        *own, number = group
        key = tuple(str(x) for x in own)
        part = part.sort_values(order, ignore_index=True)
        out = []
        for first, n in counts(part["_site"].to_numpy(), sizes[key], int(number), replicates, mode, (seed, *key)):
            got = pd.DataFrame(add(part, n), columns=names)
            got.insert(0, "rep", np.arange(first, first + len(n), dtype=np.int32))
            out.append(got)
        got = pd.concat(out, ignore_index=True)
        for i, (c, x) in enumerate(zip([*by, "piece"], group)):
            got.insert(i, c, pd.Series([x] * len(got), dtype=part[c].dtype))
        return got

    schema = ", ".join([f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in by] + ["piece int", "rep int"] + [f"{n} double" for n in statistic.names])
    sums = dealt.groupBy(*by, "piece").applyInPandas(piece, schema)
    if statistic.across:
        sums = sums.withColumns(statistic.across(by))
    return sums.groupBy(*by, "rep").agg(*[F.sum(n).alias(n) for n in statistic.names]).select(*by, "rep", statistic.value.alias("stat"))


def interval(replicates: DataFrame, by: list[str], alpha: float = 0.05, least: float = 0.5) -> DataFrame:
    """by, reps, low, high, below: percentiles of the replicates that have a value, null if fewer than ``least`` of them do; and the
    one-sided p that the statistic isn't below zero. A group has a few thousand replicates."""
    known = F.count("stat")
    enough = known >= least * F.count("*")
    p = (F.count_if(F.col("stat") >= 0) + 1) / (known + 1)
    return replicates.groupBy(*by).agg(
        known.alias("reps"), F.when(enough, F.percentile("stat", F.lit(alpha / 2))).alias("low"), F.when(enough, F.percentile("stat", F.lit(1 - alpha / 2))).alias("high"), F.when(enough, p).alias("p_below")
    )


def difference(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """by, rep, stat: the statistic of b less that of a, replicate by replicate; both must have drawn the same rows."""
    return a.select(*by, "rep", F.col("stat").alias("_a")).join(b, [*by, "rep"]).select(*by, "rep", (F.col("stat") - F.col("_a")).alias("stat"))

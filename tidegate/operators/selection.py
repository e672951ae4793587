"""Choices made inside a fold: penalty and block scale by the loss on dev rows, and channels by greedy forward selection.

All fits of a step share their passes over the rows. A scale s on a block's columns is a penalty divided by s squared, so that a grid of
penalties and scales is a grid of penalties on the same columns. Nothing here reads a held-out row: it isn't in any model's groups.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.expressions import portable_hash
from tidegate.operators import fits
from tidegate.sources.shared import Scratch


def key_of(*values: object) -> str:
    """A group's key as fits.design() has it."""
    return json.dumps([str(v) for v in values], separators=(",", ":"))


def select_penalty(
    train: DataFrame, dev: DataFrame, label: str, y: str, entity: str, columns: list[str], block: Sequence[str], cs: Sequence[float], scales: Sequence[float], least: int = 1, default: tuple[float, float] = (1.0, 1.0)
) -> DataFrame:
    """c, scale, dev_loss, chosen of each point of the grid: logistic heads of all labels fitted on train rows with a penalty of 1/c, whose
    dev loss is the mean over entities of the mean over their known labels. The first of the lowest is chosen, the default if dev has
    fewer than ``least`` entities. A label whose head fails is scored at one half. Columns are prepared: scaled on the train rows.

    train, dev: rows (entity, label, y, columns).
    """
    keep = Scratch(train.sparkSession)
    grid = [(float(c), float(s)) for c in cs for s in scales]
    x = [F.lit(1.0), *[F.col(c) for c in columns]]
    known = dev.filter(F.col(y).isNotNull())
    share = known.groupBy(F.col(entity).alias("_e")).agg((1 / F.count("*")).alias("_w"))
    data = keep(fits.design(train, [label], F.col(y), x), "train")
    held = keep(fits.design(known.join(share, F.col(entity).eqNullSafe(F.col("_e"))), [label], F.col(y), x, F.col("_w")), "dev")
    n = known.select(entity).distinct().count()
    penalty = lambda c, s: tuple(0.0 if i == 0 else (1 / c) / (s * s if columns[i - 1] in block else 1.0) for i in range(len(x)))
    variants = [fits.Variant(tuple(range(len(x))), ridge=penalty(c, s)) for c, s in grid]
    score: list[float | None] = [None] * len(grid)
    if n >= least:
        found = fits.logistic(data, len(x), variants)
        labels = [r["key"] for r in held.select("key").distinct().collect()]  # labels are a few
        none = fits.Variant(tuple(range(len(x))))
        scored = []
        for i, v in enumerate(variants):
            for k in labels:
                f = found.get((k, i))
                ok = f is not None and f.converged
                scored.append((v if ok else none, f.coef if ok else [0.0] * len(x), frozenset([k])))
        weight = {r["key"]: r["w"] for r in held.groupBy("key").agg(F.sum("w").alias("w")).collect()}
        got = fits.losses(held, len(x), scored)
        for i in range(len(grid)):
            part = [(got[i * len(labels) + j], weight[k]) for j, k in enumerate(labels)]
            total = sum(w for _, w in part)
            score[i] = sum(v * w for v, w in part) / total if total else None
    known_scores = [(s, i) for i, s in enumerate(score) if s is not None]
    best = grid[min(known_scores)[1]] if known_scores else default
    keep.drop(data, held)
    return train.sparkSession.createDataFrame([(c, s, v, (c, s) == best) for (c, s), v in zip(grid, score)], "c double, scale double, dev_loss double, chosen boolean")


def forward_channels(
    rows: DataFrame, channels: dict[str, list[str]], y: str, fold: str, entity: str, k: int, forced: Sequence[str] = (), ridge: float = 1.0, inner: float = 0.25, seed: int = 0
) -> DataFrame:
    """fold, step, channel, loss: for each fold the k channels chosen from the other folds' rows alone. A step fits every candidate
    beside those chosen on three quarters of these rows, by hash of the entity, and takes the one with the lowest loss on the rest;
    of equal ones, the one named first. All folds and candidates of a step share their passes. Forced channels come first, without a loss.
    """
    names = list(channels)
    forced = list(dict.fromkeys(forced))
    if unknown := [c for c in forced if c not in channels]:
        raise ValueError(f"unknown channels {unknown}")
    if not len(forced) <= k <= len(names):
        raise ValueError(f"k must be between the forced channels and all channels, {len(forced)} and {len(names)}")
    columns = [c for n in names for c in channels[n]]
    at = {n: [1 + columns.index(c) for c in channels[n]] for n in names}
    part = (portable_hash(F.lit(str(seed)), F.col(entity).cast("string")) % 1000 < int(1000 * inner)).cast("int")
    known = rows.withColumn("_part", part).withColumn("_fold", F.col(fold).cast("string"))
    keep = Scratch(rows.sparkSession)
    width = 1 + len(columns)
    data = keep(fits.design(known, ["_fold", "_part"], F.col(y), [F.lit(1.0), *[F.col(c) for c in columns]]), "channels")
    folds = sorted(r["_fold"] for r in known.select("_fold").distinct().collect())  # folds are a handful
    chosen: dict[str, list[str]] = {f: list(forced) for f in folds}
    told = [(f, i + 1, c, None) for f in folds for i, c in enumerate(forced)]
    for step in range(len(forced), k):
        tries = [(f, c) for f in folds for c in names if c not in chosen[f]]
        models = []
        for f, c in tries:
            free = (0, *[i for n in [*chosen[f], c] for i in at[n]])
            others = [g for g in folds if g != f]
            models.append((fits.Variant(free, ridge=(0.0, *[ridge] * (len(free) - 1))), frozenset(key_of(g, 0) for g in others), frozenset(key_of(g, 1) for g in others)))
        fitted = fits.many(data, width, [fits.Model(v, dev) for v, dev, _ in models])
        scored = [(v, f.coef, test) for (v, _, test), f in zip(models, fitted) if f is not None and f.converged]
        got = iter(fits.losses(data, width, scored)) if scored else iter(())
        loss = {t: next(got) if f is not None and f.converged else None for t, f in zip(tries, fitted)}
        for f in folds:
            ok = [(loss[f, c], names.index(c)) for c in names if loss.get((f, c)) is not None]
            if ok:
                best = min(ok)
                chosen[f].append(names[best[1]])
                told.append((f, step + 1, names[best[1]], best[0]))
    keep.drop(data)
    return rows.sparkSession.createDataFrame(told, "fold string, step int, channel string, loss double")

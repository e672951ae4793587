"""Rank, calibration, loss and agreement statistics, and resampling that other engines can repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.expressions import log_loss, portable_hash
from tidegate.operators import ranks
from tidegate.sources.shared import written


def auroc(rows: DataFrame, by: list[str], y: str = "y", score: str = "p") -> DataFrame:
    """Per group, by average ranks of scores: equal scores are counted first, and ranks go over range partitions."""
    known = rows.filter(F.col(y).isNotNull() & F.col(score).isNotNull())
    ranked = ranks.tied(known, by, score, pos=F.sum(F.col(y).cast("long")))
    out = ranked.groupBy(*by).agg(F.sum("pos").alias("n1"), (F.sum("n") - F.sum("pos")).alias("n0"), F.sum(F.col("rank") * F.col("pos")).alias("s"))
    area = (F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))
    return out.select(*by, "n1", "n0", F.when((F.col("n1") > 0) & (F.col("n0") > 0), area).alias("auroc"))


def entity_loss(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean over entities of the mean over their assessable labels; entities without any don't count. rows: entity, y or null, p."""
    each = rows.filter(F.col("y").isNotNull()).withColumn("l", log_loss(F.col("y").cast("double"), F.col("p")))
    return each.groupBy(*by, "entity").agg(F.avg("l").alias("l")).groupBy(*by).agg(F.avg("l").alias("loss"), F.count("*").alias("n"))


def paired_delta(rows: DataFrame, site: str) -> DataFrame:
    """rows (entity, site, y, p_a, p_b): d = loss(b) - loss(a) per entity, then per site and over all (null site), and how many favour b."""
    y = F.col("y").cast("double")
    d = rows.filter("y IS NOT NULL").withColumn("d", log_loss(y, F.col("p_b")) - log_loss(y, F.col("p_a"))).groupBy(site, "entity").agg(F.avg("d").alias("d"))
    return d.rollup(site).agg(F.avg("d").alias("delta"), F.count("*").alias("n"), F.count(F.when(F.col("d") < 0, 1)).alias("better"))


def calibration(rows: DataFrame, by: list[str], bins: int) -> DataFrame:
    """Brier score, observed over expected and expected calibration error over equal-width bins."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    y = F.col("y").cast("double")
    cells = rows.filter("y IS NOT NULL").groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum("p").alias("sp"), F.sum((y - F.col("p")) ** 2).alias("se"))
    return cells.groupBy(*by).agg(
        F.sum("n").alias("n"),
        (F.sum("se") / F.sum("n")).alias("brier"),
        (F.sum("sy") / F.sum("sp")).alias("observed_expected"),
        (F.sum(F.abs(F.col("sy") - F.col("sp"))) / F.sum("n")).alias("ece"),
    )


def kappa(rows: DataFrame, by: list[str], a: str, b: str, weight: str | None = None) -> DataFrame:
    """Two raters' binary agreement: kappa, its prevalence-adjusted form, prevalence and bias index; weighted if asked."""
    w = F.col(weight) if weight else F.lit(1.0)
    cell = {f"n{i}{j}": F.coalesce(F.sum(F.when((F.col(a) == i) & (F.col(b) == j), w)), F.lit(0.0)) for i in (0, 1) for j in (0, 1)}
    t = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(*[v.alias(k) for k, v in cell.items()])
    n = F.expr("n00 + n01 + n10 + n11")
    po = F.expr("n00 + n11") / n
    pe = (F.expr("(n11 + n10) * (n11 + n01) + (n00 + n01) * (n00 + n10)")) / (n * n)
    return t.select(
        *by, n.alias("n"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"), (2 * po - 1).alias("pabak"), (F.expr("n11 - n00") / n).alias("prevalence"), (F.expr("n10 - n01") / n).alias("bias")
    )


def weighted_kappa(rows: DataFrame, a: str, b: str, levels: int, power: int) -> DataFrame:
    """Linear (power 1) or quadratic (2) kappa of ordinal ratings 0 to levels - 1."""
    cells = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    row, col = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    w = F.pow(F.abs(F.col("a") - F.col("b")) / (levels - 1), F.lit(power))
    seen = cells.agg(F.sum(w * F.col("n")).alias("seen"), F.sum("n").alias("total"))
    # marginals have at most as many rows as there are levels
    chance = row.crossJoin(F.broadcast(col)).agg(F.sum(w * F.col("ra") * F.col("cb")).alias("chance"))
    return seen.crossJoin(chance).select("total", (1 - F.col("seen") * F.col("total") / F.col("chance")).alias("kappa"))


def confusion(rows: DataFrame, by: list[str], y: str, guess: str) -> DataFrame:
    c = {k: F.count(F.when((F.col(y) == i) & (F.col(guess) == j), 1)) for k, i, j in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))}
    t = rows.groupBy(*by).agg(*[v.alias(k) for k, v in c.items()])
    rate = lambda n, d: F.expr(f"IF({d} > 0, {n} / ({d}), NULL)")
    return t.select("*", rate("tp", "tp + fn").alias("sensitivity"), rate("tn", "tn + fp").alias("specificity"), rate("tp", "tp + fp").alias("ppv"), rate("tn", "tn + fn").alias("npv"))


#: Resamples as in the reference, how many of them a task draws together, for how many of a site's slots, and hashes at a time.
REPLICATES = 2000
PIECE, SLOTS, TILE = 50, 1 << 14, 1 << 14
#: Rows whose values a task holds at a time, and replicates whose draws from them it holds.
BLOCK, SOME = 1 << 15, 500
MODES = ("within_site", "cluster", "two_stage")


def drawn_sites(rows: DataFrame, site: str, value: str, replicates: int, seed: int) -> DataFrame:
    """rep, pos, site, total, n: for each replicate as many sites as there are, with replacement. Sites are few; fewer than two are an error."""
    each = rows.groupBy(site).agg(F.sum(value).alias("total"), F.count("*").alias("n")).filter(F.col(site).isNotNull())
    k = F.count("*").over(Window.partitionBy())
    each = each.select("*", (F.row_number().over(Window.orderBy(site)) - 1).alias("number"), F.when(k < 2, F.raise_error(F.lit("this mode needs at least 2 sites")).cast("long")).otherwise(k).alias("k"))
    picks = each.select(F.col("number").alias("pos"), "k", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    pick = F.pmod(portable_hash(F.lit(str(seed)), F.col("rep").cast("string"), F.lit("site"), F.col("pos").cast("string")), F.col("k"))
    return picks.select("rep", "pos", pick.alias("number")).join(each.select(site, "total", "n", "number"), "number").select("rep", "pos", site, "total", "n")


def bootstrap_means(rows: DataFrame, site: str, value: str, replicates: int, seed: int, mode: str = "within_site") -> DataFrame:
    """rep, mean over resamples within sites: slot s of a site takes the row whose number is a hash of seed, rep, site and slot.

    ``cluster`` draws whole sites, ``two_stage`` draws sites and then slots within each, by the site's position too. Some slots of a site
    are drawn for some replicates at a time, and the draws packed by block of rows; a block's values meet what was drawn from it and
    give sums: a draw costs two bytes in the shuffle, and nothing is broadcast that grows with the rows.
    """
    assert mode in MODES, f"mode must be one of {MODES}"
    if mode == "cluster":
        return cluster_means(rows, site, value, replicates, seed)
    return slot_means(numbered_rows(rows, site, value), site, replicates, seed, mode)


def bootstrap_modes(rows: DataFrame, site: str, value: str, replicates: int, seed: int) -> dict[str, DataFrame]:
    """``bootstrap_means`` in each mode; the rows are made and numbered once, and what makes them (joins, broadcasts) isn't run again."""
    numbered = numbered_rows(rows, site, value)
    return {m: cluster_means(numbered, site, "v", replicates, seed) if m == "cluster" else slot_means(numbered, site, replicates, seed, m) for m in MODES}


def cluster_means(rows: DataFrame, site: str, value: str, replicates: int, seed: int) -> DataFrame:
    return drawn_sites(rows, site, value, replicates, seed).groupBy("rep").agg((F.sum("total") / F.sum("n")).alias("mean"))


def numbered_rows(rows: DataFrame, site: str, value: str) -> DataFrame:
    """site, v, row: its number within the site by entity, from 0; rows of an unknown site are left out."""
    placed = ranks.ranked(rows.filter(F.col(site).isNotNull()).select(site, "entity", F.col(value).cast("double").alias("v")), [site], ["entity"])
    return written(placed.select(site, "v", (F.col("_rank") - 1).alias("row")), "numbered")


def slot_means(numbered: DataFrame, site: str, replicates: int, seed: int, mode: str) -> DataFrame:
    """``bootstrap_means`` of numbered rows, for the modes that draw slots."""
    upto = lambda n: F.sequence(F.lit(0), n)
    chunks = numbered.groupBy(site).agg(F.count("*").alias("n")).select(site, "n", F.explode(upto(F.floor((F.col("n") - 1) / SLOTS).cast("int"))).alias("chunk"))
    chunks = chunks.select("*", F.explode(upto(F.lit((replicates - 1) // PIECE))).alias("piece"))
    if mode == "two_stage":
        sites = drawn_sites(numbered, site, "v", replicates, seed).groupBy(site, F.floor(F.col("rep") / PIECE).cast("int").alias("piece"))
        chunks = chunks.join(sites.agg(F.collect_list("rep").alias("reps"), F.collect_list("pos").alias("pos")), [site, "piece"])
    else:
        reps = F.sequence(F.col("piece") * PIECE, F.least(F.col("piece") * PIECE + PIECE, F.lit(replicates)) - 1)
        chunks = chunks.select("*", reps.alias("reps"), F.lit(None).cast("array<int>").alias("pos"))
    dealt = chunks.repartition(int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")), site, "chunk", "piece")
    named = dealt.select(F.col(site).alias("site"), F.col(site).cast("string").alias("name"), "n", "chunk", "piece", "reps", "pos")
    kind = numbered.schema[site].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("site")
            for i, r in enumerate(batch.drop_columns(["site"]).to_pylist()):
                slots = range(r["chunk"] * SLOTS, min(r["n"], (r["chunk"] + 1) * SLOTS))
                blocks, counts, offsets = packed_draws(seed, r["name"], r["n"], slots, r["reps"], r["pos"])
                k = len(blocks)
                lists = lambda x: pa.array(x, pa.list_(pa.int32()))
                columns = [of.take(pa.array([i] * k, pa.int32())), pa.array(blocks, pa.int64()), pa.array([r["piece"] * PIECE // SOME] * k, pa.int32()), lists([r["reps"]] * k), lists(counts), pa.array(offsets, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["site", "block", "some", "reps", "counts", "offsets"])

    def added(drawn: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if drawn.empty:
            return pd.DataFrame({"rep": [], "s": [], "n": []})
        values, there = np.zeros(BLOCK), np.zeros(BLOCK)
        isnull = known["null"].to_numpy(bool)
        values[known["at"]], there[known["at"]] = np.where(isnull, 0.0, known["v"].to_numpy(float)), ~isnull
        first = int(drawn["some"].iloc[0]) * SOME
        sums, n = np.zeros(SOME), np.zeros(SOME)
        for reps, counts, offsets in zip(drawn["reps"], drawn["counts"], drawn["offsets"]):
            rep, at = np.repeat(reps, counts) - first, np.frombuffer(offsets, np.uint16)
            sums += np.bincount(rep, values[at], SOME)
            n += np.bincount(rep, there[at], SOME)
        taken = np.unique(np.concatenate(list(drawn["reps"])))
        return pd.DataFrame({"rep": taken, "s": sums[taken - first], "n": n[taken - first]})

    draws = named.mapInArrow(packed, f"site {kind}, block bigint, some int, reps array<int>, counts array<int>, offsets binary")
    parts = upto(F.lit((replicates - 1) // SOME))
    values = numbered.select(F.col(site).alias("site"), F.floor(F.col("row") / BLOCK).alias("block"), (F.col("row") % BLOCK).cast("int").alias("at"), F.coalesce("v", F.lit(0.0)).alias("v"), F.col("v").isNull().alias("null"), F.explode(parts).alias("some"))
    keys = ["site", "block", "some"]
    sums = draws.groupBy(*keys).cogroup(values.groupBy(*keys)).applyInPandas(added, "rep int, s double, n double")
    return sums.groupBy("rep").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))


def packed_draws(seed: int, name: str, n: int, slots: range, reps: list[int], pos: list[int] | None) -> tuple[list, list, list]:
    """Of some slots' draws from n rows in some replicates: the blocks of rows drawn from, counts for each replicate, and places in the block."""
    heads = [f"{seed}|{r}|{name}|" if p is None else f"{seed}|{r}|{p}|{name}|" for r, p in zip(reps, pos or [None] * len(reps))]
    heads = [h.encode() for h in heads]
    found = []
    for d in range(len(str(slots.start)), len(str(slots.stop - 1)) + 1):
        some = np.arange(max(slots.start, 10 ** (d - 1) if d > 1 else 0), min(slots.stop, 10**d))
        digits = some[:, None] // 10 ** np.arange(d - 1, -1, -1) % 10 + 48
        for p in {len(h) for h in heads}:
            own = np.array([i for i, h in enumerate(heads) if len(h) == p])
            step = max(1, TILE // len(some))
            for at in range(0, len(own), step):
                tile = own[at : at + step]
                row = md5_numbers(np.array([list(heads[i]) for i in tile]), digits).astype(np.int64) % n
                found.append((((row // BLOCK) * len(heads) + tile[:, None]) * BLOCK + row % BLOCK).ravel())
    # by block, replicate and place in one number
    every = np.sort(np.concatenate(found))
    of = every // BLOCK
    start = np.flatnonzero(np.r_[True, of[1:] // len(heads) != of[:-1] // len(heads)])
    counts, offsets = [], []
    for i, j in zip(start, [*start[1:], len(every)]):
        counts.append(np.bincount(of[i:j] % len(heads), minlength=len(heads)).astype(np.int32))
        offsets.append((every[i:j] % BLOCK).astype(np.uint16).tobytes())
    return list(of[start] // len(heads)), counts, offsets


MD5_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
MD5_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)


def md5_numbers(heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """``portable_hash`` of each head with each tail, both rows of byte codes: MD5 over many texts at a time."""
    heads, tails = heads.astype(np.uint32), tails.astype(np.uint32)
    p, size = heads.shape[1], heads.shape[1] + tails.shape[1]
    end = (size + 8) // 64 * 64 + 64
    one = lambda x: np.full((1, 1), x, np.uint32)
    code = lambda j: heads[:, j, None] if j < p else tails[None, :, j - p] if j < size else one(0x80 if j == size else size * 8 >> 8 * (j - end + 8) & 255 if j >= end - 8 else 0)
    state = [one(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    for block in range(0, end, 64):
        words = [code(j) | code(j + 1) << 8 | code(j + 2) << 16 | code(j + 3) << 24 for j in range(block, block + 64, 4)]
        a, b, c, d = state
        for i, turn in enumerate(MD5_TURNS):
            if i < 16:
                f, w = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, w = c ^ (d & (b ^ c)), 5 * i + 1
            elif i < 48:
                f, w = b ^ c ^ d, 3 * i + 5
            else:
                f, w = c ^ (b | ~d), 7 * i
            f = f + a + (words[w % 16] + MD5_SINES[i])
            a, d, c, b = d, c, b, b + (f << turn | f >> (32 - turn))
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    return np.broadcast_to(state[0], (len(heads), len(tails))).byteswap()


def percentile_interval(means: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Interval of resampled means, and the one-sided p that they lie below zero."""
    return means.agg(
        F.percentile("mean", F.lit(alpha / 2)).alias("low"),
        F.percentile("mean", F.lit(1 - alpha / 2)).alias("high"),
        ((F.count(F.when(F.col("mean") >= 0, 1)) + 1) / (F.count("*") + 1)).alias("p"),
    )


def holm(tests: DataFrame, name: str = "name", p: str = "p") -> DataFrame:
    """Adjusted p of a family of tests, which is a handful of rows."""
    order = Window.orderBy(p, name)
    stepped = tests.withColumn("_s", (F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1) * F.col(p))
    return stepped.select(name, p, F.least(F.lit(1.0), F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("adjusted"))

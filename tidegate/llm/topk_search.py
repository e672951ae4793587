"""Exact top-k inner products: tiled matrix products of queries and shards, selection per tile, tree merging of top lists.

Queries and candidates are dealt by the hash of their rows into tiles of bounded size; each pair of a query tile and a shard is one
group, whose scores are a few matrix products in blocks. A tile keeps k candidates of each query, with ties by id; lists of 16
shards are merged at a time until one is left. Every query meets every shard: that is the stated set of queries against all rows.

Vectors that are null or hold a null or non-finite component take no part. Shorter vectors count as filled up with zeros. Rows that
share an id are rows of their own, equal or not: each is a query if its id is, and a candidate for all queries but itself. A null id
takes no part. Equal scores go to the smaller id. Scores are exact: floats multiply them only where every sum stays below 2**53. Other
columns are ignored; an empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import written

#: Rows of a query tile and of a shard, on average.
QUERIES, SHARD = 8_192, 4_096
#: Queries and candidates of one matrix product.
BLOCK_Q, BLOCK_C = 256, 4_096
FAN_IN = 16


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """row, vec_id, q: floor(scale * x) of each component as a double, and a number of the row, to be written before it is used twice."""
    good = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = named.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(good, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("q"))


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def tile_top(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """query, query_id, vec_id, score: each query's k best of these candidates, without its own row."""
    columns = ["query", "query_id", "vec_id", "score"]
    if queries.empty or candidates.empty:
        return pd.DataFrame({c: pd.Series([], dtype="int64") for c in columns})
    candidates = candidates.sort_values("vec_id")
    width = max(max(map(len, queries["q"])), max(map(len, candidates["q"])))
    q, c = matrix(queries["q"], width), matrix(candidates["q"], width)
    bound = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(width, 1)
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
    q, c = q.astype(kind), c.astype(kind)
    qid, qrow, cid, crow = (x.to_numpy() for x in (queries["vec_id"], queries["row"], candidates["vec_id"], candidates["row"]))
    out = []
    for i in range(0, len(q), BLOCK_Q):
        best_s, best_v = [[] for _ in qid[i : i + BLOCK_Q]], [[] for _ in qid[i : i + BLOCK_Q]]
        for j in range(0, len(c), BLOCK_C):
            s, ids, rows = q[i : i + BLOCK_Q] @ c[j : j + BLOCK_C].T, cid[j : j + BLOCK_C], crow[j : j + BLOCK_C]
            take = min(k + 1, s.shape[1])
            if kind is object:
                floor = np.sort(s, 1)[:, -take]
            else:
                floor = np.partition(s, -take, axis=1)[:, -take]
            for r, (row, least) in enumerate(zip(s, floor)):
                at = np.flatnonzero(row >= least)
                at = at[np.argsort(-row[at], kind="stable")]
                at = at[rows[at] != qrow[i + r]][:k]
                best_s[r] += row[at].tolist()
                best_v[r] += ids[at].tolist()
        for number, own, ss, vs in zip(qrow[i : i + BLOCK_Q].tolist(), qid[i : i + BLOCK_Q].tolist(), best_s, best_v):
            out += [(number, own, v, -s) for s, v in sorted((-int(s), v) for s, v in zip(ss, vs))[:k]]
    return pd.DataFrame(out, columns=columns)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id, score. is_query: a condition on vec_id."""
    rows = written(quantised(vectors, id_col, vector_col), "vectors")
    n, m = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    tiles, shards = -(-m // QUERIES) or 1, -(-n // SHARD) or 1
    queries = rows.filter(is_query).withColumn("tile", F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int"))
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    shard = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards)).cast("int")
    candidates = rows.select(F.col("row").alias("cand_row"), F.col("vec_id").alias("cand_id"), F.col("q").alias("cand_q"), shard.alias("cand_shard"))
    candidates = candidates.withColumn("cand_tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))

    def tile(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = tile_top(a, b.rename(columns={"cand_row": "row", "cand_id": "vec_id", "cand_q": "q"}), k)
        out["shard"] = key[1]
        return out

    lists = queries.groupBy("tile", "shard").cogroup(candidates.groupBy("cand_tile", "cand_shard")).applyInPandas(tile, "query long, query_id long, vec_id long, score long, shard int")
    while True:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        order = Window.partitionBy("query", "shard").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")

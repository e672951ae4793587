"""The prefix trie against plain dictionaries of prefixes, and against its SQL."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidegate.llm import prefix_trie
from tidegate.llm import queries as text_queries
from tests.test_queries import duck, rows  # noqa: F401  fixture

DATA = "/root/testdata/sf0.001"
TURN = "conv_id long, turn long, role string, text string, base string, node string, depth string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(turns, fork=True):
    own = {}
    for c, t, r, x in turns:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    share = {c: zlib.crc32(str(c).encode()) % 9 if fork else 0 for c in own}
    whole = {c: tuple((own.get(c - c % 5, []) if fork else [])[: share[c]] + v[share[c] :]) for c, v in own.items()}
    members = {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in below)
        leaves = sum(not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in members) for q in below)
        ends = ",".join(str(c) for c in sorted(c for c in cs if whole[c] == p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), parent, len(cs), sum(len(q) == len(p) + 1 for q in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def frame(spark, turns):
    return spark.createDataFrame([(*t, "clash", "clash", "clash") for t in turns], TURN)


def forked(spark, df):
    c = F.col("conv_id")
    return prefix_trie.trie(prefix_trie.sequences(df, c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9, 8))


def told(df):
    return sorted(str(tuple(r)) for r in df.select(*NAMES).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_equals_plain_prefixes(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS", 3)
    rng, turns = random.Random(seed), []
    for c in rng.sample(range(400), 120):
        n = rng.choice([0, 1, 2, 3, 5, 8, 12])
        turns += [(c, rng.choice([None, i, i // 2]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "bb", "", None])) for i in range(n)]
    turns += [(c, i, "user", "same") for c in range(1000, 1060) for i in range(1 + c % 3)]  # few sequences of many conversations
    turns += [(None, 1, "user", "no id"), (77777, 1, "user", "long " * 50_000)]
    df = frame(spark, turns).repartition(5)
    assert told(forked(spark, df)) == plain(turns)
    assert told(prefix_trie.trie(prefix_trie.sequences(df))) == plain(turns, fork=False)


def test_turnless_alone_repeated_and_empty(spark):
    # 3 has no base, and its own turns are fewer than it would share
    assert zlib.crc32(b"3") % 9 > 1
    for turns in ([(3, 1, "user", "x")], [(7, None, None, None)] * 40, [(5, 1, "u", "a|b"), (6, 1, "u", "a|b"), (6, 1, "u|a", "b")]):
        assert told(forked(spark, frame(spark, turns))) == plain(turns)
    assert forked(spark, frame(spark, [])).count() == 0
    got = prefix_trie.trie(prefix_trie.sequences(frame(spark, [(1, 1, "a", "bc"), (2, 1, "ab", "c")]))).filter("depth = 1")
    assert got.count() == 2  # roles and texts don't run together


def test_registered_query(spark, duck):  # noqa: F811
    got = text_queries.queries()["op11_prefix_trie"](spark, DATA).toPandas()
    turns = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(str(tuple(None if v != v else v if isinstance(v, str) else int(v) for v in r)) for r in got[NAMES].itertuples(index=False)) == plain(turns)
    assert rows(got) == rows(duck.execute(text_queries.oracle_sql()["op11_prefix_trie"]).df())

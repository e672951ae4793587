"""Each operator against a plain version, an exact round trip or held-out labels, and on odd rows."""

import base64
import gzip
import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegate.llm import bpe, chat_format, mixing, ngram_join, quality_rules, token_counts, token_output, topk_search, toxicity, warc
from tidegate.llm import queries as text_queries

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, spaces only, repeated, very long, and columns whose names clash with results."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (6, long), (7, long + " tail"), (8, "é" * 3000), (8, "é" * 3000), (9, "Σας <|endoftext|> x\x1cy")]
    return spark.createDataFrame([(i, t, "en", None if i == 4 else f"s{i % 2}", len(t or ""), "clash", "clash") for i, t in rows], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_token_counts(spark, docs, odd):
    known = token_counts.load("byte_bpe_50k.tiktoken")
    for part in (docs, odd):
        hist = token_counts.histogram(token_counts.lengths(part))
        want = sorted(len(known.encoding.encode_ordinary(r["text"] or "")) for r in part.collect())
        got = {r["n_tokens"]: r for r in hist.collect()}
        assert {k: r["n_docs"] for k, r in got.items()} == Counter(want)
        for k, r in got.items():
            assert r["tokens_at_least"] == sum(x for x in want if x >= k) and r["docs_at_most"] == sum(x <= k for x in want)
            assert r["truncated_tokens"] == sum(min(x, k) for x in want)
        for limit in (0, 1, 100, 777, 10**7):
            assert token_counts.truncated_total(hist, limit) == sum(min(x, limit) for x in want)
        assert token_counts.quantile(hist, 0.5) == want[-(-len(want) // 2) - 1]
    assert token_counts.histogram(token_counts.lengths(empty(spark))).count() == 0


def test_segments_equal_whole_texts():
    known, rng = token_counts.load("byte_bpe_50k.tiktoken"), random.Random(1)
    texts = ["".join(rng.choice(["a", "b's", " ", "  ", "\n", "\t", "1", ".", "é", " x", " "]) for _ in range(rng.randrange(0, 30))) for _ in range(600)]
    for part in (texts, texts[:1], [""], ["x "], [" "], ["a b", "a b "]):
        whole = [known.ids(t) for t in part]
        assert list(known.encoded(pa.array(part, pa.large_string()))) == whole
        assert known.lengths(pa.array(part, pa.large_string())).tolist() == [len(x) // 2 for x in whole]


def test_toxicity_on_held_out_rows(spark, odd):
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(5)
    rows = []
    for i in range(600):
        t = [rng.choice(words) for _ in range(rng.randrange(20, 300))]
        if i % 3 == 0:
            t[rng.randrange(len(t))] = rng.choice(["idiot,", "moron", "scum."])
        rows.append((i, " ".join(t), int(i % 3 == 0)))
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    y = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    net = toxicity.fit(d, y)
    got = toxicity.scored(d, net).withColumn("held", toxicity.held_out()).collect()
    assert {r["doc_id"] for r in got if r["held"]} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [r["predicted"] == int(r["doc_id"] % 3 == 0) for r in got if r["held"]]
    assert np.mean(right) > 0.9
    again = toxicity.scored(odd, net).collect()
    assert all(0 <= r["score"] <= 1 for r in again) and [r["score"] for r in again][:3] == [0.0] * 3
    assert toxicity.fit(d, y.filter("toxic = 1")) is None
    assert toxicity.scored(empty(spark), net).count() == 0


def plain_score(net, text):
    """One window at a time, one word after the other."""
    p, s = net.p, toxicity.SIZE
    words = (text or "").encode().lower().split()
    if not words:
        return 0.0
    n, worst = len(words), -np.inf
    for first in sorted({min(k, max(n - 64, 0)) for k in range(0, max(n - 16, 1), 48)}):
        inputs = []
        for w in words[first : first + 64]:
            bare = w.strip(toxicity.STRIP)
            x = b"^" + bare + b"$$"
            code = [(((x[i] * 31 + x[i + 1]) * 31 + x[i + 2]) * 2654435761 >> 7) % toxicity.TRIPLES for i in range(len(x) - 2)]
            inputs.append(np.concatenate([p["words"][net.words.get(bare, 0)], p["chars"][code].mean(0)]) @ p["x"] + p["b"])
        states = []
        for d, order in ((0, range(len(inputs))), (1, range(len(inputs) - 1, -1, -1))):
            h, told = np.zeros(s), {}
            for t in order:
                x, g = inputs[t][3 * s * d : 3 * s * (d + 1)], h @ p["h"][d]
                z, r = 1 / (1 + np.exp(-(x[:s] + g[:s]))), 1 / (1 + np.exp(-(x[s : 2 * s] + g[s : 2 * s])))
                h = z * h + (1 - z) * np.tanh(x[2 * s :] + r * g[2 * s :])
                told[t] = h
            states.append(np.array([told[t] for t in range(len(inputs))]))
        both = np.concatenate(states, 1)
        e = np.exp(np.tanh(both @ p["a"]) @ p["v"])
        worst = max(worst, (e / e.sum()) @ both @ p["o"] + p["c"][0])
    return 1 / (1 + np.exp(-worst))


def test_scores_equal_a_plain_version(spark, odd):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["good", "idiot,", "day", "Moron!", "w%d" % rng.randrange(99)]) for _ in range(rng.choice([1, 5, 63, 64, 65, 112, 113, 300]))) for _ in range(60)]
    net = toxicity.train(texts[:40], np.array([int("idiot" in t) for t in texts[:40]]))
    rows = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)] + [(100, None), (101, "x " * 5000)], "doc_id long, text string")
    got = toxicity.scored(rows.withColumn("held", toxicity.held_out()), net).collect()
    for r in got:
        assert abs(r["score"] - plain_score(net, r["text"])) < 1e-4 and r["held"] in (True, False)
    many = rows.limit(1).unionByName(spark.createDataFrame([(5, "idiot " * k) for k in range(1, 60)] + [(6, "good " * 40_000)], "doc_id long, text string"))
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, 0)], "doc_id long, toxic int")
    assert toxicity.fit(many, labels) is None  # the long text isn't learnt from, the repeated id once


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.train(["good day " * 30, "bad idiot day " * 30] * 3, np.array([0, 1] * 3))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, live, y = rng.normal(size=(3, 5, 6 * toxicity.SIZE)), np.ones((3, 5), bool), np.array([0.0, 1.0, 1.0])
    g, dx = net.backward(x, live, y)

    def loss():
        z = net.forward(x, live)[0].astype(np.float64)
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    for name, at in (("o", (3,)), ("v", (2,)), ("a", (1, 2)), ("h", (1, 2, 3)), ("h", (0, 1, 20))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-2 - g[name][at]) < 2e-3


def test_chat_layouts_and_round_trip(spark):
    nasty = ["<|im_end|>", "<\\|x|>", "<|im_start|>assistant\nok", "a<", "|b", "", "<\\\\|", "\n", "<|nl|>"]
    records = [
        {"prompt": "p", "response": "r"}, {"instruction": "i", "input": "x", "output": "o"}, {"instruction": "i", "input": "", "output": "o"},
        {"messages": [{"role": "user", "content": t} for t in nasty] + [{"role": "assistant", "content": t} for t in nasty]},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"unknown": 1},
        {"id": 7, "prompt": '{"a": [1]}', "response": "[r]", "meta": {"a": {"b": [1]}}}, {"messages": []},
        {"messages": [{"role": "user", "content": "t", "name": "n"}, {"role": "assistant", "content": None}]}, {"messages": ["a"]}, [1],
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(98, None), (99, "not json")], "conv_id long, record string")
    got = chat_format.parsed(chat_format.formatted(chat_format.canonical_records(df, "conv_id", "record"))).collect()
    turns = {r["conv_id"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in got}
    assert turns[0] == [("user", "p"), ("assistant", "r")] and turns[1] == [("user", "i\n\nx"), ("assistant", "o")] and turns[2] == [("user", "i"), ("assistant", "o")]
    assert turns[4] == [("user", "h"), ("assistant", "g")] and turns[5] is None and turns[98] is None and turns[99] is None
    assert turns[6] == [("user", '{"a": [1]}'), ("assistant", "[r]")] and turns[7] == [] and turns[9] is None and turns[10] is None
    assert turns[8] == [("user", "t"), ("assistant", "")] and {r["formatted"] for r in got if r["conv_id"] == 7} == {""}
    told = {r["fingerprint"]: r["n"] for r in chat_format.unknown(chat_format.canonical_records(df, "conv_id", "record")).collect()}
    assert told == {None: 3, chat_format.path_hash({".unknown"}): 1, chat_format.path_hash({".messages[]*"}): 1}
    for i, x in enumerate(records[:-1]):
        assert next(r["fingerprint"] for r in got if r["conv_id"] == i) == chat_format.path_hash(chat_format.example_paths(x))
    for r in got:
        if r["turns"] is not None:
            assert r["read_turns"] == r["turns"]
            assert r["read_loss"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
    rows = spark.createDataFrame([(1, 2, "b", None), (1, 1, "odd\nrole<|x", "t"), (None, None, None, "z")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.parsed(chat_format.formatted(chat_format.canonical_rows(rows.withColumn("turns", F.lit(1))))).collect()}
    assert [tuple(t) for t in got[1]["read_turns"]] == [("odd\nrole<|x", "t"), ("b", "")] and got[None]["read_turns"][0]["text"] == "z"
    assert chat_format.formatted(chat_format.canonical_rows(rows.limit(0))).count() == 0
    long = spark.createDataFrame([(1, 1, "user", "x<|" * 100_000), (1, 1, "user", "x<|" * 100_000)], "conv_id long, turn long, role string, text string")
    (r,) = chat_format.parsed(chat_format.formatted(chat_format.canonical_rows(long))).collect()
    assert [t["text"] for t in r["read_turns"]] == ["x<|" * 100_000] * 2
    with pytest.raises(ValueError, match="no row layout"):
        chat_format.canonical_rows(long.drop("role"))


def test_chat_layouts_that_would_lose_texts_are_unknown(spark):
    message = {"role": "user", "content": "t"}
    odd = [
        {"prompt": "p", "response": "r", "completion": "c"},
        {"messages": [message, {"from": "human", "value": "lost"}]},
        {"messages": [message, "text"]},
        {"messages": [message, {"role": "user"}]},
        {"messages": [message], "system": "s"},
        {"conversations": [{"from": "human", "value": "h"}], "prompt": "p", "response": "r"},
        {"instruction": "i", "output": "o", "answer": "a"},
    ]
    fine = [{"messages": [message, {"role": "x", "content": "y", "value": "z"}]}, {"messages": [{"role": None, "content": None}]}, {"system": "s", "prompt": "p", "response": "r", "more": {"a": 1}}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(odd + fine)], "conv_id long, record string")
    done = chat_format.canonical_records(df, "conv_id", "record")
    turns = {r["conv_id"]: r["turns"] for r in done.collect()}
    assert all(turns[i] is None for i in range(len(odd))) and [len(turns[len(odd) + i]) for i in range(3)] == [2, 1, 3]
    assert sum(r["n"] for r in chat_format.unknown(done).collect()) == len(odd)
    with pytest.raises(ValueError, match="no row layout"):  # which column holds the text can't be told
        chat_format.canonical_rows(spark.createDataFrame([], "conv_id long, turn long, role string, text string, content string"))


def plain_groups(rows):
    """Class of each id, by comparing all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    seen = set()
    for members in where.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    k = len(sets[a] & sets[b])
                    if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                        x, y = sorted((find(a), find(b)))
                        top[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, n=400):
    """Families of copies with ever more words changed, one large one, and one passage in many texts."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(3000)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    passage, big, rows = text(50), text(120), []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            t = big[:]
            for _ in range(rng.randrange(0, 7)):
                t[rng.randrange(len(t))] = rng.choice(words)
        elif kind == 1:
            t = text(rng.randrange(5, 30)) + passage + text(rng.randrange(0, 9))
        elif kind == 2 and len(rows) > 8:
            t = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
        else:
            t = text(rng.randrange(1, 90))
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_equals_all_pairs(spark, seed):
    rows = near_copies(seed) + [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "É x"), (1005, "é x")]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = plain_groups(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_ngram_join_odd_rows(spark, odd):
    extra = odd.unionByName(spark.createDataFrame([(None, "one two", "en", "s", 7, "", "")], DOC))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(extra).collect()]
    assert len(got) == 11 and (4, 1, 4) in got and (5, 1, 4) in got and (1, 0, 1) in got and (7, 978, 6) in got
    assert [x for x in got if x[0] == 8] == [(8, 1, 8)] * 2
    kept = ngram_join.first_of_groups(extra)
    assert kept.columns == extra.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 8, 9]
    assert ngram_join.near_duplicates(empty(spark)).count() == 0


def test_mixing_targets_and_caps(spark, docs, odd):
    for part in (docs, odd):
        rows = mixing.mixed(part).select("doc_id", "source", "size", "source_size", "target", "draws").collect()
        size, taken, target = Counter(), Counter(), {}
        for r in rows:
            words = sum(d["words"] for d in r["draws"])
            assert words <= 3 * r["size"] and all(d["shard"] is not None for d in r["draws"])
            size[r["source"]] += r["size"]
            taken[r["source"]] += words
            target[r["source"]] = r["target"]
        order = sorted(size, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        free, left, want = set(order), sum(size.values()), {}
        while free:
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = [s for s in free if share[s] > 3 * size[s]]
            want |= {s: 3.0 * size[s] for s in over} if over else share
            left -= sum(3 * size[s] for s in over)
            free = free - set(over) if over else set()
        for s in order:
            assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - want[s]) <= 1
    assert sorted(map(str, mixing.mixed(docs).collect())) == sorted(map(str, mixing.mixed(docs.repartition(7)).collect()))
    clash = odd.select("*", *[F.lit(1).alias(c) for c in ("draws", "_id", "size", "row", "block", "shard", "pass", "key", "mark")])
    assert sorted(map(str, mixing.mixed_documents(clash).drop(*clash.columns[7:]).collect())) == sorted(map(str, mixing.mixed_documents(odd).collect()))
    assert mixing.mixed(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).columns == DOC_COLUMNS


DOC_COLUMNS = [c.split(" ")[0] for c in DOC.split(", ")]


def test_mixing_targets_of_tied_sources(spark):
    for sizes, weights, want in (
        ([100] * 4, (5, 2, 1), [400 * w / 13 for w in (5, 2, 1, 5)]),
        ([50, 20, 10], (5, 2, 1), [50, 20, 10]),
        ([10, 10, 1000], (1, 1, 1000), [1020 / 1002, 1020 / 1002, 1020 * 1000 / 1002]),
        ([100] * 4, (1,), [100] * 4),
    ):
        by_source = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(by_source, weights).collect()}
        assert all(abs(got[f"s{i}"] - x) < 1e-6 for i, x in enumerate(want))


def test_mixing_keeps_texts_whole(spark, docs):
    came = {r["doc_id"]: r for r in docs.collect()}
    size, target, longest, taken, got = {}, {}, Counter(), Counter(), Counter()
    for r in mixing.mixed(docs).collect():
        size[r["doc_id"]], target[r["source"]] = r["size"], r["target"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for r in mixing.mixed_documents(docs).collect():
        assert r == came[r["doc_id"]]
        taken[r["source"]] += size[r["doc_id"]]
        got[r["doc_id"]] += 1
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in target)
    drawn = mixing.draws_of(docs).collect()
    assert Counter(r["doc_id"] for r in drawn) == got and all(r["words"] == size[r["doc_id"]] for r in drawn)
    told = text_queries.op5_mixing(spark, DATA).collect()
    assert all(r["taken"] == got[r["doc_id"]] * r["size"] for r in told)


def test_mixing_counts_repeated_rows_by_themselves(spark):
    rng = random.Random(8)
    rows = [(i % 7, "w " * 50, "en", f"s{i % 4}", 0, "", "") for i in range(300)] + [(i, "w " * rng.randrange(1, 90), "en", f"s{i % 4}", 0, "", "") for i in range(40)]
    docs = spark.createDataFrame(rows, DOC)
    target, taken = {}, Counter()
    for r in mixing.mixed(docs).collect():
        target[r["source"]] = r["target"]
    for r in mixing.mixed_documents(docs).collect():
        taken[r["source"]] += len(r["text"].split())
    assert all(abs(taken[s] - target[s]) <= 46 for s in target)


def test_mixing_takes_what_the_tree_deals(spark, docs, monkeypatch):
    """Each shard's rows stand together, shuffled; without the tree's runs nothing is taken."""
    drawn = mixing.draws_of(docs, shards=4).withColumn("at", F.spark_partition_id()).collect()
    assert {r["shard"] for r in drawn} == {r["at"] for r in drawn} == set(range(4))
    for k in range(4):
        places = [r["place"] for r in drawn if r["at"] == k]
        assert places == sorted(places) and len(places) > 10
    tree = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, n, seed=0: tree(q, n, seed).filter("shard = 1"))
    assert mixing.draws_of(docs, shards=4).count() == sum(r["shard"] == 1 for r in drawn)


def test_splitting_tree_is_exact(spark):
    q = {"a": 1000, "b": 1, "c": 77, None: 250}
    got = mixing.splitting_tree(spark.createDataFrame(list(q.items()), "source string, blocks long"), 8, 3).collect()
    for s, n in q.items():
        runs = sorted((r["first"], r["blocks"]) for r in got if r["source"] == s)
        assert sum(b for _, b in runs) == n and all(x[0] + x[1] == y[0] for x, y in zip(runs, runs[1:]))
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["blocks"]
    assert max(sizes.values()) - min(sizes.values()) <= 1
    # of 6 and 4 blocks, 5 go left: the first source's share is hypergeometric
    nodes = spark.range(400).selectExpr("int(id) AS shard", "array(named_struct('source', 'a', 'blocks', 6L), named_struct('source', 'b', 'blocks', 4L)) AS q")
    start = F.struct(F.lit(5).cast("long").alias("room"), F.lit(10).cast("long").alias("rest"), F.array().cast("array<bigint>").alias("left"))
    drawn = nodes.select(F.aggregate("q", start, mixing.left_draw(0, 1), lambda a: a["left"]).alias("left")).collect()
    assert all(sum(r["left"]) == 5 for r in drawn)
    seen = Counter(r["left"][0] for r in drawn)
    want = {k: 400 * math.comb(6, k) * math.comb(4, 5 - k) / math.comb(10, 5) for k in range(1, 6)}
    assert set(seen) <= set(want) and sum((seen[k] - x) ** 2 / x for k, x in want.items()) < 18.5


def test_top_k(spark):
    rng = np.random.default_rng(2)
    v = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 340)]
    v += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, [9.0]), (405, []), (50, [0.1] * 6), (None, [1.0])]
    got = topk_search.top_k(spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")), F.col("vec_id") % 50 == 0, 5).collect()
    q = [(i, [int(np.floor(256 * c)) for c in x]) for i, x in v if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    want = Counter()
    for a, (i, x) in enumerate(q):
        if i % 50 == 0:
            s = sorted((-sum(c * d for c, d in zip(x, y)), j) for b, (j, y) in enumerate(q) if b != a)[:5]
            want.update((i, r + 1, j, -z) for r, (z, j) in enumerate(s))
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    same = spark.createDataFrame([(7, [1.0]), (7, [2.0]), (50, [1.0]), (50, [3.0]), (50, [3.0])], "vec_id long, embedding array<double>")
    got = topk_search.top_k(same, F.col("vec_id") % 50 == 0, 5).collect()
    assert len(got) == 12 and Counter(r["vec_id"] for r in got) == {7: 6, 50: 6}
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_bpe_equals_the_library(spark, odd, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary("word_bpe_49k.json"))
    b, rng = bpe.load("word_bpe_49k.json"), random.Random(9)
    texts = ["", " ", "x" * 5000, "İstanbul ΣΑΣ", "a\x1cb\x85c", "<|startoftext|>A<|endoftext|>", "it's 123!!??", "日本語 😀", "ing" * 900 + "ation" * 700]
    texts += ["".join(rng.choice("aeinorst") for _ in range(4000)) for _ in range(4)] + [r["text"] for r in docs.limit(60).collect()]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert b.encode(t).tolist() == ids and "".join(b.decode_tokens(np.array(ids, "<u4"))) == lib.decode(ids, skip_special_tokens=False)
    for t, ids in zip(texts, b.encode_many(pa.array(texts, pa.large_string()))):
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids
    for part in (odd, docs):
        got = {r["doc_id"]: r for r in bpe.encode_documents(part).collect()}
        for r in part.collect():
            ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
            g = got[r["doc_id"]]
            assert g["n_tokens"] == len(ids) and g["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert g["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "Hello, wörld 😀 <|endoftext|>")], "doc_id long, text string")
    assert bpe.decode_ids(bpe.encode_ids(one)).first()["text"] == "hello , wörld 😀 <|endoftext|>"


def test_bpe_runs_every_word_through_windows(monkeypatch):
    b = bpe.load("word_bpe_49k.json")
    rng = random.Random(6)
    words = ["a", "sorting", "é" * 40] + ["".join(rng.choice("aeinorst") for _ in range(n)) for n in (63, 64, 65, 681, 682, 683, 700, 1500, 5000)]
    want = [np.array(list(b.transduce(b.symbols(w))), "<u4").tobytes() for w in words]
    assert b.transduce_many(words) == want and b.transduce_many([]) == []
    before = b.encode("some sorting words").tolist()
    monkeypatch.setattr(b, "emitted", lambda ids, n, final: (ids, np.arange(ids.shape[1]) < n[:, None], n))
    b.known.clear()
    assert b.encode("some sorting words").tolist() != before
    b.known.clear()


def test_bpe_streams_with_bounded_memory():
    b = bpe.load("word_bpe_49k.json")
    word = [b.inner[x] for x in (b"abcing" * 700)[:4_000]]
    ids, n = b.merge(np.array([[*word, -1]]), np.array([len(word)]))
    assert list(b.transduce(iter(word))) == ids[0, : n[0]].tolist()
    fed, out = 0, b.transduce(b.inner[97] for _ in iter(int, 1))
    for fed, _ in zip(range(50), out):
        pass
    assert fed == 49 and bpe.sufficient_lookahead([("a", "b"), ("ab", "c")]) == 1 and bpe.sufficient_lookahead([("b", "c"), ("a", "b")]) == 2


def plain_repeats(text):
    w = ngram_words(text)
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({p for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)})


def ngram_words(text):
    return [x.decode() for x in (text or "").encode().split()]


def test_quality_ledger(spark, docs, odd):
    rng = random.Random(4)
    loops = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))), "en", "s", 0, "", "") for i in range(50, 110)]
    for part in (docs, odd, spark.createDataFrame(loops, DOC)):
        for r in quality_rules.ledger(part.select("doc_id", "text")).collect():
            w = ngram_words(r["text"])
            lines = [x for x in (r["text"] or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
            assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w)) and r["n_repeat_words"] == plain_repeats(r["text"])
            assert r["n_symbols"] == sum((r["text"] or "").count(c) for c in "#*$%&|<>") and r["n_dup_lines"] == len(lines) - len(set(lines))
            assert bool(r["failed_rules"] & 3) == (len(w) < 50 or 100 * r["n_repeat_words"] > 50 * len(w))
    clash = odd.select("*", *[F.lit(c).alias(c) for c in ("_w", "_l", "_words", "_LINES", "_triples", "_ordered", "_places", "failed_rules", "N_lines")])
    for r in quality_rules.ledger(clash).collect():
        assert r["_w"] == "_w" and r["_words"] == "_words" and r["_LINES"] == "_LINES" and r["_places"] == "_places" and isinstance(r["failed_rules"], int)
    assert sorted(r["failed_rules"] for r in quality_rules.ledger(clash).collect()) == sorted(r["failed_rules"] for r in quality_rules.ledger(odd).collect())
    kept = quality_rules.passing(odd)
    assert kept.columns == odd.columns and {r["n_words"] for r in kept.collect()} <= {"clash"}
    rows = quality_rules.ledger(docs)
    total = rows.filter(quality_rules.kept()).count()
    for r in quality_rules.ablations(rows).collect():
        assert r["n_kept_without"] == total + r["n_alone"]
    assert quality_rules.passing(empty(spark)).count() == 0


def test_warc_round_trip_and_salvage(spark, tmp_path):
    pages = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\r\nX: y", "WARC/1.1\r\nwarc inside"), (4, "u", None), (5, "u", ""), (5, "u", ""), (None, "u", "é\r\n\r\n"), (7, "u", "z" * 200_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.archived(df).collect()
    assert all(r["kind"] == "record" for r in got) and len(got) == len(pages)
    by = {(r["page_id"], r["payload_digest"]): r for r in got}
    for i, _, h in pages:
        p = (h or "").encode()
        r = by[(i, base64.b32encode(hashlib.sha1(p).digest()).decode())]
        last = max((x[0] or -1) for x in pages if (x[2] or "") == (h or ""))
        assert r["payload_bytes"] == len(p) and (r["record_type"], r["refers_to"]) == (("response", None) if (i or -1) == last else ("revisit", last))
    path = str(tmp_path / "w")
    warc.write(df.filter("page_id IS NOT NULL").coalesce(1), path)
    (file,) = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part")]
    data = file.read_bytes()
    whole = list(warc.salvage(data))
    starts = [m.start() for m in warc.VERSION.finditer(data)]
    bad = bytearray(data)
    bad[starts[1] + 200] ^= 1
    bad[starts[0]] = 0
    kinds = [k for k, _ in warc.salvage(bytes(bad))]
    assert kinds.count("gap") >= 1 and kinds.count("record") >= len(whole) - 2
    for cut in range(0, len(data), 997):
        parts = list(warc.salvage(data[:cut]))
        assert sum(x[1] for k, x in parts if k == "gap") <= cut
    quoted = "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    warc.write(spark.createDataFrame([(1, "u", quoted + "tail"), (2, "u", "b")], "page_id long, url string, html string").coalesce(1), path + "q")
    (file,) = [f for f in (tmp_path / "wq").iterdir() if f.name.startswith("part")]
    bad = bytearray(file.read_bytes())
    bad[bad.index(b"tail")] ^= 1
    found = list(warc.salvage(bytes(bad)))
    assert [k for k, _ in found] == ["gap", "record"] and found[1][1]["h"]["warc-record-id"] == "<urn:page:2>"
    members = b"".join(gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n" + bytes([97 + i]) * 3 + b"\r\n\r\n") for i in range(5))
    assert [k for k, _ in warc.members(members)] == ["record"] * 5
    broken = bytearray(members)
    broken[len(members) // 5 + 20] ^= 255
    kinds = [k for k, _ in warc.members(bytes(broken))]
    assert kinds.count("record") >= 4 and "gap" in kinds
    assert warc.archived(df.limit(0)).count() == 0


def plain_permutation(number, size, key):
    """One number through the keyed rounds, again until it is in range."""
    keys = [int.from_bytes(hashlib.sha256(key.encode()).digest()[8 * i : 8 * i + 8], "little") for i in range(4)]
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    while True:
        left, right = number >> half, number % (1 << half)
        for k in keys:
            f = (right + k) * 0x9E3779B97F4A7C15 % (1 << 64)
            f = (f ^ (f >> 32)) * 0xD6E8FEB86659FD93 % (1 << 64)
            left, right = right, left ^ ((f ^ (f >> 29)) % (1 << half))
        number = (left << half) | right
        if number < size:
            return number


def plain_records(known, parts, length, key):
    """slot -> doc_id, ids, of texts in the tasks' order."""
    chunks = []
    for rows in parts:
        flat = [(i, t) for i, text in rows for t in [*known.encoding.encode_ordinary(text or ""), known.end]]
        chunks += [flat[k : k + length] for k in range(0, len(flat), length)]
    return {plain_permutation(n, len(chunks), key): (c[0][0], [t for _, t in c]) for n, c in enumerate(chunks)}


def test_token_output(spark, docs, odd, tmp_path, monkeypatch):
    for n in (1, 2, 3, 100, 1025):
        assert sorted(token_output.permuted(np.arange(n), n, "k").tolist()) == list(range(n))
    known = token_counts.load("byte_bpe_50k.tiktoken")
    part = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame([(None, "no id")], "doc_id long, text string"))
    tasks = part.rdd.mapPartitionsWithIndex(lambda k, it: [(k, [(-1 if r[0] is None else r[0], r[1]) for r in it])]).collect()
    want = plain_records(known, [rows for _, rows in sorted(tasks)], 64, "some key")
    monkeypatch.setattr(token_output, "WRITERS", 3)
    path = "file://" + str(tmp_path / "out")
    info = token_output.write(part, path, length=64, shard=16, key="some key").collect()
    rows = sorted(token_output.read(spark, path, length=64, ids=True).collect(), key=lambda r: r["slot"])
    assert {r["slot"]: (r["doc_id"], r["ids"]) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        assert r["crc32"] == zlib.crc32(np.array(r["ids"], "<u2").tobytes()) and r["n_tokens"] == len(r["ids"])
    assert sorted((r["shard"], r["first_slot"], r["n"]) for r in info) == [(k, 16 * k, min(16, len(want) - 16 * k)) for k in range(-(-len(want) // 16))]
    rest = list(token_output.read_from(path, len(want) - 20, length=64, shard=16))
    assert [(s, x.tolist()) for s, x in rest] == [(s, want[s][1]) for s in range(len(want) - 20, len(want))]
    assert token_output.materialised(part.limit(0)).count() == 0
    rows = token_output.rows_of(part, "doc_id", "text").coalesce(1)
    with pytest.raises(Exception, match="split otherwise"):
        token_output.sequences(rows, {0: 0}, len(want) + 9, "byte_bpe_50k.tiktoken", 64, "k").count()


def test_registered_token_output_equals_a_plain_version(spark):
    known = token_counts.load("byte_bpe_50k.tiktoken")
    tasks = token_output.rows_of(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id", "text").rdd.mapPartitionsWithIndex(lambda k, it: [(k, [tuple(r) for r in it])]).collect()
    want = plain_records(known, [rows for _, rows in sorted(tasks)], token_output.SEQUENCE, "order")
    got = text_queries.op10_token_output(spark, DATA).collect()
    assert {(r["slot"], r["doc_id"], r["n_tokens"], r["crc32"], r["shard"]) for r in got} == {
        (s, d, len(x), zlib.crc32(np.array(x, "<u2").tobytes()), s // token_output.SHARD) for s, (d, x) in want.items()
    }


def test_pipeline_equals_plain_stages(spark, docs):
    """Each stage on what the one before kept, held to a plain version of its own."""
    from tokenizers import Tokenizer

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    (_, toxic), (_, quality), (_, near), (_, mix), (_, encode) = corpus_pipeline.STAGES
    net = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    # a plain score takes a second for a long text
    scores = {r["doc_id"]: plain_score(net, r["text"]) for r in docs.filter("n_chars < 2500").collect()}
    one = toxic(spark, docs, DATA)
    kept = one.collect()
    assert one.columns == docs.columns and {r["doc_id"] for r in kept} & set(scores) == {i for i, p in scores.items() if p < 0.5}
    two = spark.createDataFrame(kept, docs.schema)
    kept = quality(spark, two, DATA).collect()
    for r in two.collect():
        w, t = ngram_words(r["text"]), r["text"] or ""
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")]
        chars, symbols, again = sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines))
        bad = len(w) < 50 or 100 * plain_repeats(t) > 50 * len(w) or 100 * symbols > 30 * len(w)
        bad |= len(lines) >= 4 and 100 * again > 50 * len(lines) or not 2 * len(w) <= chars <= 25 * len(w)
        assert (r in kept) == (not bad)
    three = spark.createDataFrame(kept, docs.schema)
    kept = near(spark, three, DATA).collect()
    groups = plain_groups([(r["doc_id"], r["text"]) for r in three.collect()])
    assert {r["doc_id"] for r in kept} == {top for _, top in groups.values()} and len(kept) == len({top for _, top in groups.values()})
    four = spark.createDataFrame(kept, docs.schema)
    kept = mix(spark, four, DATA).collect()
    size, taken, target, longest = Counter(), Counter(), {}, Counter()
    for r in mixing.mixed(four).collect():
        size[r["doc_id"]], target[r["source"]] = r["size"], r["target"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for r in kept:
        taken[r["source"]] += size[r["doc_id"]]
    assert {tuple(r) for r in kept} <= {tuple(r) for r in four.collect()} and max(Counter(r["doc_id"] for r in kept).values()) <= 3
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in target)
    lib = Tokenizer.from_file(bpe.vocabulary("word_bpe_49k.json"))
    want = Counter()
    for r in kept:
        ids = lib.encode(r["text"], add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in encode(spark, spark.createDataFrame(kept, docs.schema), DATA).collect()) == want


def test_pipeline_takes_odd_rows_and_empty_tables(spark, odd, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, rows, labels in (("odd", odd, [(4, 1)]), ("empty", empty(spark), [])):
        folder = tmp_path / name
        rows.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(folder / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert {r["doc_id"] for r in out.collect()} <= {6, 7}

"""Spelling variants against all pairs of words, and against SQL."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegate.llm import queries as text_queries
from tidegate.llm import spelling
from tests.test_queries import duck, rows  # noqa: F401  fixture

DATA = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_words(docs, change):
    count = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if change and h % change == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                count[w] += 1
    return {w: n for w, n in count.items() if n >= 2}


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and x != w and distance_one(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(map(str, out))


def told(df):
    return sorted(str(tuple(r)) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def typos(rng, word):
    letters, i = "abcdé\u00d7", rng.randrange(len(word) + 1)
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i:], word[:i] + rng.choice(letters) + word[i + 1 :]])


@pytest.mark.parametrize("seed, block", [(1, 1 << 16), (2, 5), (3, 1)])
def test_equals_all_pairs(spark, seed, block, monkeypatch):
    """Frequent words with typos, chains of typos, letters that repeat, edits at both ends, and blocks dealt to parts."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng, texts = random.Random(seed), []
    for _ in range(30):
        at = word = "".join(rng.choice("abcdéñ") for _ in range(rng.randrange(7, 12)))
        for n in (300, 25, 2):
            texts += [at] * n
            texts += [x for _ in range(6) for x in [typos(rng, word)] * rng.choice([1, 2, 3, 20])]
            at = typos(rng, at)
    texts += ["aaaaaaa"] * 2 + ["aaaaaaaa"] * 30 + ["aaaaaaaaa"] * 300 + ["Abcdefg abcdefg ABCDEFG \u00c9bcdefg \u00e9bcdefg"] * 3
    rng.shuffle(texts)
    docs = [(i // 2, " ".join(texts[k : k + 40])) for i, k in enumerate(range(0, len(texts), 40))]  # ids repeat
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(3)
    words = plain_words(docs, None)
    assert max(words.values()) >= 300
    got = told(spelling.variants(df))
    assert got == plain(words)
    assert any(w.split(", ")[1] != "None" and w.split(", ")[1] != w.split(", ")[2] for w in got)  # a form that has a form
    assert told(spelling.variants(df, change=31)) == plain(plain_words(docs, 31))


def test_odd_rows(spark):
    long = "ab" * 30_000
    docs = [(1, None), (2, ""), (3, "short 123 !!"), (4, long), (4, long), (None, long + "c"), (None, long + "c"), (5, "don't été1234567 élégance élégance elégance elégance")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["word"]: r for r in spelling.variants(df).collect()}
    assert set(got) == {long, long + "c", "élégance", "elégance"} and all(r["n_near"] == 1 and r["n"] == 2 and r["form"] is None and r["root"] == w for w, r in got.items())
    assert spelling.variants(df.limit(0)).count() == 0
    assert spelling.variants(df.filter("doc_id < 4")).count() == 0


def test_symbols_and_edges(spark):
    table = spelling.symbol_table()
    assert table.min() >= 1 and table.max() <= spelling.SYMBOLS
    words = ["zebraic", "élégance", "ÿþýabcd"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(spelling.reduced_edge(F.col("w"))).collect()]
    want = []
    for w in words:
        x = 0
        for c in w[:3]:
            x = x * (spelling.SYMBOLS + 1) + int(table[ord(c)])
        want.append(x)
    assert got == want


def test_registered_query(spark, duck):  # noqa: F811
    got = text_queries.queries()["op12_spelling"](spark, DATA).toPandas()
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert dict(zip(got["word"], got["n"])) == plain_words(docs, 31)
    assert rows(got) == rows(duck.execute(text_queries.oracle_sql()["op12_spelling"]).df())

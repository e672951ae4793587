"""Queries without SQL over the smallest tables, whole, against plain loops."""

import hashlib
import re

import numpy as np
import pytest

from tidegate.plans import registry

DATA = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\f\r"


def plain_sentences(text):
    """Characters one by one: a mark before a space ends a sentence unless it is an abbreviation's."""
    out, now, i = [], "", 0
    while i < len(text):
        c = text[i]
        now += c
        short = c == "." and any(text[:i].endswith(a) and (i == len(a) or not re.match(r"[0-9A-Za-z_]", text[i - len(a) - 1])) for a in ("dr", "mr", "ms", "vs", "no", "approx", "e.g", "i.e"))
        if c in ".?!" and not short and i + 1 < len(text) and text[i + 1] in SPACE:
            out.append(now)
            now = ""
            while i + 1 < len(text) and text[i + 1] in SPACE:
                i += 1
        i += 1
    return [s for s in (x.strip(" ") for x in [*out, now]) if s]


def test_sentences_of_whole_texts(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in registry.queries()["sf07_sentences_without"](spark, DATA).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        parts = plain_sentences(t)
        kept = [s for s in parts if not re.search("license|rights reserved", s.lower())]
        assert (got[i]["n_sentences"], got[i]["n_kept"]) == (len(parts), len(kept))
        assert got[i]["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()


@pytest.fixture(scope="module")
def scored(spark):
    """Each fold's probabilities by a penalised fit of the others, in numpy."""
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x, y, fold = np.array([r["embedding"][:8] for r in rows], float), np.array([r["label"] >= 5 for r in rows], float), ids % 4
    p = np.empty(len(rows))
    for f in range(4):
        train = fold != f
        m, s = x[train].mean(0), x[train].std(0)
        z = np.c_[np.ones(len(x)), np.clip((x - m) / s, -5, 5)]
        b, penalty = np.zeros(9), np.array([0.0] + [0.01 * train.sum()] * 8)
        for _ in range(50):
            mu = 1 / (1 + np.exp(-z[train] @ b))
            b = b + np.linalg.solve(z[train].T @ (z[train] * (mu * (1 - mu))[:, None]) + np.diag(penalty), z[train].T @ (y[train] - mu) - penalty * b)
        p[~train] = 1 / (1 + np.exp(-z[~train] @ b))
    return ids, fold, y, p


def test_heads_out_of_fold(spark, scored):
    ids, fold, y, p = scored
    got = {r["vec_id"]: r for r in registry.queries()["ml06_out_of_fold"](spark, DATA).collect()}
    assert set(got) == set(ids.tolist())
    assert max(abs(got[int(i)]["p"] - v) for i, v in zip(ids, p)) < 2e-3 and all(got[int(i)]["fold"] == f for i, f in zip(ids, fold))


def test_auroc_of_each_fold(spark, scored):
    _, fold, y, p = scored
    for r in registry.queries()["ml07_fold_auroc"](spark, DATA).collect():
        one, two = p[(fold == r["fold"]) & (y == 1)], p[(fold == r["fold"]) & (y == 0)]
        assert (r["n1"], r["n0"]) == (one.size, two.size)
        assert abs(r["auroc"] - np.mean([(a > b) + 0.5 * (a == b) for a in one for b in two])) < 0.02

"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy, scoring all overlapping windows.

Each word enters as the embedding of the word, if it is a known one, and the mean embedding of its character triples. Windows of 64
words start every 48 words, the last one at the text's end, so that every word of a whole text is read. A document's score is that
of its worst window. Labels are learnt from a bounded sample; as a label says only that some window is toxic, each epoch trains on
the window that the network at present finds worst. Scoring happens where the rows are: the network is a few hundred KB.

A known word's embedding starts at its log odds in the sample in the first component, and the first choice of worst windows is by
the sums of these odds; training moves both.

Null and empty texts, and texts without a word, score 0. Very long texts are read to their end. Repeated rows score alike; other
columns stay, but for those named as the result's. A null id isn't held out, as no label can belong to it. An empty table gives an
empty one. If the sample lacks one of the two labels, all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.common import release, text_batches

WINDOW, STRIDE = 64, 48
#: Bounds of the labelled sample: documents of label 1 and of label 0, first ones by the hash of their ids.
SAMPLE = {1: 800, 0: 1_600}
#: Characters of a text of the sample, at most: longer ones aren't learnt from, so that the sample's size is bounded. Scores know no bound.
MOST_CHARS = 100_000
#: Known words: those in so many sampled documents, the most frequent ones.
LEAST_DOCS, MOST_WORDS = 5, 20_000
TRIPLES = 4_096
SIZE = 8
EPOCHS, BATCH, RATE = 10, 256, 0.015
#: Small samples are gone through more often, up to so many steps.
STEPS = 120
#: How often the worst windows are chosen anew.
CHOICES = 4
HELD_OUT = 5
THRESHOLD = 0.5
#: Word projections that a Python worker remembers.
REMEMBERED = 60_000
STRIP = b".,;:!?|\"'()[]*"


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters by name; gates are update, reset and candidate, for both directions."""

    words: dict[bytes, int]
    p: dict[str, np.ndarray]
    # remembered projections of words to both directions' gates
    rows: dict[bytes, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def __getstate__(self):
        return {"words": self.words, "p": self.p, "rows": {}, "table": None}

    def triples(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the character triples of all words with a mark at both ends, one after another, and where each word's begin."""
        marked = [b"^" + w.strip(STRIP) + b"$$" for w in words]
        flat = np.frombuffer(b"".join(marked), np.uint8).astype(np.int64)
        n = np.fromiter(map(len, marked), np.int64, len(marked))
        code = (flat[:-2] * 31 + flat[1:-1]) * 31 + flat[2:]
        code = (code * 2654435761 >> 7) % TRIPLES
        start = np.r_[0, n.cumsum()[:-1]]
        inside = np.ones(code.size, bool)
        inside[(start[1:, None] - [1, 2]).ravel()] = False
        return code[inside], start - 2 * np.arange(n.size)

    def vocabulary(self, words: list[bytes]) -> np.ndarray:
        get = self.words.get
        return np.fromiter((get(w.strip(STRIP), 0) for w in words), np.int64, len(words))

    def combined(self, known: np.ndarray, code: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Words' inputs: the known word's embedding beside the mean of its triples'."""
        chars = np.add.reduceat(self.p["chars"][code], start, axis=0) / count[:, None]
        return np.concatenate([self.p["words"][known], chars], 1).astype(np.float32)

    def projected(self, words: list[bytes]) -> np.ndarray:
        code, start = self.triples(words)
        return self.combined(self.vocabulary(words), code, start, np.diff(np.r_[start, code.size])) @ self.p["x"] + self.p["b"]

    @staticmethod
    def with_pad(table: np.ndarray) -> np.ndarray:
        """Row 0 keeps the state: its update gates are shut."""
        pad = np.zeros((1, 6 * SIZE), np.float32)
        pad[:, :SIZE] = pad[:, 3 * SIZE : 4 * SIZE] = 40.0
        return np.concatenate([pad, table])

    def indices(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Rows of the table for each text's words; rows 0 and up of words not seen before are made together."""
        unseen = {w for t in texts for w in t if w not in self.rows}
        if self.table is None or len(self.rows) + len(unseen) > REMEMBERED:
            self.rows.clear()
            unseen = {w for t in texts for w in t}
            self.table = self.with_pad(np.empty((0, 6 * SIZE), np.float32))
        if unseen:
            new = list(unseen)
            first = len(self.rows) + 1
            self.rows.update(zip(new, range(first, first + len(new))))
            if first + len(new) > len(self.table):  # twice the room, so that rows are seldom copied
                self.table = np.concatenate([self.table, np.empty((first + len(new), 6 * SIZE), np.float32)])
            self.table[first : first + len(new)] = self.projected(new)
        get = self.rows.__getitem__
        return [np.fromiter(map(get, t), np.int64, len(t)) for t in texts]

    def forget(self) -> None:
        self.rows, self.table = {}, None

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """Of windows of table rows; 0 pads."""
        out = np.empty(len(windows), np.float32)
        for i in range(0, len(windows), 512):
            w = windows[i : i + 512]
            out[i : i + 512] = self.forward(self.table[w], w > 0)[0]
        return out

    def forward(self, x: np.ndarray, live: np.ndarray, keep: bool = False):
        """x: projected inputs (window, step, 6 sizes). Returns logits and, if asked, what the backward pass needs."""
        n, steps, s = x.shape[0], x.shape[1], SIZE
        states = np.empty((n, steps, 2 * s), np.float32)
        kept = []
        for d in (0, 1):
            u, h = self.p["h"][d], np.zeros((n, s), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                xt = x[:, t, 3 * s * d : 3 * s * (d + 1)]
                g = h @ u
                zr = sigmoid(xt[:, : 2 * s] + g[:, : 2 * s])
                z, r = zr[:, :s], zr[:, s:]
                c = np.tanh(xt[:, 2 * s :] + r * g[:, 2 * s :])
                if keep:
                    kept.append((d, t, h, z, r, c, g[:, 2 * s :]))
                h = c + z * (h - c)
                states[:, t, s * d : s * (d + 1)] = h
        a = np.tanh(states @ self.p["a"])
        e = np.where(live, a @ self.p["v"], -1e9)
        e = np.exp(e - e.max(1, keepdims=True))
        w = e / e.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", w, states)
        return pooled @ self.p["o"] + self.p["c"][0], (states, a, w, pooled, kept) if keep else None

    def backward(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean log loss: of the parameters, and of x."""
        s = SIZE
        logit, (states, a, w, pooled, kept) = self.forward(x, live, keep=True)
        out = (sigmoid(logit) - y) / len(y)
        g = {"o": pooled.T @ out, "c": out.sum(keepdims=True)}
        dp = out[:, None] * self.p["o"]
        ds = w[:, :, None] * dp[:, None, :]
        dw = np.einsum("nth,nh->nt", states, dp)
        de = w * (dw - (w * dw).sum(1, keepdims=True))
        g["v"] = np.einsum("nt,ntk->k", de, a)
        da = de[:, :, None] * self.p["v"] * (1 - a * a)
        g["a"] = np.einsum("nth,ntk->hk", states, da)
        ds += da @ self.p["a"].T
        dx, dh = np.zeros_like(x), {0: 0.0, 1: 0.0}
        g["h"] = np.zeros_like(self.p["h"])
        for d, t, h, z, r, c, gc in reversed(kept):
            u = self.p["h"][d]
            dn = ds[:, t, s * d : s * (d + 1)] + dh[d]
            dc = dn * (1 - z) * (1 - c * c)
            dz = dn * (h - c) * z * (1 - z)
            dr = dc * gc * r * (1 - r)
            dx[:, t, 3 * s * d : 3 * s * (d + 1)] = np.concatenate([dz, dr, dc], 1)
            dg = np.concatenate([dz, dr, dc * r], 1)
            g["h"][d] += h.T @ dg
            dh[d] = dn * z + dg @ u.T
        return g, dx


def windows_of(n: int) -> list[int]:
    """Where the windows of a text of n words start."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def cut(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of some texts, and each one's text."""
    starts = [windows_of(len(r)) for r in rows]
    of = np.repeat(np.arange(len(rows)), [len(x) for x in starts])
    out = np.zeros((of.size, WINDOW), np.int32)
    k = 0
    for r, ss in zip(rows, starts):
        for i in ss:
            part = r[i : i + WINDOW]
            out[k, : part.size] = part
            k += 1
    return out, of


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Network | None:
    """From texts and labels 0 and 1."""
    labels = np.asarray(labels, np.float32)
    if not 0 < labels.sum() < len(labels):
        return None
    rng, place, rows = np.random.default_rng(seed), {}, []
    for t in texts:  # words become numbers at once: the driver holds each distinct word only
        rows.append(np.fromiter((place.setdefault(w, len(place) + 1) for w in words_of(t)), np.int32))
    names, base = list(place), {}
    bare = np.fromiter((base.setdefault(w.strip(STRIP), len(base)) for w in names), np.int64, len(names))
    seen = np.zeros((2, len(base)), np.int64)
    for r, y in zip(rows, labels):
        seen[int(y), np.unique(bare[r - 1])] += 1
    total = seen.sum(0)
    forms = list(base)
    common = sorted((k for k in np.flatnonzero(total >= LEAST_DOCS) if forms[k]), key=lambda k: (-total[k], forms[k]))[:MOST_WORDS]
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    odds = np.log((seen[1, common] + 1) / (n1 + 2)) - np.log((seen[0, common] + 1) / (n0 + 2))
    s = SIZE
    shape = {"words": (len(common) + 1, s), "chars": (TRIPLES, s), "x": (2 * s, 6 * s), "b": (6 * s,), "h": (2, s, 3 * s), "a": (2 * s, s), "v": (s,), "o": (2 * s,), "c": (1,)}
    p = {k: (rng.normal(0, 0.1 if k in ("words", "chars") else 0.35, v)).astype(np.float32) for k, v in shape.items()}
    p["b"][:], p["c"][:] = 0, -1
    p["words"][0] = 0
    p["words"][1:, 0] = np.clip(odds, -3, 5)
    net = Network({forms[k]: i + 1 for i, k in enumerate(common)}, p)
    # what doesn't change: the distinct words from 1 on (0 pads), their triples and known words, all windows
    del place, base
    windows, of = cut(rows)
    code, start = net.triples(names)
    count, known = np.diff(np.r_[start, code.size]), net.vocabulary(names)
    value = np.sort(np.r_[0, p["words"][known, 0]][windows], 1)[:, -3:].sum(1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    epochs, steps = max(EPOCHS, STEPS // -(-len(rows) // BATCH)), 0
    for epoch in range(epochs):
        if epoch and epoch % -(-epochs // CHOICES) == 0:
            net.table = net.with_pad(net.combined(known, code, start, count) @ p["x"] + p["b"])
            value = net.logits(windows)
        order = np.lexsort((-value, of))
        worst = order[np.searchsorted(of[order], np.arange(len(rows)))]
        other = rng.integers(0, len(windows), len(rows) // 2)
        chosen = rng.permutation(np.r_[worst, other[labels[of[other]] == 0]])
        for i in range(0, len(chosen), BATCH):
            k = chosen[i : i + BATCH]
            uniq, inverse = np.unique(windows[k], return_inverse=True)
            inverse = inverse.reshape(len(k), WINDOW)
            u = uniq[uniq > 0] - 1
            pad = int(uniq[0] == 0)
            if not u.size:
                continue
            cn = count[u]
            cstart = np.r_[0, cn.cumsum()[:-1]]
            cs = code[np.arange(cn.sum()) + np.repeat(start[u] - cstart, cn)]
            inp = net.combined(known[u], cs, cstart, cn)
            table = net.with_pad(inp @ p["x"] + p["b"])
            at = inverse + 1 - pad
            g, dx = net.backward(table[at], at > 0, labels[of[k]])
            dproj = summed(at.ravel(), dx.reshape(-1, 6 * s), len(table))[1:]
            g["x"], g["b"] = inp.T @ dproj, dproj.sum(0)
            dinp = dproj @ p["x"].T
            g["words"] = summed(known[u], dinp[:, :s], len(p["words"]))
            g["words"][0] = 0
            g["chars"] = summed(cs, np.repeat(dinp[:, s:] / cn[:, None], cn, axis=0), TRIPLES)
            steps += 1
            for name, grad in g.items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                p[name] -= (RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6)).astype(np.float32)
    net.forget()
    return net


def summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows that go to the same place."""
    out = np.zeros((size, rows.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    places = at[order]
    first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    out[places[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def score_texts(net: Network | None, texts: list[str | None]) -> np.ndarray:
    """Of each whole text: the worst window's probability."""
    docs = [words_of(t) for t in texts]
    out = np.zeros(len(docs))
    if net is None:
        return out
    some = [i for i, d in enumerate(docs) if d]
    if some:
        windows, of = cut(net.indices([docs[i] for i in some]))
        value = net.logits(windows)
        worst = np.full(len(some), -np.inf)
        np.maximum.at(worst, of, value)
        out[some] = sigmoid(worst)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """Learns from labelled rows that aren't held out: at most SAMPLE of each label, the same ones at every run."""
    usable = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    ids = None
    for y, most in SAMPLE.items():
        part = usable.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        ids = part if ids is None else ids.unionByName(part)
    # broadcast: at most the rows of SAMPLE
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter(F.length("text") <= MOST_CHARS)
    rows = rows.join(F.broadcast(ids), F.col("doc") == F.col("id"))
    # one text for each id, however often it occurs
    got = rows.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).toPandas().sort_values(["id", "text"], kind="stable")
    return train(got["text"].tolist(), got["y"].to_numpy())


def score_column(spark: SparkSession, net: Network | None, text: Column) -> Column:
    text_batches(spark)
    shared = spark.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        try:
            for t in texts:
                yield pd.Series(score_texts(model, t.tolist()))
        finally:
            if model is not None:
                model.forget()
            release()

    return score(text)


def scored(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """Adds score and predicted to all rows."""
    kept = docs.drop("score", "predicted").withColumn("score", score_column(docs.sparkSession, net, F.col(text_col)))
    return kept.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """The rows that aren't toxic, with their columns."""
    return docs.filter(score_column(docs.sparkSession, net, F.col(text_col)) < THRESHOLD)

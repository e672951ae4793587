"""Near duplicates: Jaccard join on word 5-grams by T-occurrence search over inverted lists.

A text's set is its distinct shingles of five words (lower-cased A-Z); two texts link if their sets' intersection is at least 75
hundredths of their union. The search follows DivideSkip. A set of n shingles needs T = ceil(0.75 n) common ones, so its T - c longest
lists can be set aside: a partner occurs in at least c of the others (c is 1 to 128, by n), and only these are built and dealt by
shingle. A bucket of shingles heap-merges each node's lists into partners with their occurrences; occurrences are summed over the
buckets, pairs with c are retained if parity signatures leave them enough in common, and the lists set aside are probed by binary
search in the partner's sorted set.

- One pass makes each text's set digest and counts its chunk's frequent shingles. Texts of equal sets form a class; one node stands
  for it. The frequent shingles (a table of bounded size) only fix the order that makes lists short: any order gives right results.
- A list of more than SHORT_LIST nodes, if it is among the shortest ones of a node, comes of many near copies or of a passage that
  is most of many texts. No such list is merged. Each node is first compared with one node, the one among its lists' members that has
  most of them: that joins copies to their original. What is then in another component than most of its list is held against that list
  tile by tile; bounds on lengths, on places in the lists and on the parity signatures of the sets leave few pairs to emit. All bounds
  are upper bounds of the overlap, so that no link between components is lost.
- Components come from label propagation with pointer jumping over the links.

Null and empty texts, and texts without a word, have no shingle and link with nothing; with fewer than five words the whole
sequence is the one shingle. Very long texts are sets like others. Repeated rows and equal texts share a class. Ids should be unique:
rows that share one share its class and component; a null id gives a null component. Other columns are ignored. An empty table gives
an empty result.

Nodes that are mostly one passage without linking cost tile comparisons by the square of their number, a few nanoseconds each.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import ODD, Scratch, release, releasing, text_batches, texts_of, unused, word_hashes

WORDS = 5
#: Links need 100 * intersection >= 75 * union.
SIMILARITY = 75
#: Occurrences in short lists that make a candidate: one for so many shingles, at most COMMON.
COMMON, COMMON_SHARE = 128, 24
#: Lists of more nodes are long.
SHORT_LIST = 16
#: Shingles of a chunk, whose frequent ones are counted together; how often one must occur there, and how many are told.
CHUNK, OFTEN, TOLD = 1 << 20, 3, 10_000
#: Postings that a task sorts at a time.
POSTINGS = 1 << 18
#: Frequent shingles that order the lists: 16 bytes each reach every executor.
FREQUENT = 500_000
#: Ids up to this number are broadcast to pick their texts: 8 bytes each; more are shuffled.
BROADCAST_IDS = 1_000_000
#: Nodes of a hub's block, and of either side of a tile.
BLOCK, TILE = 512, 2_048
#: Bits of a set's parity signature, those of the finer one of sets of at least so many shingles, and signatures compared at a time.
BITS, FINE_BITS, FINE_FROM, PAIRS = 2_048, 16_384, 1_024, 1 << 14
POSTING = np.dtype([("h", "<i8"), ("v", "<i8"), ("n", "<i4"), ("p", "<i4")])
MARK = -1


def mixed(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = x * ODD + w
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    w, at = word_hashes(texts)
    last = np.uint64(0xBF58476D1CE4E5B9)
    x = np.full(max(0, w.size - WORDS + 1), WORDS, np.uint64)
    for i in range(WORDS if x.size else 0):
        x = mixed(x, w[i : w.size - WORDS + 1 + i])
    x *= last
    x ^= x >> np.uint64(32)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= WORDS:
            s = np.sort(x[a : b - WORDS + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b == a:
            out.append(w[:0])
        else:
            y = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                y = mixed(y, w[i : i + 1])
            y *= last
            out.append(y ^ (y >> np.uint64(32)))
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def node(of: bytes) -> int:
    """Part of a digest, as postings have it. Should two sets share it, pairs with it are tried for both."""
    return int.from_bytes(of[:8], "little", signed=True)


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """Common shingles that a set of n must share with any that links to it: ceil(0.75 n)."""
    return -(-n * SIMILARITY // 100)


def occurrences(n: np.ndarray | int) -> np.ndarray | int:
    """Short lists that a set of n and any that links to it have in common at least; fewer are asked of smaller sets."""
    return np.clip(n // COMMON_SHARE, 1, COMMON)


def similar_lengths(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | bool:
    return 100 * np.minimum(n, m) >= SIMILARITY * np.maximum(n, m)


@releasing
def digest_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n, digest, node) of texts and (h, count) of a chunk's frequent shingles."""
    names = ["doc_id", "n", "digest", "node", "h", "count"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    waiting: list[np.ndarray] = []
    held = 0

    def rows(many: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[x] if x in given else pa.nulls(many, k) for x, k in zip(names, kinds)], names)

    def frequent() -> pa.RecordBatch:
        h, count = np.unique(np.concatenate(waiting), return_counts=True)
        keep = count >= OFTEN
        h, count = h[keep], count[keep]
        if h.size > TOLD:
            top = np.argpartition(-count, TOLD)[:TOLD]
            h, count = h[top], count[top]
        return rows(h.size, h=pa.array(h.view(np.int64)), count=pa.array(count.astype(np.int64)))

    for b in batches:
        sets = shingle_sets(texts_of(b.column("text")))
        digests = [digest(s) if s.size else None for s in sets]
        yield rows(
            len(sets),
            doc_id=b.column("doc_id"),
            n=pa.array([s.size for s in sets], pa.int64()),
            digest=pa.array(digests, pa.binary()),
            node=pa.array([node(d) if d else None for d in digests], pa.int64()),
        )
        waiting += sets
        held += sum(s.size for s in sets)
        if held >= CHUNK:
            yield frequent()
            waiting, held = [], 0
    if held:
        yield frequent()


@releasing
def posting_pass(batches: Iterator[pa.RecordBatch], frequent: tuple[np.ndarray, np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Short-list postings of each set, packed by bucket of the shingle; kind 1: members of lists that are long in this task alone."""
    often, rank = frequent
    held: list[np.ndarray] = []
    seen: set[int] = set()
    size = 0

    def flush() -> pa.RecordBatch:
        posts = np.concatenate(held)
        posts = posts[np.argsort(posts["h"])]
        start = np.flatnonzero(np.r_[True, posts["h"][1:] != posts["h"][:-1]])
        length = np.diff(np.r_[start, posts.size])
        long = np.repeat(length > SHORT_LIST, length)
        marks = posts[start[length > SHORT_LIST]].copy()
        marks["n"] = MARK
        rows = []
        for kind, part in ((0, np.concatenate([posts[~long], marks])), (1, posts[long])):
            # members of a long list are dealt apart: they meet again by joins that Spark can split
            at = ((part["h"] if kind == 0 else part["v"]).view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(at, kind="stable")
            part, at = part[order], at[order]
            cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if part.size else np.array([], int)
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), part.size]):
                rows.append((int(at[i]), kind, part[i:j].tobytes()))
        a, b, c = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["bucket", "kind", "posts"])

    for b in batches:
        for s in shingle_sets(texts_of(b.column("text"))):
            n = s.size
            if not n or (number := node(digest(s))) in seen:
                continue
            seen.add(number)
            p = int(n - needed(n) + occurrences(n))
            if often.size:
                at = np.minimum(np.searchsorted(often, s), often.size - 1)
                order = np.where(often[at] == s, rank[at], 0)
                s = s[np.argsort(order, kind="stable")] if order.any() else s
            post = np.empty(p, POSTING)
            post["h"], post["v"], post["n"], post["p"] = s[:p].view(np.int64), number, n, np.arange(p)
            held.append(post)
            size += p
        if size >= POSTINGS:
            yield flush()
            held, size = [], 0
            seen.clear()
    if held:
        yield flush()


def heap_merge(lists: list[list[int]]) -> Iterator[tuple[int, int]]:
    """Ids of sorted lists in order, each with the number of lists that it occurs in."""
    if len(lists) == 1:
        return ((x, 1) for x in lists[0])
    return ((x, sum(1 for _ in same)) for x, same in groupby(heapq.merge(*lists)))


def merge_lists(bucket: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's lists: each node's later partners in short lists with their occurrences; the postings of long lists as they are."""
    far = [np.frombuffer(x, POSTING) for x in bucket.loc[bucket["kind"] == 1, "posts"]]
    near = [np.frombuffer(x, POSTING) for x in bucket.loc[bucket["kind"] == 0, "posts"]]
    pairs: list[tuple[int, int, int, int]] = []
    if near:
        posts = np.concatenate(near)
        posts = posts[np.lexsort((posts["n"] != MARK, posts["v"], posts["h"]))]
        new = np.r_[True, (posts["h"][1:] != posts["h"][:-1]) | (posts["v"][1:] != posts["v"][:-1]) | (posts["n"][1:] != posts["n"][:-1])]
        posts = posts[new]
        start = np.flatnonzero(np.r_[True, posts["h"][1:] != posts["h"][:-1]])
        length = np.diff(np.r_[start, posts.size])
        marked = np.add.reduceat(posts["n"] == MARK, start) > 0
        long = np.repeat(marked | (length > SHORT_LIST), length) & (posts["n"] != MARK)
        far.append(posts[long])
        short = posts[np.repeat((length > 1) & (length <= SHORT_LIST) & ~marked, length)]
        size = dict(zip(short["v"].tolist(), short["n"].tolist()))
        lists: dict[int, list[list[int]]] = {}
        ids = short["v"].tolist()
        cut = np.flatnonzero(np.r_[True, short["h"][1:] != short["h"][:-1], True]).tolist() if ids else []
        for i, j in zip(cut, cut[1:]):
            for k in range(i, j - 1):
                lists.setdefault(ids[k], []).append(ids[k + 1 : j])
        for a, later in lists.items():
            n = size[a]
            for b, count in heap_merge(later):
                m = size[b]
                if 100 * min(n, m) >= SIMILARITY * max(n, m):
                    pairs.append((a, b, count, int(occurrences(min(n, m)))))
    pair = np.array(pairs, np.int64).reshape(-1, 4)
    many = np.concatenate(far) if far else np.empty(0, POSTING)
    one = pd.DataFrame({"h": pd.array([None] * len(pair), "Int64"), "a": pair[:, 0], "b": pair[:, 1], "n": pair[:, 2], "p": pair[:, 3]})
    del pairs
    release()
    two = pd.DataFrame({"h": many["h"], "a": many["v"], "b": 0, "n": many["n"], "p": many["p"]})
    return pd.concat([one, two.astype({"h": "Int64"})], ignore_index=True)


def signature(s: np.ndarray, bits: int) -> bytes:
    """Bits that say if an odd number of shingles falls on each: two signatures differ in no more bits than their sets in shingles."""
    return np.packbits(np.bincount((s >> np.uint64(17)).astype(np.int64) % bits, minlength=bits) & 1).tobytes()


@releasing
def signature_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts with their node v: size, signature and, of large sets, the finer one."""
    for b in batches:
        sets = shingle_sets(texts_of(b.column("text")))
        coarse = pa.array([signature(s, BITS) for s in sets], pa.binary())
        fine = pa.array([signature(s, FINE_BITS) if s.size >= FINE_FROM else None for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("v"), pa.array([s.size for s in sets], pa.int64()), coarse, fine], ["v", "n", "bits", "fine"])


@releasing
def sets_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = shingle_sets(texts_of(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("v"), pa.array([s.tobytes() for s in sets], pa.binary())], ["v", "s"])


@releasing
def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures don't rule out a link: the overlap is at most half of both sizes less what differs."""
    for b in batches:
        keep = []
        for n, m, x, y, fx, fy in zip(*(b.column(k).to_pylist() for k in ("n", "m", "x", "y", "fx", "fy"))):
            if fx is not None and fy is not None:
                x, y = fx, fy
            apart = int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum(dtype=np.int64))
            keep.append(100 * min(n, m) >= SIMILARITY * max(n, m) and (100 + SIMILARITY) * (n + m - apart) >= 2 * SIMILARITY * (n + m))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])


def linking(s: np.ndarray, t: np.ndarray) -> bool:
    """Probes the larger set for each shingle of the smaller one."""
    if s.size > t.size:
        s, t = t, s
    if not s.size or 100 * s.size < SIMILARITY * t.size:
        return False
    common = int((t[np.minimum(np.searchsorted(t, s), t.size - 1)] == s).sum())
    return 100 * common >= SIMILARITY * (s.size + t.size - common)


@releasing
def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ordered by a and block, each hub's own set (b null) first: the pairs that link. One set is held at a time."""
    now, hubs = None, []
    for b in batches:
        x, y = [], []
        at = zip(*(b.column(k).to_pylist() for k in ("a", "block", "b", "s")))
        for a, block, other, s in at:
            if (a, block) != now:
                now, hubs = (a, block), []
            s = np.frombuffer(s, np.uint64)
            if other is None:
                hubs.append(s)
            elif any(linking(h, s) for h in hubs):
                x.append(a)
                y.append(other)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def possible(pairs: DataFrame, signatures: DataFrame, keep: Scratch) -> DataFrame:
    """The pairs (a, b) that signatures don't rule out."""
    x = signatures.select(F.col("v").alias("i"), "n", F.col("bits").alias("x"), F.col("fine").alias("fx"))
    y = signatures.select(F.col("v").alias("j"), F.col("n").alias("m"), F.col("bits").alias("y"), F.col("fine").alias("fy"))
    both = pairs.join(x, pairs["a"] == x["i"]).join(y, F.col("b") == y["j"])
    return keep(both.select("a", "b", "n", "m", "x", "y", "fx", "fy").mapInArrow(bounded, "a long, b long").distinct(), "possible")


def linked(pairs: DataFrame, texts: DataFrame, keep: Scratch) -> DataFrame:
    """The pairs (a, b) of class ids whose sets link. Sets are made of these ids' texts alone; one moves once for each pair as b, and
    once for each BLOCK pairs as a."""
    hubs = pairs.groupBy(F.col("a").alias("hub")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    hubs = keep(hubs, "hubs")
    members = pairs.join(hubs, pairs["a"] == hubs["hub"]).select(F.col("b").alias("i"), "a", F.pmod(F.xxhash64("b"), "blocks").alias("block"), "b")
    heads = hubs.select(F.col("hub").alias("i"), F.col("hub").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("b"))
    roles = keep(heads.unionByName(members), "roles")
    sets = of_ids(texts, roles.select(F.col("i").alias("id")).distinct(), keep).mapInArrow(sets_pass, "v long, s binary")
    rows = sets.hint("merge").join(roles, sets["v"] == roles["i"]).select("a", "block", "b", "s")
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    out = keep(rows.mapInArrow(probe, "a long, b long"), "linked")
    keep.drop(hubs, roles)
    return out


def of_ids(texts: DataFrame, ids: DataFrame, keep: Scratch) -> DataFrame:
    """v, text of the rows with these ids."""
    ids = keep(ids, "ids")
    return picked(texts, ids, texts["doc_id"] == ids["id"], "left_semi").select(F.col("doc_id").alias("v"), "text")


def components(links: DataFrame, keep: Scratch) -> DataFrame:
    """id, component (its smallest id) of all ids in links (a, b): label propagation and pointer jumping until nothing changes."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = keep(both, "links")
    labels = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        step = keep(step, "step")
        top = step.select(F.col("id").alias("t"), F.col("c").alias("top"))
        new = keep(step.join(top, step["c"] == top["t"]).select("id", "old", F.col("top").alias("component")), "labels")
        done = new.filter("component < old").isEmpty()
        keep.drop(step, labels)
        if done:
            keep.drop(both)
            return new
        labels = new


def picked(docs: DataFrame, ids: DataFrame, on, kind: str) -> DataFrame:
    """A semi or anti join with a written table of ids, broadcast if they are few."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, kind)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) of each row. Its two tables stay in the shared folder."""
    spark = docs.sparkSession
    text_batches(spark)
    keep = Scratch(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    told = keep(texts.mapInArrow(digest_pass, "doc_id long, n long, digest binary, node long, h long, count long"), "digests")
    sets = told.filter("h IS NULL").select("doc_id", "n", "digest", "node")

    # classes of equal sets; only those of two or more rows need a table
    shared = sets.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = keep(shared.filter("first < last").select(F.col("digest").alias("d"), "first"), "classes")
    members = sets.join(shared, sets["digest"] == shared["d"], "left").select("doc_id", "n", "node", F.coalesce("first", "doc_id").alias("class_id"))
    members = keep(members, "members")
    nodes = members.filter("node IS NOT NULL AND doc_id = class_id").select("node", "class_id").distinct()

    top = told.filter("h IS NOT NULL").groupBy("h").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "h").limit(FREQUENT).toPandas()
    often = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(often)
    # shingles of about equal frequency are ordered by hash
    frequent = spark.sparkContext.broadcast((often[order], (4 * np.log2(np.maximum(top["count"].to_numpy(np.float64)[order], 1))).astype(np.int32) + 1))
    total = sets.agg(F.sum(F.col("n") / 4)).first()[0] or 0
    buckets = int(max(256, total // 250_000))
    keep.drop(told, shared)

    posts = texts.filter("doc_id IS NOT NULL").select("text").mapInArrow(lambda it: posting_pass(it, frequent.value, buckets), "bucket int, kind int, posts binary")
    lists = keep(posts.groupBy("bucket").applyInPandas(merge_lists, "h long, a long, b long, n int, p int"), "lists")
    few = lists.filter("h IS NULL").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("p").alias("least")).filter("n >= least")
    pairs = keep(named(few, nodes), "pairs")
    many = keep(lists.filter("h IS NOT NULL").select("h", "n", "p", F.col("a").alias("node")).join(nodes, "node").select("h", "n", "p", F.col("class_id").alias("v")).distinct(), "many")
    keep.drop(lists)
    hubs = keep(hub_pairs(many, keep), "hubs")

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(many.select("v")).distinct()
    signatures = keep(of_ids(texts, ids, keep).mapInArrow(signature_pass, "v long, n long, bits binary, fine binary"), "signatures")
    links = linked(possible(pairs.unionByName(hubs), signatures, keep), texts, keep)
    labels = components(links, keep)
    rest = possible(tile_pairs(many, labels, signatures, keep), signatures, keep)
    if not rest.isEmpty():
        more = linked(rest, texts, keep)
        if not more.isEmpty():
            labels = merged_labels(labels, more, keep)
    keep.drop_all_but(members, labels)
    out = members.join(labels, members["class_id"] == labels["id"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"))


def merged_labels(labels: DataFrame, links: DataFrame, keep: Scratch) -> DataFrame:
    """Labels after further links: those join components, not nodes."""
    names = labels.select("id", "component")
    got = links
    for x in ("a", "b"):
        side = names.select(F.col("id").alias("i"), F.col("component").alias("c"))
        got = got.join(side, got[x] == side["i"], "left").withColumn(x, F.coalesce("c", x)).drop("i", "c")
    top = components(keep(got.filter("a <> b"), "joined"), keep).select(F.col("id").alias("i"), F.col("component").alias("c"))
    new = names.unionByName(top.select(F.col("i").alias("id"), F.col("i").alias("component"))).dropDuplicates(["id"])
    return keep(new.join(top, new["component"] == top["i"], "left").select("id", F.coalesce("c", "component").alias("component")), "labels")


def named(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of node numbers as pairs of class ids."""
    na, nb = nodes.select(F.col("node").alias("na"), F.col("class_id").alias("x")), nodes.select(F.col("node").alias("nb"), F.col("class_id").alias("y"))
    got = pairs.join(na, pairs["a"] == na["na"]).join(nb, F.col("b") == nb["nb"])
    return got.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def hub_pairs(many: DataFrame, keep: Scratch) -> DataFrame:
    """One pair (a, b) for each node b of the long lists (h, n, p, v): a is the one among its lists' members that most and largest lists hold."""
    sizes = many.groupBy(F.col("h").alias("sh")).agg(F.count("*").alias("size"))
    weights = many.join(sizes, many["h"] == sizes["sh"]).groupBy(F.col("v").alias("wv")).agg(F.sum("size").alias("weight"))
    weighed = keep(many.join(weights, many["v"] == weights["wv"]).select("h", "v", "n", "weight"), "weighed")
    tops = weighed.groupBy(F.col("h").alias("th")).agg(F.max(F.struct("weight", F.col("v").alias("hub"), F.col("n").alias("m"))).alias("top"))
    near = 100 * F.least("n", "top.m") >= SIMILARITY * F.greatest("n", "top.m")
    best = weighed.join(tops, weighed["h"] == tops["th"]).filter(near & (F.col("v") != F.col("top.hub"))).groupBy("v").agg(F.max("top").alias("top"))
    return best.select(F.col("top.hub").alias("a"), F.col("v").alias("b"))


def tile_pairs(many: DataFrame, labels: DataFrame, signatures: DataFrame, keep: Scratch) -> DataFrame:
    """Pairs (a, b) of different components, one of them not in its list's largest, that may still link by all bounds.

    A pair that links and has too few short lists in common shares a long one among the first n - T + c places, wherever it stands
    there: all of these places take part. At the first such list that it shares, the bound of ``tile`` holds.
    """
    rows = keep(many.join(labels, many["v"] == labels["id"], "left").select("h", "v", "n", "p", F.coalesce("component", "v").alias("c")), "labelled")
    by_component = rows.groupBy("h", "c").agg(F.count("*").alias("k"))
    tops = by_component.groupBy(F.col("h").alias("th")).agg(F.max(F.struct("k", "c")).alias("most"), F.sum("k").alias("size"))
    tops = keep(tops.filter("most.k < size").select("th", F.col("most.c").alias("main"), F.ceil(F.col("size") / TILE).alias("nb"), F.ceil((F.col("size") - F.col("most.k")) / TILE).alias("ob")), "tops")
    bits = signatures.select(F.col("v").alias("bv"), "bits")
    inside = rows.join(tops, rows["h"] == tops["th"]).drop("th")
    inside = inside.join(bits, inside["v"] == bits["bv"]).drop("bv")
    column, row = F.pmod(F.xxhash64("v"), "nb"), F.pmod(F.xxhash64("v"), "ob")
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    fields = ["h", "v", "n", "p", "c", "bits"]
    them = inside.withColumn("i", all_of("ob")).select(*fields, "i", column.alias("j"), F.lit(1).alias("side"))
    us = inside.filter("c <> main").withColumn("j", all_of("nb")).select(*fields, row.alias("i"), "j", F.lit(0).alias("side"))
    tiles = us.unionByName(them).repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return keep(tiles.mapInArrow(compared, "a long, b long").distinct(), "rest")


@releasing
def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of tiles, row after row: the pairs that no bound rules out. A tile has at most some thousands of nodes."""
    now, held = None, []
    for b in batches:
        got = pa.Table.from_batches([b]).to_pandas()
        key = got[["h", "i", "j"]].to_numpy()
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True])
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if (k := tuple(key[i].tolist())) != now:
                yield from tile(held)
                now, held = k, []
            held.append(got.iloc[i:j])
    yield from tile(held)


def tile(parts: list[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
    if not parts:
        return
    rows = pd.concat(parts)
    us, them = rows[rows["side"] == 0], rows[rows["side"] == 1]
    if us.empty or them.empty:
        return
    n, m, p, q = (x.to_numpy(np.int64) for x in (us["n"], them["n"], us["p"], them["p"]))
    c, d, v, w = (x.to_numpy(np.int64) for x in (us["c"], them["c"], us["v"], them["v"]))
    mine, theirs = (np.frombuffer(b"".join(x["bits"]), np.uint64).reshape(len(x), -1) for x in (us, them))
    for i in range(n.size):
        # common shingles before this list's are in short lists, and fewer than a candidate has
        most = np.minimum(n[i] - p[i], m - q) + occurrences(np.minimum(n[i], m)) - 1
        ok = (d != c[i]) & similar_lengths(n[i], m) & ((100 + SIMILARITY) * most >= SIMILARITY * (n[i] + m))
        at = np.flatnonzero(ok)
        for k in range(0, at.size, PAIRS):
            few = at[k : k + PAIRS]
            apart = np.bitwise_count(mine[i] ^ theirs[few]).sum(1, dtype=np.int64)
            # the overlap is half of both sizes less what differs
            few = few[(100 + SIMILARITY) * (n[i] + m[few] - apart) >= 2 * SIMILARITY * (n[i] + m[few])]
            if few.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(v[i], w[few])), pa.array(np.maximum(v[i], w[few]))], ["a", "b"])


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is their component's smallest, equal texts under one id once; rows with a null id stay. Columns are the input's."""
    keep = Scratch(docs.sparkSession)
    found = keep(near_duplicates(docs, id_col, text_col), "components")
    name = unused(docs, "gone")
    gone = keep(found.filter("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    again = keep(found.groupBy("doc_id").count().filter("doc_id IS NOT NULL AND count > 1").select(F.col("doc_id").alias(name)), "again")
    kept = picked(docs, gone, docs[id_col].cast("long") == gone[name], "left_anti")
    if again.isEmpty():
        return kept
    same = kept[id_col].cast("long") == again[name]
    twice = kept.join(again, same, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(again, same, "left_anti").unionByName(twice)

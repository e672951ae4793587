"""Conversation prefix trie by whole-sequence collapse.

Every conversation is a sequence of (role, text) turns; its prefixes are the nodes of a trie. A node is known by the chained 128-bit
digest of its turns. Identical conversations are collapsed first: one weighted sequence stands for them, with the list of those that
end there. A sequence that is a proper prefix of another goes out by an anti-join; what stays are the leaves. Then each distinct
sequence adds its weight to its prefixes, however many conversations it stands for.

What a subtree holds is summed without walking it. A sequence through a node adds its weight times the bytes from the node to its own
end. Each node counts once besides: of the sequences through it, the one with the smallest conversation owns it, and the nodes that a
sequence owns are all of its own beyond some depth, so that one number for each sequence tells them.

Conversations may share turns: one with ``base`` b begins with the first ``shared`` turns of b, as b itself has them, and goes on with
its own turns after its first ``shared``. A base is its own base. Turns are dealt by base and read as a sorted stream, so that a long
conversation takes no memory but its digests.

Null roles and texts count as empty. Turns come by number (null first), then role and text; repeated rows are turns of their own.
Rows without a conversation id are left out. A conversation without turns is a member of the root, which exists if there is any
conversation. Very long texts are digested whole. Other columns are ignored. An empty table gives no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import Scratch, releasing

WIDTH = 16
ROOT = bytes(WIDTH)
#: Ids of an end list that are joined before they move on.
ENDS = 4_096
NOTHING = hashlib.sha256(b"").hexdigest()


def chained(before: bytes, turn: bytes) -> bytes:
    """Digest of a prefix and one more turn."""
    return hashlib.blake2b(before + turn, digest_size=WIDTH).digest()


@releasing
def chain(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of turns sorted by base, base first, conversation and turn: conv_id, keys of all prefixes, and the bytes of texts from each to the end.

    A base's first turns, ``most`` at most, are held while its conversations pass by; all else that is held is one conversation's digests.
    """
    base = conv = None
    opening: list[tuple[bytes, int]] = []
    turns: list[tuple[bytes, int]] = []
    seen = shared = 0
    ids, keys, tails = [], [], []

    def done() -> None:
        at, path, sizes = ROOT, [ROOT], [0]
        for digest, size in turns:
            at = chained(at, digest)
            path.append(at)
            sizes.append(size)
        ids.append(conv)
        keys.append(path)
        tails.append(np.cumsum([0, *sizes[::-1]])[::-1])

    def out() -> pa.RecordBatch:
        got = [pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.binary())), pa.array(tails, pa.list_(pa.int64()))]
        ids.clear(), keys.clear(), tails.clear()
        return pa.RecordBatch.from_arrays(got, ["conv_id", "keys", "tail"])

    for b in batches:
        for group, own, share, digest, size in zip(*(b.column(c).to_pylist() for c in ("base", "conv_id", "shared", "digest", "bytes"))):
            if own != conv or group != base:
                if conv is not None:
                    done()
                if group != base:
                    base, opening = group, []
                conv, shared, seen = own, share, 0
                turns = opening[:shared] if own != group else []
            if own == group:
                if len(opening) < most:
                    opening.append((digest, size))
                turns.append((digest, size))
            elif seen >= shared:
                turns.append((digest, size))
            seen += 1
        if ids:
            yield out()
    if conv is not None:
        done()
        yield out()


def sequences(rows: DataFrame, base: Column | None = None, shared: Column | None = None, most: int = 1 << 30) -> DataFrame:
    """conv_id, keys, tail of each conversation of a table conv_id, turn, role, text: its prefixes' keys, the root's first, and the
    bytes of texts from each prefix's last turn to the end. base and shared, at most ``most``, are columns of conv_id."""
    own = F.col("conv_id")
    base, shared = F.lit(None) if base is None else base, F.lit(0) if shared is None else shared
    named = rows.filter("conv_id IS NOT NULL").select(
        own.cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    named = named.withColumns({"base": F.coalesce(base, own).cast("long"), "shared": shared.cast("int")})
    order = [F.col("base"), F.col("conv_id") != F.col("base"), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = named.repartition("base").sortWithinPartitions(*order)
    # a role's length keeps role and text apart
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    told = dealt.select("base", "conv_id", "shared", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    return told.mapInArrow(lambda it: chain(it, most), "conv_id long, keys array<binary>, tail array<long>")


@releasing
def packed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (key, conv_id): runs of ids as text, comma-joined."""
    key, first, held = None, 0, []
    for b in batches:
        rows = []
        for k, c in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist()):
            if k != key or len(held) == ENDS:
                if held:
                    rows.append((key, first, ",".join(held)))
                key, first, held = k, c, []
            held.append(str(c))
        if rows:
            yield runs(rows)
    if held:
        yield runs([(key, first, ",".join(held))])


def runs(rows: list[tuple[bytes, int, str]]) -> pa.RecordBatch:
    a, b, c = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.string())], ["key", "first", "ids"])


@releasing
def hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (key, first, ids): SHA-256 of each key's ids, comma-joined; one run of ids is held at a time."""
    key, state = None, None
    for b in batches:
        rows = []
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
            if k != key:
                if state is not None:
                    rows.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows])], ["end_key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["end_key", "ends_sha256"])


def end_lists(members: DataFrame) -> DataFrame:
    """end_key, ends_sha256 of rows (key, conv_id). Ranges of key and id pack a key's ids into runs, so that a key with a third of
    all rows reaches the task that must hash it in order as one row for thousands of ids."""
    dealt = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    packed = dealt.mapInArrow(packed_ends, "key binary, first long, ids string")
    return packed.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed_ends, "end_key binary, ends_sha256 string")


def trie(seqs: DataFrame) -> DataFrame:
    """The nodes of sequences(): node and parent (their digests), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Its tables stay in the shared folder."""
    keep = Scratch(seqs.sparkSession)
    seqs = keep(seqs.withColumn("key", F.element_at("keys", -1)), "sequences")

    whole = seqs.groupBy("key").agg(F.count("*").alias("weight"), F.min("conv_id").alias("owner")).withColumnRenamed("key", "k")
    weighted = keep(whole.join(seqs.select("conv_id", "keys", "tail"), F.col("owner") == F.col("conv_id")).select("k", "weight", "owner", "keys", "tail"), "weighted")
    inner = weighted.select(F.explode(F.slice("keys", 1, F.size("keys") - 1)).alias("p")).distinct()
    leaves = weighted.join(inner, weighted["k"] == inner["p"], "left_anti").select(F.col("k").alias("leaf"))

    # of each sequence: the least depth of the nodes that it owns
    owners = weighted.select("owner", F.posexplode("keys").alias("depth", "node")).groupBy("node").agg(F.min("owner").alias("o"), F.min("depth").alias("depth"))
    firsts = owners.groupBy("o").agg(F.min("depth").alias("first"))
    told = weighted.join(firsts, weighted["owner"] == firsts["o"], "left").join(leaves, weighted["k"] == leaves["leaf"], "left")
    # what a sequence doesn't own has nothing beyond its end
    told = told.select("owner", "weight", "keys", "tail", F.coalesce("first", F.size("keys")).alias("first"), F.col("leaf").isNotNull().cast("long").alias("leaf"))

    rows = told.select("*", F.posexplode("keys").alias("depth", "node"))
    at = lambda d: F.get("tail", d)
    child = (F.col("depth") < F.size("keys") - 1) & (F.col("first") <= F.col("depth") + 1)
    parts = rows.select(
        "node",
        "depth",
        F.get("keys", F.col("depth") - 1).alias("parent"),
        "owner",
        "weight",
        "leaf",
        child.cast("long").alias("child"),
        (F.col("weight") * at(F.col("depth")) - F.least(at(F.col("depth")), at(F.col("first")))).alias("saved"),
    )
    nodes = keep(
        parts.groupBy("node", "depth", "parent").agg(
            F.min("owner").alias("conv_id"),
            F.sum("weight").alias("n_convs"),
            F.sum("child").alias("n_children"),
            F.sum("leaf").alias("n_leaves"),
            F.sum("saved").alias("saved_tokens"),
        ),
        "nodes",
    )
    keep.drop(weighted)
    above = nodes.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    ends = end_lists(seqs.select("key", "conv_id"))
    out = nodes.join(above, nodes["parent"] == above["above"], "left").join(ends, nodes["node"] == ends["end_key"], "left")
    return out.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
        F.hex("node").alias("node"),
        F.hex("parent").alias("parent"),
    )

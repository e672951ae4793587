"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer every context limit.

Each whole text is encoded once for its length; the histogram has a row for each length that occurs. Suffix sums over it are taken
in two levels, within blocks of lengths and over the blocks, so that no single task orders all lengths.

Null and empty texts have length 0; very long texts are encoded whole. Repeated rows count as often as they occur. Other columns are
ignored. An empty table gives an empty histogram, totals of 0 and null quantiles.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import joined_batches, releasing, spread, text_batches, texts_of, vocabulary, written

#: Bytes of text whose distinct segments are encoded together.
TOGETHER = 12 << 20
#: Lengths of a block of the histogram.
BLOCK = 1_024


class Segments:
    """Encodes a text's stretches that follow a space, with that space; ids are little-endian 16-bit numbers.

    The pattern of these vocabularies never looks past a space that stands before anything but white space, so that each stretch
    is encoded alone, and the distinct ones of many texts at once. Texts where white space follows a space are encoded whole.
    """

    MIXED = re.compile(r" \s")

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        with open(vocabulary(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)
        self.begins = np.zeros(len(ranks), bool)  # of a segment: only its first token has a space, in front
        self.begins[[i for token, i in ranks.items() if token[:1] == b" "]] = True

    def ids(self, text: str) -> bytes:
        got = array("H", self.encoding.encode_ordinary(text))
        if sys.byteorder == "big":
            got.byteswap()
        return got.tobytes()

    def of(self, segments: pa.Array) -> pa.Array:
        """Ids of each segment with a space before it. None but the last may be empty or begin with white space."""
        joined = " " + " ".join(segments.to_numpy(zero_copy_only=False))
        ids = self.encoding.encode_to_numpy(joined).astype("<u2")
        at = np.flatnonzero(self.begins[ids])
        if at.size != len(segments):
            raise RuntimeError("a token of this vocabulary has a space within")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), at.size, [None, pa.py_buffer(np.append(at, ids.size) * 2), pa.py_buffer(ids)])

    def encode_many(self, texts: pa.Array) -> tuple[list[bytes], memoryview, np.ndarray]:
        """Of texts: the ids that stand before the rest or, of whole texts, alone; the bytes of the rest, and where each text's begin and end."""
        whole = texts.to_pylist()
        mixed = [self.MIXED.search(t) is not None for t in whole]
        heads = [(t, "", "") if x else t.partition(" ") for t, x in zip(whole, mixed)]
        first = [self.ids(h[0]) for h in heads]
        first = [x + self.ids(" ") if h[1] and not h[2] else x for x, h in zip(first, heads)]
        rest = pc.split_pattern(pa.array([h[2] or None for h in heads], pa.large_string()), " ")
        ends = np.cumsum(np.r_[0, pc.fill_null(pc.list_value_length(rest), 0).to_numpy()])
        coded = rest.flatten().dictionary_encode()
        if not len(coded):
            return first, memoryview(b""), np.zeros(len(whole) + 1, np.int64)
        words = coded.dictionary
        last = pc.index(words, pa.scalar("", words.type)).as_py()  # of texts that end in a space
        order = np.arange(len(words))
        if last >= 0:
            order = np.append(np.delete(order, last), last)
        place = np.empty_like(order)
        place[order] = np.arange(order.size)
        data, cut = spread(self.of(words.take(pa.array(order))), place[coded.indices.to_numpy()], ends)
        return first, data, cut

    def encoded(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text."""
        first, data, cut = self.encode_many(texts)
        for x, i, j in zip(first, cut.tolist(), cut[1:].tolist()):
            yield x + data[i:j]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Ids of each text, counted."""
        first, _, cut = self.encode_many(texts)
        return (np.fromiter(map(len, first), np.int64, len(first)) + np.diff(cut)) // 2


@lru_cache(maxsize=2)
def load(name: str) -> Segments:
    return Segments(name)


def lengths(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", text_col: str = "text") -> DataFrame:
    """n_tokens of all rows."""
    text_batches(docs.sparkSession)

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load(tokenizer)
        for b in joined_batches(batches, TOGETHER):
            yield pa.RecordBatch.from_arrays([pa.array(known.lengths(texts_of(b["text"])))], ["n_tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """n_tokens, n_docs with the sums from each length up and down, and truncated_tokens: the total if that length were the limit."""
    counts = counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    counts = written(counts, "lengths")  # a row for each length; it is read twice
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(
        F.col("block").alias("b"),
        F.coalesce(F.sum("bd").over(over), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("bt").over(over), F.lit(0)).alias("tokens_above"),
        F.sum("bd").over(every).alias("all_docs"),
        F.sum("bt").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    rows = counts.join(blocks, F.col("block") == F.col("b"))
    rows = rows.withColumn("docs_at_least", F.sum("n_docs").over(inside) + F.col("docs_above"))
    rows = rows.withColumn("tokens_at_least", F.sum("tokens").over(inside) + F.col("tokens_above"))
    return rows.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_docs") * F.col("n_tokens")).alias("tokens_at_most"),
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_tokens"),
    )


def truncated_total(hist: DataFrame, limit: int) -> int:
    """Tokens that are left if every text keeps at most ``limit``. The first length at or above the limit has all that it takes."""
    at = hist.filter(F.col("n_tokens") >= limit).orderBy("n_tokens").limit(1).first()
    if at is None:
        return hist.agg(F.coalesce(F.max("tokens_at_most"), F.lit(0))).first()[0]
    return at["tokens_at_most"] - at["n_docs"] * at["n_tokens"] + limit * at["docs_at_least"]


def quantile(hist: DataFrame, q: float) -> int | None:
    """The smallest length that at least the share q of all texts don't exceed."""
    total = F.max("docs_at_most").over(Window.partitionBy())
    return hist.withColumn("all", total).filter(F.col("docs_at_most") >= F.col("all") * q).agg(F.min("n_tokens")).first()[0]

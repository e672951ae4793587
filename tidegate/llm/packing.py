"""Hierarchical multi-length packing of token ids into sequences.

A window is a power of two of tokens, at most ``LONGEST``; the powers from ``SHORTEST`` up are the tiers. A document is routed by its
length: whole longest windows are cut off its front, and what is left goes to the smallest tier that holds it. Tiers are packed from
the longest to the shortest. In a tier a document opens a window of its own, and the gap behind it is filled from shorter tiers: by
the longest document that fits, again and again, and in the end by the head of the one that doesn't fit, whose tail is routed anew.
Where no shorter document is left, the document gives its own first half-window instead, which needs no filling, and its tail is routed
anew. The shortest tier is one stream, cut at its windows. So every window is full; only the last tokens of a task, fewer than a
shortest window, are left over, and these are dealt to windows of smaller powers of two. There is no padding.

The windows of a batch are dealt to step groups of about ``STEP`` tokens, longest first to the group with the fewest tokens and then
windows, so that groups carry equal tokens and each tier is spread over all of them.

Tasks pack their own rows, batch after batch of ``BATCH`` tokens, with their ids at hand: nothing is shuffled, and a lost task is
packed again from its rows alone, alike. Memory is one batch, or one document if that is longer. What a task leaves over doesn't grow
with its rows.

A text's ids are followed by the end id. Null and empty texts have the end id alone. Very long texts run through as many windows as
they need. Repeated rows and rows with a null id are packed as rows of their own. Other columns are ignored. An empty table gives no
piece. Sequence and step numbers hold the task's number in their upper bits; they follow the input's files and splits, and are the
same at every run with the same settings.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.bpe import load
from tidegate.llm.common import joined_batches, releasing, text_batches, texts_of

#: The longest and the shortest tier, and the id that ends each document.
LONGEST, SHORTEST, END = 4_096, 512, 2
#: Tokens and documents of a batch, whose documents fill each other's gaps, and tokens of a step group.
BATCH, DOCUMENTS, STEP = 1 << 20, 1 << 16, 1 << 16
#: Bytes of text whose distinct words are looked up together.
TOGETHER = 8 << 20
#: A task's own numbers stay below this.
TASK = 1 << 40


def tier(length: int, shortest: int = SHORTEST) -> int:
    """The smallest window that holds so many tokens."""
    return max(shortest, 1 << (length - 1).bit_length())


class Packer:
    """Packs lengths of numbered documents into full windows; a piece is (document, start, length)."""

    def __init__(self, longest: int = LONGEST, shortest: int = SHORTEST):
        self.longest, self.shortest = longest, shortest
        #: of each tier, (length, document, start); in order of length while windows are made
        self.waiting: dict[int, list[tuple[int, int, int]]] = {}
        size = shortest
        while size <= longest:
            self.waiting[size] = []
            size *= 2

    def route(self, document: int, start: int, length: int) -> None:
        bisect.insort(self.waiting[tier(length, self.shortest)], (length, document, start))

    def add(self, document: int, length: int) -> Iterator[list[tuple[int, int, int]]]:
        """The whole windows of a document; what is left of it waits."""
        whole = length - length % self.longest
        for at in range(0, whole, self.longest):
            yield [(document, at, self.longest)]
        if length > whole:
            self.waiting[tier(length - whole, self.shortest)].append((length - whole, document, whole))

    def below(self, size: int, most: int) -> tuple[int, int, int] | None:
        """Takes from tiers under ``size`` the longest piece of at most ``most`` tokens, else the shortest that there is."""
        shortest = None
        for t in sorted((t for t in self.waiting if t < size), reverse=True):
            pieces = self.waiting[t]
            if pieces and (i := bisect.bisect_right(pieces, most, key=lambda p: p[0])):
                return pieces.pop(i - 1)
            if pieces:
                shortest = pieces
        return shortest.pop(0) if shortest else None

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        """Full windows of all that waits but a rest of less than a shortest window."""
        for pieces in self.waiting.values():
            pieces.sort()
        for size in sorted(self.waiting, reverse=True):
            if size == self.shortest:
                break
            pieces = self.waiting[size]
            while pieces:
                length, document, start = pieces.pop()
                window, gap = [(document, start, length)], size - length
                while gap and (got := self.below(size, gap)):
                    n, d, s = got
                    window.append((d, s, min(n, gap)))
                    if n > gap:
                        self.route(d, s + gap, n - gap)
                    gap -= min(n, gap)
                if not gap:
                    yield window
                    continue
                # nothing shorter is left, and what the gap has taken is all there was: the front half is full by itself
                yield from self.halved(window, size // 2)
        stream, self.waiting[self.shortest] = self.waiting[self.shortest], []
        window, room = [], self.shortest
        for length, document, start in sorted(stream, key=lambda p: p[1:]):
            while length >= room:
                yield [*window, (document, start, room)]
                window, start, length, room = [], start + room, length - room, self.shortest
            if length:
                window.append((document, start, length))
                room -= length
        for document, start, length in window:
            self.route(document, start, length)

    def halved(self, window: list[tuple[int, int, int]], half: int) -> Iterator[list[tuple[int, int, int]]]:
        """A window of more than half its tokens: its front half, full; what comes behind waits again."""
        front, room = [], half
        for document, start, length in window:
            taken = min(length, room)
            if taken:
                front.append((document, start, taken))
            if length > taken:
                self.route(document, start + taken, length - taken)
            room -= taken
        yield front

    def rest(self) -> Iterator[list[tuple[int, int, int]]]:
        """What is left in the end, fewer tokens than a shortest window, in windows of smaller powers of two."""
        left = [(d, s, n) for n, d, s in self.waiting[self.shortest]]
        self.waiting[self.shortest] = []
        total = sum(n for *_, n in left)
        while total:
            size = 1 << (total.bit_length() - 1)
            window, room = [], size
            while room:
                d, s, n = left.pop(0)
                window.append((d, s, min(n, room)))
                if n > room:
                    left.insert(0, (d, s + room, n - room))
                room -= min(n, room)
            yield window
            total -= size


def step_groups(sizes: list[int], step: int = STEP) -> list[int]:
    """Of windows: the group of each. Longest first, each goes to the group with the fewest tokens, then windows."""
    groups = [(0, 0, g) for g in range(max(1, round(sum(sizes) / step)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        tokens, windows, g = groups[0]
        out[i] = g
        heapq.heapreplace(groups, (tokens + sizes[i], windows + 1, g))
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_id long"


def packed(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """A row for each piece: its document, place and length there, crc32 of its ids and all ids of its document; its sequence, place in
    it and the sequence's length, and the sequence's step group. With ``ids``, the piece's ids too."""
    text_batches(docs.sparkSession)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = load(tokenizer), Packer()
        first = TaskContext.get().partitionId() * TASK
        held: dict[int, tuple[int | None, np.ndarray, int]] = {}  # of documents that a window may still need: id, token ids, how many before these
        number = tokens = sequence = step = 0
        windows: list[list[tuple[int, int, int]]] = []

        def told() -> pa.RecordBatch:
            nonlocal sequence, step
            sizes = [sum(n for *_, n in w) for w in windows]
            group = step_groups(sizes)
            columns: list[list] = [[] for _ in range(9 + ids)]
            for w, size, g in zip(windows, sizes, group):
                at = 0
                for d, start, n in w:
                    own, kept, gone = held[d]
                    part = kept[start - gone : start - gone + n]
                    row = (own, start, n, zlib.crc32(part), gone + kept.size, first + sequence, at, size, first + step + g)
                    for c, v in zip(columns, (*row, part.astype(np.int32)) if ids else row):
                        c.append(v)
                    at += n
                sequence += 1
            step += max(group, default=-1) + 1
            windows.clear()
            kinds = [pa.int64()] * 9 + [pa.list_(pa.int32())] * ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * ids)

        for b in joined_batches(batches, TOGETHER):
            for own, got in zip(b["k"].to_pylist(), bpe.encode_many(texts_of(b["t"]))):
                held[number] = (own, np.append(got, np.uint32(END)).astype("<u4"), 0)
                windows += packer.add(number, got.size + 1)
                tokens, number = tokens + got.size + 1, number + 1
                if tokens >= BATCH or len(held) >= DOCUMENTS:
                    windows += packer.windows()
                    yield told()
                    tokens = 0
                    held = {d: (held[d][0], held[d][1][s - held[d][2] :].copy(), s) for pieces in packer.waiting.values() for _, d, s in sorted(pieces, key=lambda p: -p[2])}
        windows += packer.windows()
        windows += packer.rest()
        if windows:
            yield told()
        bpe.known.clear()

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, PIECES + ", ids array<int>" * ids)

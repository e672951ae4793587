"""Spelling variants: words one edit apart, found by reduced-alphabet generation.

Letters are hashed to ``SYMBOLS`` symbols, which makes the one-edit neighbourhood of a reduced word small enough to generate whole:
every deletion, every other symbol in every place, every symbol inserted anywhere, and the word itself, as two letters may share a
symbol. A neighbourhood is held against the reduced vocabulary, and what meets there is verified on the original strings. Reduced words
are told apart by a 64-bit polynomial, of which each neighbour's value follows from two prefix sums; equal values only make a candidate.

No neighbour moves between executors. One edit leaves a word's first three letters alone or its last three, so that a word is sent to
two blocks, of its reduced head and of its reduced tail: in the first the edits behind the head are made, in the second those within
the first three letters. A near pair is counted in the block of heads if the heads' letters are equal, else in the block of tails: in
exactly one. Blocks are read as a sorted stream. A block of more than ``BLOCK`` words is dealt to several parts, each with all words to
generate from and a share of them to meet, so that a part stays small and no pair is lost.

Words are counted by partial aggregates before they move. A word's form is the most frequent of its near words, if it is ten times as
frequent as the word; forms are followed to the last by pointer jumping. As frequencies grow tenfold at each step, that ends soon.

Null texts have no word. A null document id counts as empty in the key of a place's change. Very long texts are read whole; a very long
word is one word, which takes some hundred bytes for each of its letters. Repeated rows count as often as they occur. Ties between forms go to the
smaller word by code points. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import Scratch, releasing

#: Letters of a word, and the fewest that a word has.
LETTERS, LEAST = r"[A-Za-zÀ-ÿ]", 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the reduced alphabet, letters of heads and tails, words that a part of a block meets, and words of a task on average.
SYMBOLS, EDGE, BLOCK, TASK = 12, 3, 1 << 16, 50_000
#: Words whose neighbours are made together, as cells of words, places and symbols.
CELLS, TOGETHER = 1 << 20, 1 << 14
FORM = 10
#: Multiplier of the polynomial, its inverse modulo 2**64, and a factor that spreads values over the bits.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPREAD = np.uint64(0xD6E8FEB86659FD93)
FILTER_BITS = 22


def symbol_table() -> np.ndarray:
    """Of each Latin-1 code point: its symbol from 1 on. The remainder keeps the most frequent letters apart."""
    return (np.arange(256) % SYMBOLS).astype(np.uint8) + 1


def occurrences(docs: DataFrame, id_col: str, text_col: str, least: int, change: int | None) -> DataFrame:
    """word of each run of letters of at least so many, A-Z in lower case.

    With ``change``, a run loses one letter where the crc32 of ``<id>:<run>`` is divisible by it: variants to be found, planted by rule.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    rows = rows.select("i", F.translate("run", UPPER, LOWER).alias("word"))
    if change is None:
        return rows.select("word")
    h = F.crc32(F.concat("i", F.lit(":"), "word").cast("binary"))
    at = (h % F.length("word")).cast("int")
    cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
    return rows.select(F.when(h % change == 0, cut).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= least)


def vocabulary_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, change: int | None = None) -> DataFrame:
    """word, n of all words that occur twice or more."""
    return occurrences(docs, id_col, text_col, least, change).groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2")


def reduced_edge(letters: Column) -> Column:
    """Symbols of a few letters as one number."""
    table = F.array(*[F.lit(int(x)) for x in symbol_table()])
    codes = [F.get(table, F.ascii(F.substr(letters, F.lit(k + 1), F.lit(1)))) for k in range(EDGE)]
    out = codes[0]
    for c in codes[1:]:
        out = out * (SYMBOLS + 1) + c
    return out


def blocks(words: DataFrame, keep: Scratch) -> DataFrame:
    """side (0: heads, 1: tails), block, part, met, word, n: each word in two blocks, and there in every part; met in one of these."""
    tail = F.substr("word", F.length("word") - EDGE + 1, F.lit(EDGE))
    sides = F.array(F.struct(F.lit(0).alias("side"), reduced_edge(F.col("word")).alias("block")), F.struct(F.lit(1).alias("side"), reduced_edge(tail).alias("block")))
    rows = words.select("word", "n", F.inline(sides))
    # one row for each block: their number is that of symbols to the power of EDGE, twice
    sizes = rows.groupBy(F.col("side").alias("s"), F.col("block").alias("b")).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    large = keep(sizes.filter("parts > 1"), "large")
    rows = rows.join(large, (F.col("side") == F.col("s")) & (F.col("block") == F.col("b")), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return rows.select("side", "block", "part", (F.pmod(F.xxhash64("word"), "parts") == F.col("part")).alias("met"), "word", "n")


class Words:
    """Some words as Latin-1 letters, symbols and prefix sums of the polynomial of symbols."""

    def __init__(self, words: list[str]):
        self.words = words
        raw = [w.encode("latin-1") for w in words]
        self.length = np.fromiter(map(len, raw), np.int64, len(raw))
        self.width = int(self.length.max(initial=0))
        letters = np.zeros((len(raw), self.width), np.uint8)
        letters[np.arange(self.width) < self.length[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
        self.symbols = np.where(letters > 0, symbol_table()[letters], 0).astype(np.uint64)
        self.powers = np.cumprod(np.r_[np.uint64(1), np.full(self.width, BASE)], dtype=np.uint64)
        self.before = np.zeros((len(raw), self.width + 1), np.uint64)
        np.cumsum(self.symbols * self.powers[:-1], axis=1, out=self.before[:, 1:])
        self.total = self.before[:, -1]

    def neighbours(self, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word's number, value) of one-edit neighbours whose edit is at places low to high - 1, and at low = 0 or EDGE of the word itself.

        Values may repeat for a word. A reduced word of another length never has the value of this length's by more than chance.
        """
        n, total = self.length[:, None], self.total[:, None]
        places = np.arange(low, min(high, self.width + 1))
        inside = places[places < self.width]
        before, behind = self.before[:, inside], total - self.before[:, inside + 1]
        ok = inside < n
        row = np.broadcast_to(np.arange(len(self.words))[:, None], ok.shape)[ok]
        yield row, (before + behind * INVERSE)[ok]
        own = self.symbols[:, inside]
        step = self.powers[inside]
        for a in range(1, SYMBOLS + 1):
            other = ok & (own != a)
            yield np.broadcast_to(np.arange(len(self.words))[:, None], other.shape)[other], (total + (np.uint64(a) - own) * step)[other]
        before, behind = self.before[:, places], total - self.before[:, places]
        ok = places <= n
        row = np.broadcast_to(np.arange(len(self.words))[:, None], ok.shape)[ok]
        moved = before + behind * BASE
        for a in range(1, SYMBOLS + 1):
            yield row, (moved + np.uint64(a) * self.powers[places])[ok]
        yield np.arange(len(self.words)), self.total


def chunks(words: list[str]) -> Iterator[list[int]]:
    """Numbers of words of like length, so many at a time as fit the memory that is set aside."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    now: list[int] = []
    for i in order:
        if now and (len(now) == TOGETHER or (len(now) + 1) * len(words[i]) > CELLS):
            yield now
            now = []
        now.append(i)
    if now:
        yield now


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes b of a."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if n == len(b) else a[i:] == b[i + 1 :]


def near(side: int, words: list[str], counts: np.ndarray, met: np.ndarray) -> dict[str, list]:
    """word, n_near and the best near word with its count, of blocks of one side."""
    index = np.flatnonzero(met)
    values = np.empty(index.size, np.uint64)
    for some in chunks([words[i] for i in index]):
        values[some] = Words([words[index[i]] for i in some]).total
    order = np.argsort(values, kind="stable")
    values, index = values[order], index[order]
    seen = np.zeros(1 << FILTER_BITS, bool)
    shift = np.uint64(64 - FILTER_BITS)
    seen[(values * SPREAD) >> shift] = True
    low, high = (EDGE, 1 << 62) if side == 0 else (0, EDGE)
    found: dict[int, dict[int, None]] = {}
    for some in chunks(words):
        for row, value in Words([words[i] for i in some]).neighbours(low, high):
            keep = seen[(value * SPREAD) >> shift]
            row, value = row[keep], value[keep]
            first, last = np.searchsorted(values, value), np.searchsorted(values, value, "right")
            hit = np.flatnonzero(last > first)
            for r, x, y in zip(row[hit].tolist(), first[hit].tolist(), last[hit].tolist()):
                i = some[r]
                w = words[i]
                for j in index[x:y].tolist():
                    if (w[:EDGE] == words[j][:EDGE]) == (side == 0) and one_edit(w, words[j]):
                        found.setdefault(i, {})[j] = None
    out: dict[str, list] = {"word": [], "n_near": [], "best": []}
    for i, js in found.items():
        out["word"].append(words[i])
        out["n_near"].append(len(js))
        n, w = min((-int(counts[j]), words[j]) for j in js)
        out["best"].append({"less": n, "w": w})
    return out


@releasing
def near_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by side, block and part: near(), some parts of a side at a time."""
    now, held, size = None, [], 0
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.struct([("less", pa.int64()), ("w", pa.string())]))])

    def done() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        out = near(now[0], t["word"].to_pylist(), t["n"].to_numpy(), t["met"].to_numpy())
        return pa.RecordBatch.from_pydict(out, schema)

    for b in batches:
        side, block, part = (b.column(c).to_numpy() for c in ("side", "block", "part"))
        cut = np.flatnonzero((side[1:] != side[:-1]) | (block[1:] != block[:-1]) | (part[1:] != part[:-1])) + 1 if len(side) else []
        for i, j in zip([0, *cut], [*cut, len(side)]):
            key = (side[i], block[i], part[i])
            # parts of one block stay apart: their words are the same
            if now is not None and key != now and (size >= TOGETHER or key[0] != now[0] or key[2] or now[2]):
                yield done()
                held, size = [], 0
            now = key
            held.append(b.slice(i, j - i))
            size += j - i
    if held:
        yield done()


def grouped(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n). Its tables stay in the shared folder."""
    keep = Scratch(words.sparkSession)
    words = keep(words, "words")
    # a word takes thousands of operations: tasks are cut by words, not by bytes
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * words.count() // TASK))
    dealt = blocks(words, keep).repartition(tasks, "side", "block", "part").sortWithinPartitions("side", "block", "part")
    pairs = dealt.mapInArrow(near_pass, "word string, n_near long, best struct<less: long, w: string>")
    pairs = pairs.groupBy(F.col("word").alias("of")).agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    told = words.join(pairs, words["word"] == pairs["of"], "left")
    form_n = F.when(-F.col("best.less") >= FORM * F.col("n"), -F.col("best.less"))
    told = told.select("word", F.when(form_n.isNotNull(), F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n"))
    told = keep(told, "forms")
    up = last_forms(told.filter("form IS NOT NULL").select("word", "form"), keep)
    out = told.join(up, told["word"] == up["of"], "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def last_forms(forms: DataFrame, keep: Scratch) -> DataFrame:
    """of, root: where each word's forms end, by pointer jumping."""
    now = keep(forms.select(F.col("word").alias("of"), F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("of").alias("at"), F.col("root").alias("next"))
        new = keep(now.join(far, now["root"] == far["at"], "left").select("of", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        keep.drop(now)
        if new.filter("moved").isEmpty():
            return new.drop("moved")
        now = new


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, change: int | None = None) -> DataFrame:
    """grouped() of the words of all texts."""
    return grouped(vocabulary_of(docs, id_col, text_col, least, change))

"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

A merge list decides whether a boundary between two symbols survives by looking a bounded number of symbols to the right of it
(``sufficient_lookahead``). The transducer therefore keeps a window of a few times that size: whatever ends at least that many
symbols before the window's end is final and is emitted, whatever the rest of the text says; a word's end makes the rest final. What
it holds besides the word doesn't depend on the word's length. As a word's tokens depend on nothing else, each distinct word of some
texts (2 MB at a time) runs through it once, many words' windows side by side as arrays; most words end within their first window. A
bounded number of words is remembered between texts. Ids are decoded by a byte-to-text state machine, stretch by stretch: a stretch
may end within a character.

Null texts count as empty; empty texts give no ids and an empty text. Very long texts and words are read whole; what a text takes
besides itself are its ids. Repeated rows give repeated results; further columns of the input are ignored. An empty table gives an
empty result. A byte sequence that isn't UTF-8 decodes to U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from tidegate.llm.common import distinct_pieces, joined_batches, releasing, spread, text_batches, texts_of, vocabulary

NEVER = 1 << 60
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
#: Spaces that the pattern or str.split knows besides the six ASCII ones, and those that only one of them knows.
OTHER_SPACES = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Pretokens that a Python worker remembers, and the longest of them; all are forgotten when there are more.
REMEMBERED, LONGEST = 150_000, 64
#: Bytes of text whose distinct words are looked up together; ids that are decoded at a time.
TOGETHER, STRETCH = 2 << 20, 1 << 15
#: Words whose windows are merged side by side, and the most symbols of these.
SIDE, CELLS = 1 << 12, 1 << 18


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def sufficient_lookahead(rules: list[tuple[str, str]], length=len) -> int:
    """Symbols to the right of a boundary that decide whether any rule merges across it.

    Rule (a, b) merges across a boundary if b stands right of it, whole, when the rule's turn comes. Whether b's right end was
    crossed before is decided by an earlier rule whose left part is a suffix of b, and so on with ever earlier rules. The longest
    such chain bounds the lookahead.
    """
    reach: dict[str, int] = {}
    most = 0
    for a, b in rules:
        far = length(b) + max((reach.get(b[i:], 0) for i in range(len(b))), default=0)
        reach[a] = max(reach.get(a, 0), far)
        most = max(most, far)
    return most


class Bpe:
    """A tokenizers JSON file of a BPE model with byte-level symbols and an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        # Beyond Latin letters, the library's own tables say what is a letter, a composed or a lower-case character.
        self.split = Split(Regex(steps[0]["pattern"]["Regex"]), "removed", invert=True)
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.pretoken = regex.compile(steps[0]["pattern"]["Regex"])
        symbols = byte_symbols()
        self.bytes_of = {c: b for b, c in enumerate(symbols)}
        self.inner, self.last = np.array([self.ids[c] for c in symbols]), np.array([self.ids[c + self.suffix] for c in symbols])
        rules = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # pair of ids, as one number -> rank and the id of the merged token, as one number
        merges = {self.ids[a] << 20 | self.ids[b]: rank << 20 | self.ids[a + b] for rank, (a, b) in enumerate(rules)}
        keys = np.array(sorted(merges))
        self.pair_keys, self.pair_values = np.append(keys, NEVER), np.append([merges[k] for k in keys.tolist()], NEVER)
        self.lookahead = sufficient_lookahead(rules, lambda t: len(t.removesuffix(self.suffix)))
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.ids)
        self.window = self.lookahead + 4 * self.longest
        self.known: dict[str, bytes] = {}
        everything = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.decimals = pa.array([f"{i} ".encode() for i in range(len(everything))], pa.large_binary())
        #: symbols that each token covers
        self.sizes = np.array([len(t.removesuffix(self.suffix)) for t in everything])
        self.names = pa.array([f"{t} ".encode() for t in everything], pa.large_binary())

    def transduce(self, symbols: Iterable[int]) -> Iterator[int]:
        """Token ids of one word's symbols, each as soon as no later symbol can change it."""
        window: list[int] = []
        for s in symbols:
            if len(window) == self.window:
                ids, emit, used = self.emitted(np.array([[*window, -1]]), np.array([self.window]), np.array([False]))
                yield from ids[emit].tolist()
                del window[: int(used[0])]
            window.append(s)
        if window:
            ids, emit, _ = self.emitted(np.array([[*window, -1]]), np.array([len(window)]), np.array([True]))
            yield from ids[emit].tolist()

    def emitted(self, ids: np.ndarray, n: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of windows, rows of n symbols padded with -1: their tokens, those that are final, and the symbols that these cover.

        Where a word doesn't end with its window, what ends ``lookahead`` symbols before the window's end is final.
        """
        ids, n = self.merge(ids, n)
        counts = np.arange(ids.shape[1]) < n[:, None]
        cover = np.where(counts, self.sizes[ids], 0).cumsum(1)
        emit = counts & (final[:, None] | (cover <= self.window - self.lookahead))
        return ids, emit, np.where(emit, cover, 0).max(1, initial=0)

    def pretokens(self, word: str) -> list[str]:
        """Of a text without spaces: runs of letters, single digits, runs of other characters, contractions."""
        if not word.isascii() and BEYOND_LATIN.search(word):
            return [p for p, _ in self.split.pre_tokenize_str(word)]
        if word.isalpha():
            return [word]
        if word[-1] in ".,|" and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.pretoken.findall(word)

    def symbols(self, pretoken: str) -> list[int]:
        raw = np.frombuffer(pretoken.encode(), np.uint8)
        return [*self.inner[raw[:-1]].tolist(), int(self.last[raw[-1]])]

    def transduce_many(self, pretokens: list[str]) -> list[bytes]:
        """What ``transduce`` gives for many words, window after window: ids of each as little-endian 32-bit numbers."""
        raw = [p.encode() for p in pretokens]
        ends = np.cumsum([len(x) for x in raw])
        at, flat = np.r_[0, ends[:-1]], np.frombuffer(b"".join(raw), np.uint8)
        out, todo = [b""] * len(raw), np.arange(len(raw))
        while todo.size:
            n = np.minimum(ends[todo] - at[todo], self.window)
            final = at[todo] + n == ends[todo]
            place = np.arange(int(n.max()) + 1)
            inside = place < n[:, None]
            ids = np.full(inside.shape, -1, np.int64)
            ids[inside] = self.inner[flat[(at[todo][:, None] + place)[inside]]]
            ids[final, n[final] - 1] = self.last[flat[ends[todo][final] - 1]]
            ids, emit, used = self.emitted(ids, n, final)
            data, cut = ids[emit].astype("<u4").tobytes(), (4 * emit.sum(1).cumsum()).tolist()
            for k, x, y in zip(todo.tolist(), [0, *cut], cut):
                out[k] += data[x:y]
            at[todo] += used
            todo = todo[~final]
        return out

    def merge(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merge list applied to rows of symbols: in each the rule of lowest rank first, leftmost first, until none is left."""
        n = n.copy()
        ranks = self.ranks(ids[:, :-1], ids[:, 1:])
        todo, at = np.arange(len(ids)), np.arange(ids.shape[1] - 1)
        while todo.size:
            r = ranks[todo]
            j = r.argmin(1)
            best = r[np.arange(todo.size), j]
            live = best < NEVER
            todo, j, best, r = todo[live], j[live], best[live], r[live]
            if not todo.size:
                break
            row = ids[todo]
            row[np.arange(todo.size), j] = best & 0xFFFFF
            row[:, 1:-1] = np.where(at[1:] > j[:, None], row[:, 2:], row[:, 1:-1])
            r[:, :-1] = np.where(at[:-1] >= j[:, None], r[:, 1:], r[:, :-1])
            k = np.arange(todo.size)
            r[k, j] = self.ranks(row[k, j], row[k, j + 1])
            before = np.maximum(j - 1, 0)
            r[k, before] = np.where(j > 0, self.ranks(row[k, before], row[k, before + 1]), r[k, before])
            ids[todo], ranks[todo] = row, r
            n[todo] -= 1
        return ids, n

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of ids: rank and merged id as one number, or NEVER."""
        key = (a << 20) | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where((a >= 0) & (b >= 0) & (self.pair_keys[at] == key), self.pair_values[at], NEVER)

    def learn(self, pretokens: set[str]) -> dict[str, bytes]:
        """Ids of pretokens, as little-endian 32-bit numbers; short ones are remembered."""
        if len(self.known) + len(pretokens) > REMEMBERED:
            self.known.clear()
        got: dict[str, bytes] = {}
        side: list[str] = []
        for p in sorted(pretokens, key=len):  # words of like length make narrow tables
            if side and (len(side) == SIDE or (len(side) + 1) * min(4 * len(p), self.window) > CELLS):
                got |= zip(side, self.transduce_many(side))
                side = []
            side.append(p)
        got |= zip(side, self.transduce_many(side))
        if len(got) <= REMEMBERED:
            self.known |= {p: x for p, x in got.items() if len(p) <= LONGEST}
        return got

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of texts without spaces."""
        parts = [self.pretokens(w) if w else [] for w in words]
        known = self.known
        unseen = {p for x in parts for p in x if p not in known}
        now = {p: known[p] for x in parts for p in x if p in known} if len(known) + len(unseen) > REMEMBERED else known
        new = self.learn(unseen)
        get = lambda p: new[p] if p in new else now[p]
        return [get(x[0]) if len(x) == 1 else b"".join(map(get, x)) for x in parts]

    def normal(self, text: str) -> str:
        """Composed, in lower case character by character (no final sigma)."""
        if text.isascii():
            return text.lower()
        if BEYOND_LATIN.search(text):
            return self.normalizer.normalize_str(text)
        return (text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)).lower()

    def parts(self, text: str) -> list[list[str] | int]:
        """Lists of the words between special tokens, and the ids of those."""
        out: list[list[str] | int] = []
        for k, part in enumerate(self.special.split(text) if "<|" in text else [text]):
            if k % 2:
                out.append(self.specials[part])
                continue
            part = self.normal(part)
            # str.split takes U+001C to U+001F for spaces, the pattern takes them for symbols
            odd = any(c in part for c in "\x1c\x1d\x1e\x1f")
            out.append([w for w in regex.split(r"[^\S\x1c-\x1f]+", part) if w] if odd else part.split())
        return out

    def plain(self, text: str) -> bool:
        """Has no special token and no spaces but the six ASCII ones."""
        if "<|" in text and self.special.search(text):
            return False
        if text.isascii():
            return not any(c in text for c in "\x1c\x1d\x1e\x1f")
        return OTHER_SPACES.search(text) is None

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text, word after word."""
        out = []
        for part in self.parts(text or ""):
            out += [np.array([part], "<u4").tobytes()] if isinstance(part, int) else self.words(part)
        return np.frombuffer(b"".join(out), "<u4")

    def encode_many(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; each distinct word of them is looked up once."""
        whole = texts.to_pylist()
        plain = [self.plain(t) for t in whole]
        split = pc.ascii_split_whitespace(pa.array([self.normal(t) if ok else "" for t, ok in zip(whole, plain)], pa.large_string()))
        words, numbers, offsets = distinct_pieces(split)
        data, cut = spread(self.words(words), numbers, offsets)
        for t, ok, i, j in zip(whole, plain, cut.tolist(), cut[1:].tolist()):
            yield np.frombuffer(data[i:j], "<u4") if ok else self.encode(t)

    def stretches(self, table: pa.Array, ids: np.ndarray) -> Iterator[bytes]:
        """Bytes of the ids' entries in a table, each with a space after it but for the last one, some ids at a time."""
        for k in range(0, ids.size, STRETCH):
            part = ids[k : k + STRETCH]
            data, ends = spread(table, part, np.array([0, part.size]))
            yield bytes(data[: int(ends[1]) - (k + part.size == ids.size)])

    def decode_tokens(self, ids: np.ndarray) -> Iterator[str]:
        """Token texts joined by one space, as the library gives for a file without a decoder, through the state machine."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for data in self.stretches(self.names, ids):
            yield machine.decode(data)
        yield machine.decode(b"", True)

    def decode_text(self, ids: Iterable[int]) -> Iterator[str]:
        """Readable text, piece by piece: bytes go through an incremental UTF-8 state machine, word ends become spaces."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            token = self.tokens[i]
            if token in self.specials:
                yield machine.decode(b"", True) + token
                machine.reset()
                continue
            body = token.removesuffix(self.suffix)
            yield machine.decode(bytes(self.bytes_of[c] for c in body)) + (" " if body != token else "")
        yield machine.decode(b"", True)


@lru_cache(maxsize=4)
def load(name: str) -> Bpe:
    """Once for each Python worker; the vocabulary is of fixed size."""
    return Bpe(vocabulary(name))


def digest(parts: Iterable[bytes]) -> str:
    out = hashlib.sha256()
    for x in parts:
        out.update(x)
    return out.hexdigest()


def encode_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, its number of tokens, the SHA-256 of its ids in decimal joined by spaces, and of the text decoded from these ids.

    Rows stay where they are read: there is no shuffle.
    """
    text_batches(docs.sparkSession)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for b in joined_batches(batches, TOGETHER):
            rows = []
            for ids in bpe.encode_many(texts_of(b["t"])):
                rows.append((ids.size, digest(bpe.stretches(bpe.decimals, ids)), digest(x.encode() for x in bpe.decode_tokens(ids))))
            n, x, y = zip(*rows) if rows else ((), (), ())
            key = b["k"].combine_chunks()
            yield pa.RecordBatch.from_arrays([key, pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.known.clear()

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def encode_ids(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id with its whole list of token ids."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(tokenizer)
        for t in texts:
            yield t.map(lambda x: bpe.encode(x).astype(np.int32))

    return docs.select(id_col, ids(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))


def decode_ids(rows: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Each row's id with the text that its ids stand for; null ids give an empty text."""

    @F.pandas_udf("string")
    def text(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(tokenizer)
        for s in ids:
            yield s.map(lambda x: "".join(bpe.decode_text(x if x is not None else [])))

    return rows.select(id_col, text(F.col(ids_col)).alias("text"))

"""Token ids in training order: a keyed permutation gives every sequence its slot, shards of fixed stride hold the slots in order.

Texts are encoded, an end token after each, and the ids of a task's texts run through sequences of fixed length; only a task's last
one is padded. The number of all sequences must be known before the first gets its slot. Encoding runs twice for that, as keeping all
ids from a first run beside the shuffle and the shards would take more disk than encoding takes time: the first pass counts each
task's sequences, so that the second knows the number of its first one, and raises if it makes more or fewer. A Feistel network
with a key permutes the numbers; cycle-walking keeps it within their range. Slots are dealt by range to a bounded number of tasks,
each of which writes its consecutive shards: files of records of equal size, in order of slots, so that a reader that stopped goes on
at any record by its place alone. A file appears under its name when it is whole.

A record is its slot, first document, the ids that count (16 bytes, little-endian) and the ids. Null and empty texts give their
end token; very long texts run through as many sequences as they need. Repeated rows are written as often as they occur; a null
document id is written as -1. Further columns are ignored. An empty table writes no shard. The order depends on how Spark splits the
input, which for a table of files is the same at every run with the same settings.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.common import fresh_path, joined_batches, releasing, text_batches, texts_of, written
from tidegate.llm.token_counts import TOGETHER, load

SEQUENCE = 512
#: Sequences of a shard.
SHARD = 4_096
#: Tasks that write shards, at most; each writes a run of them.
WRITERS = 10_000
#: Slot, first document, ids that count.
HEAD = "<qqi"
HEAD_BYTES = struct.calcsize(HEAD)
ROUNDS = 4


def stride(length: int = SEQUENCE) -> int:
    return HEAD_BYTES + 2 * length


def permuted(numbers: np.ndarray, size: int, key: str) -> np.ndarray:
    """Each number's image under a permutation of 0 to size - 1."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.frombuffer(hashlib.sha256(key.encode()).digest(), "<u8")[:ROUNDS]

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(32)
            f *= np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f ^ (f >> np.uint64(29))) & mask)
        return (left << np.uint64(half)) | right

    out = network(numbers.astype(np.uint64))
    while (outside := out >= size).any():
        out[outside] = network(out[outside])
    return out.astype(np.int64)


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def counted(rows: DataFrame, tokenizer: str, length: int) -> list[tuple[int, int]]:
    """(task, its sequences): two numbers for each task come to the driver."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = load(tokenizer), 0
        for b in joined_batches(batches, TOGETHER):
            n += int(known.lengths(texts_of(b["text"])).sum()) + b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([-(-n // length)], pa.int64())], ["task", "n"])

    return sorted(map(tuple, rows.mapInArrow(run, "task int, n long").collect()))


def sequences(rows: DataFrame, first: dict[int, int], size: int, tokenizer: str, length: int, key: str) -> DataFrame:
    """slot, record of each sequence."""
    shared = rows.sparkSession.sparkContext.broadcast(first)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load(tokenizer)
        end = struct.pack("<H", known.end)
        task = TaskContext.get().partitionId()
        number, width = shared.value.get(task, 0), 2 * length
        stop = shared.value.get(task + 1, size)
        rest, owner = b"", -1

        def packed(chunks: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            nonlocal number
            if number + len(chunks) > stop:
                raise RuntimeError("the input was split otherwise than when its sequences were counted")
            slots = permuted(np.arange(number, number + len(chunks)), size, key)
            number += len(chunks)
            return pa.RecordBatch.from_arrays([pa.array(slots), pa.array([struct.pack(HEAD, s, d, n) + x for s, (d, n, x) in zip(slots.tolist(), chunks)], pa.binary())], ["slot", "record"])

        for b in joined_batches(batches, TOGETHER):
            out = []
            for doc, got in zip(b["doc_id"].to_pylist(), known.encoded(texts_of(b["text"]))):
                if not rest:
                    owner = doc
                held = rest + got + end
                cut = len(held) - len(held) % width
                for i in range(0, cut, width):
                    out.append((owner if i == 0 else doc, length, held[i : i + width]))
                if cut:
                    owner = doc
                rest = held[cut:]
            if out:
                yield packed(out)
        if rest:
            yield packed([(owner, len(rest) // 2, rest.ljust(width, b"\0"))])
        if number != stop:
            raise RuntimeError("the input was split otherwise than when its sequences were counted")

    return rows.mapInArrow(run, "slot long, record binary")


def write(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.tiktoken", key: str = "order", length: int = SEQUENCE, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shard-<number>.bin files below path; returns shard, first_slot, n, sha256 of each."""
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(path)
    system.create_dir(folder, recursive=True)  # there even if no shard is
    rows = rows_of(docs, id_col, text_col)
    counts = counted(rows, tokenizer, length)
    first, size = {}, 0
    for task, n in counts:
        first[task] = size
        size += n
    for task in range(max(first, default=-1), -1, -1):
        first.setdefault(task, first.get(task + 1, size))
    shards = -(-size // shard) or 1
    run = -(-shards // WRITERS)  # shards of a task
    dealt = sequences(rows, first, size, tokenizer, length, key)
    dealt = dealt.repartitionById(-(-shards // run), F.floor(F.col("slot") / (shard * run)).cast("int")).sortWithinPartitions("slot")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        now, out, told = None, None, []

        def done() -> None:
            out.close()
            system.move(draft, f"{folder}/shard-{now:08d}.bin")
            told.append((now, now * shard, n, digest.hexdigest()))

        for b in batches:
            numbers = b.column("slot").to_numpy() // shard
            cut = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)] if len(numbers) else [0]
            for i, j in zip(cut, cut[1:]):
                if numbers[i] != now:
                    if out is not None:
                        done()
                    now, n, digest = int(numbers[i]), 0, hashlib.sha256()
                    draft = f"{folder}/draft-{now:08d}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(draft)
                data = b"".join(b.column("record").slice(i, j - i).to_pylist())
                out.write(data)
                digest.update(data)
                n += j - i
        if out is not None:
            done()
        columns = zip(*told) if told else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["shard", "first_slot", "n", "sha256"])

    return dealt.mapInArrow(store, "shard int, first_slot long, n long, sha256 string")


def read(spark: SparkSession, path: str, length: int = SEQUENCE, ids: bool = False) -> DataFrame:
    """slot, doc_id of the first document, n_tokens, crc32 of the ids that count, of every record; the ids too if asked."""
    width = stride(length)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                rows = []
                for i in range(0, len(data), width):
                    slot, doc, n = struct.unpack_from(HEAD, data, i)
                    body = data[i + HEAD_BYTES : i + HEAD_BYTES + 2 * n]
                    rows.append((slot, doc, n, zlib.crc32(body), np.frombuffer(body, "<u2").astype(np.int32) if ids else None))
                yield pd.DataFrame(rows, columns=["slot", "doc_id", "n_tokens", "crc32", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(path)
    return files.select("content").mapInPandas(parse, "slot long, doc_id long, n_tokens long, crc32 long, ids array<int>")


def read_from(path: str, slot: int, length: int = SEQUENCE, shard: int = SHARD) -> Iterator[tuple[int, np.ndarray]]:
    """Resumes at a slot: (slot, ids) of it and all after it, one file at a time, each read from the record's place."""
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(path)
    width, number = stride(length), slot // shard
    while system.get_file_info(name := f"{folder}/shard-{number:08d}.bin").type == fs.FileType.File:
        with system.open_input_file(name) as f:
            f.seek(max(0, slot - number * shard) * width)
            while len(data := f.read(width)) == width:
                s, _, n = struct.unpack_from(HEAD, data)
                yield s, np.frombuffer(data, "<u2", n, HEAD_BYTES)
        number += 1


def materialised(docs: DataFrame) -> DataFrame:
    """Writes the table's texts to shards in the shared folder and reads every record back, with its shard."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    written(write(docs, path), "shards")
    return read(spark, path).drop("ids").withColumn("shard", F.floor(F.col("slot") / SHARD).cast("int"))

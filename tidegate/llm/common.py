"""What the text operators share: tables in the shared folder, words of Arrow texts, and the folder of public vocabularies."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidegate.sources.shared import Scratch, fresh_path, shared_folder, written  # noqa: F401  the operators take them from here

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
#: Rows of an Arrow batch that goes to Python; texts are long.
ARROW_ROWS = 256
#: Longer words are hashed one by one.
LONG_WORD = 64
SPACE = np.isin(np.arange(256), np.frombuffer(SPACES.encode(), np.uint8))
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
#: Of a word's last eight bytes, those that count.
PART = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)


def unused(df: DataFrame, name: str) -> str:
    """A column name like this that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small; sessions that chose a size keep it."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def release() -> None:
    """Gives freed memory back to the system: Python workers outlive their tasks, and an executor's workers share its memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def releasing(task: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's generator that releases memory at its end."""

    @wraps(task)
    def run(*given):
        try:
            yield from task(*given)
        finally:
            release()

    return run


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, as installed on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def joined_batches(batches: Iterator[pa.RecordBatch], least_bytes: int) -> Iterator[pa.Table]:
    """The same rows in tables of about so many bytes: what a table's words have in common is worked out once for each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= least_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Texts as one array with 64-bit offsets, nulls as empty."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], pa.string())
    return pc.fill_null(whole.cast(pa.large_string()), "")


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words with A-Z in lower case, one after the other, and where each text's begin and end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    offsets = offsets - low
    if high == low:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[low:high]
    data = np.zeros(raw.size + 8, np.uint8)
    np.take(LOWER, raw, out=data[:-8])
    word = ~SPACE[raw]
    before, after = np.empty_like(word), np.empty_like(word)
    before[0] = after[-1] = False
    before[1:], after[:-1] = word[:-1], word[1:]
    inside = offsets[(offsets > 0) & (offsets < raw.size)]
    before[inside] = False
    after[inside - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    n = ends - starts
    eight = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (raw.size + 1,), (1,))
    h = n.astype(np.uint64) * ODD
    todo, at = np.arange(n.size), starts
    left = n
    while todo.size:
        x = (h[todo] ^ (eight[at] & PART[np.minimum(left, 8)])) * ODD
        h[todo] = x ^ (x >> np.uint64(32))
        more = (left > 8) & (n[todo] <= LONG_WORD)
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(n > LONG_WORD):
        import xxhash

        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h, np.searchsorted(starts, offsets)


def distinct_pieces(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of lists of texts: the distinct texts, the number of each in order, and where each list's begin and end."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), offsets - offsets[0]


def spread(pieces: list[bytes] | pa.Array, numbers: np.ndarray, offsets: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The pieces with these numbers, one after the other, and where each list's bytes begin and end."""
    if not numbers.size:
        return memoryview(b""), np.zeros(offsets.size, np.int64)
    whole = pieces if isinstance(pieces, pa.Array) else pa.array(pieces, pa.large_binary())
    taken = whole.take(pa.array(numbers))
    ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]
    return memoryview(taken.buffers()[2]), ends[offsets]

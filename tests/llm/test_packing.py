"""Packing: every id once, full windows, step groups, against ids of the library itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidegate.llm import packing
from tidegate.llm import queries as text_queries
from tidegate.llm.common import vocabulary

DATA = "/root/testdata/sf0.001"


def library_ids(texts):
    known = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    known.no_truncation(), known.no_padding()
    return [np.array([*e.ids, 2], "<u4") for e in known.encode_batch(texts, add_special_tokens=False)]


def check(rows, ids):
    """Each document's ids lie in exactly one piece each; sequences have no gap and are powers of two."""
    by_doc, by_sequence, step = defaultdict(list), defaultdict(list), {}
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert step.setdefault(r["sequence_id"], r["step_id"]) == r["step_id"]
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == ids[d].size
            assert r["ids_crc32"] == zlib.crc32(ids[d][at : at + r["length"]].tobytes())
            if "ids" in r:
                assert r["ids"] == ids[d][at : at + r["length"]].tolist()
            at += r["length"]
        assert at == ids[d].size
    small = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == pieces[0]["sequence_length"] <= 4096 and at & (at - 1) == 0
        small += at < packing.SHORTEST
    tokens = defaultdict(int)
    for s, pieces in by_sequence.items():
        tokens[step[s]] += pieces[0]["sequence_length"]
    return small, tokens


def test_registered_query_equals_the_library(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    ids = dict(zip([r["doc_id"] for r in docs], library_ids([r["text"] or "" for r in docs])))
    got = text_queries.queries()["op13_packing"](spark, DATA)
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = [r.asDict() for r in got.collect()]
    small, _ = check(rows, ids)
    tasks = len({r["sequence_id"] // packing.TASK for r in rows})
    assert small <= 9 * tasks
    assert sorted(map(str, rows)) == sorted(str(r.asDict()) for r in text_queries.queries()["op13_packing"](spark, DATA).collect())


@pytest.mark.parametrize("parts, batch", [(1, 1 << 20), (3, 5_000), (7, 100)])
def test_odd_rows(spark, parts, batch, monkeypatch):
    monkeypatch.setattr(packing, "BATCH", batch)  # forked workers see it
    long = " ".join(f"word{i % 977}" for i in range(9_000))
    texts = [None, "", " ", long, long, "é" * 3000, "x", "<|endoftext|> y", *[" ".join(["w"] * n) for n in (510, 511, 512, 513, 4094, 4095, 4096)], *["a b"] * 700]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string, offset string").repartition(parts)
    got = [r.asDict() for r in packing.packed(df, ids=True).collect()]
    check(got, dict(enumerate(library_ids([t or "" for t in texts]))))
    assert packing.packed(df.limit(0)).count() == 0
    same = packing.packed(spark.createDataFrame([(None, "a b c", "", "")] * 3, df.schema).coalesce(1)).collect()
    assert [r["doc_id"] for r in same].count(None) == len(same) and sum(r["length"] for r in same) == 12


def test_windows_are_full_and_long_gaps_come_from_shorter_tiers():
    rng = random.Random(3)
    for lengths in ([4000] * 50, [600] * 9, [1], [511], [rng.randrange(1, 9000) for _ in range(500)], [2049] * 7 + [3] * 5, [1025, 1025], []):
        packer, windows = packing.Packer(), []
        for d, n in enumerate(lengths):
            windows += packer.add(d, n)
            if d % 100 == 99:
                windows += packer.windows()
        windows += packer.windows()
        assert all(sum(n for *_, n in w) in (512, 1024, 2048, 4096) for w in windows)
        rest = list(packer.rest())
        assert len(rest) <= 9 and sum(n for w in windows + rest for *_, n in w) == sum(lengths)
        seen = defaultdict(list)
        for w in windows + rest:
            for d, s, n in w:
                seen[d].append((s, n))
        for d, n in enumerate(lengths):
            at = 0
            for s, k in sorted(seen[d]):
                assert s == at
                at += k
            assert at == n
    packer = packing.Packer()
    assert not [*packer.add(0, 3000), *packer.add(1, 1000), *packer.add(2, 96)]
    assert list(packer.windows()) == [[(0, 0, 3000), (1, 0, 1000), (2, 0, 96)]]


def test_step_groups_are_balanced():
    rng = random.Random(5)
    sizes = [rng.choice([512, 1024, 2048, 4096]) for _ in range(900)]
    group, total = packing.step_groups(sizes), defaultdict(int)
    for s, g in zip(sizes, group):
        total[g] += s
    assert len(total) == round(sum(sizes) / packing.STEP) and max(total.values()) - min(total.values()) <= 512
    longest = [sum(1 for s, g in zip(sizes, group) if g == k and s == 4096) for k in total]
    assert max(longest) - min(longest) <= 1

"""No link is lost: contained texts, long lists behind short ones, against all pairs."""

import random

import pytest

from tests.llm.test_text_operators import plain_groups
from tidegate.llm import ngram_join


def found(spark, rows, parts=3):
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_links_by_later_places_of_long_lists(spark):
    rng = random.Random(4)
    common = words(rng, 78)
    rows = [(1, [*common, "x", *words(rng, 25)]), (2, [*common, "x"])] + [(100 + i, [*words(rng, 1), *common]) for i in range(40)]
    rows = [(i, " ".join(w)) for i, w in rows]
    want = plain_groups(rows)
    assert want[1][1] == want[2][1] == want[120][1] == 1
    assert found(spark, rows) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_contained_families_equal_all_pairs(spark, seed):
    """Families of a common part that 17 or more texts share, with contained and lengthened texts around the threshold."""
    rng, rows = random.Random(seed), []
    for family in range(8):
        common, start = words(rng, rng.randrange(30, 200)), 1000 * family
        many = rng.randrange(17, 40)
        for i in range(many):
            before, after = rng.choice([(0, 1), (1, 0), (1, 1), (2, 3)]), rng.random()
            rows.append((start + i, [*words(rng, before[0]), *common, *words(rng, before[1])]))
            if after < 0.3:
                extra = int(len(common) / 3 * rng.uniform(0.8, 1.2))
                rows.append((start + 500 + i, [*common, *rows[-1][1][-1:], *words(rng, extra)]))
            elif after < 0.5:
                rows.append((start + 700 + i, common[: int(len(common) * rng.uniform(0.7, 0.85))]))
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in rows]
    assert found(spark, rows) == plain_groups(rows)

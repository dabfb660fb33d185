"""Comparisons in blocks against plain loops; pairs are made where they are used, and never shuffled."""

import numpy as np
import pytest

from tonegrid.functions import similarity as sim


def plain(a, b):
    """Similarity of all pairs of two lists of (id, pos, word), as a join on pos has it."""
    sums: dict = {}
    for x, p, v in a:
        for y, q, w in b:
            if None not in (x, y, p, q, v, w) and p == q:
                n, d = sums.get((x, y), (0, 0))
                sums[x, y] = n + 1, d + (v ^ w).bit_count()
    return {k: 1 - d / (n * 32) for k, (n, d) in sums.items()}


def above_pairs(df):
    """The plan's lines above the node that makes pairs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan
    return plan[: plan.index("CartesianProduct")]


def listed(seed, n=30, long=300):
    """Recordings of uneven lengths: gaps, repeated and negative positions, nulls, one far longer than a block of positions."""
    rng = np.random.default_rng(seed)
    rows = [(f"r{i:02}", int(p), int(w)) for i in range(n) for p, w in zip(rng.integers(-3, 12, i % 9), rng.integers(0, 1 << 32, 9))]
    rows += [(f"r{i:02}", p, int(w)) for i in (3, 4) for p, w in enumerate(rng.integers(0, 1 << 32, long))]
    return [*rows, (None, 1, 5), ("r01", None, 5), ("r01", 1, None), ("far", 1 << 40, 0), ("all", 1 << 40, (1 << 32) - 1)]


SCHEMA = "rec string, pos long, word long"


@pytest.mark.parametrize("recordings", [3, 1000])
def test_similarity_join_shuffles_no_pairs(spark, recordings):
    rows = listed(1)
    a, df = [r for r in rows if r[0] and r[0][-1] in "05r"], spark.createDataFrame(rows, SCHEMA)
    want = plain(a, rows)
    found = sim.similarity_join(spark.createDataFrame(a, SCHEMA), df, "rec", "rec", recordings=recordings)
    got = found.collect()
    assert len(got) == len(want) and {(r["a_id"], r["b_id"]): r["similarity"] for r in got} == want
    assert "Exchange" not in above_pairs(found)
    with pytest.raises(ValueError):
        sim.similarity_join(df, df, "rec", "rec", top=0)


@pytest.mark.parametrize("recordings", [3, 1000])
def test_the_best_of_each_block_hold_the_best_of_all(spark, recordings):
    rng = np.random.default_rng(2)
    rows = [(i, p, int(w)) for i in range(60) for p, w in enumerate(rng.integers(0, 4, 3))]  # many ties
    df = spark.createDataFrame(rows, "rec long, pos long, word long")
    found = sim.similarity_join(df, df, "rec", "rec", others=True, top=3, recordings=recordings)
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["a_id"], []).append((-round(r["similarity"], 12), r["b_id"]))
    want: dict = {}
    for (a, b), s in plain(rows, rows).items():
        if a != b:
            want.setdefault(a, []).append((-round(s, 12), b))
    assert {a: sorted(x)[:3] for a, x in got.items()} == {a: sorted(x)[:3] for a, x in want.items()}
    assert "Exchange" not in above_pairs(found)
    if recordings == 1000:
        assert max(map(len, got.values())) <= 3 * 4  # three for each value from the third best on


def test_likely_pairs_shuffles_no_pairs(spark):
    rng = np.random.default_rng(3)
    for bits, words in ((4, 8), (20, 3)):
        rows = [(f"r{i:03}", p, int(w)) for i in range(150) for p, w in enumerate(rng.integers(0, 1 << 11, words) << int(rng.integers(0, 2) * 9))]
        keys: dict = {}
        for i, _, w in rows:
            keys.setdefault(w % (1 << bits), set()).add(i)
        want = sorted({(a, b) for ids in keys.values() for a in ids for b in ids if a < b})
        for block in (20, 2048):
            found = sim.likely_pairs(spark.createDataFrame(rows, SCHEMA), "rec", bits, block)
            assert sorted((r["a_id"], r["b_id"]) for r in found.collect()) == want
            assert "Exchange" not in above_pairs(found)

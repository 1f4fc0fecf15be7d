"""Top-k search against plain sums of Python's integers."""

import math

import numpy as np
import pytest

from rastrel.llm import top_k

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def brute_top(rows, k, asks=lambda i: i % 20 == 0):
    whole = lambda x: math.floor(64.0 * x)
    q = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, a) in enumerate(q):
        if i is not None and asks(i):
            s = [(-min(HIGH, max(LOW, sum(x * y for x, y in zip(a, b, strict=True)))), j is None, j or 0) for m, (j, b) in enumerate(q) if m != n and len(a) == len(b)]
            out += [(i, r + 1, None if none else j, -x) for r, (x, none, j) in enumerate(sorted(s)[:k])]
    return sorted(out, key=str)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, "x", 3) for r in rows], f"vec_id long, embedding array<{kind}>, label int, shard string, dim int")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    base = rng.normal(0, 0.2, 8)
    rows = [(i, (base if i % 3 == 0 else np.round(rng.normal(0, 0.2, 8), 1)).tolist()) for i in range(300)]
    rows += [(300, None), (301, [float("nan")] * 8), (302, [None] + [0.1] * 7), (303, [float("inf")] * 8), (None, base.tolist()), (None, base.tolist()), (320, [0.5] * 3), (340, [0.25] * 3), (360, []), rows[20], rows[40], (HIGH, base.tolist())]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize(("shard_rows", "block_rows"), [(10_000, 1000), (40, 3), (7, 50)])
def test_top_k(spark, rows, shard_rows, block_rows):
    got = top_k.search(spark, frame(spark, rows), shard_rows=shard_rows, block_rows=block_rows)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, 20)


def test_no_rows(spark, rows):
    assert top_k.search(spark, frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("size", [2.0**22, 2.0**40, 1e18, "mixed"])
def test_scores_beyond_doubles(spark, size):
    """Sums that leave 53 or 64 bits; those beyond 64 bits tie at the limits."""
    rng = np.random.default_rng(5)
    scale = rng.choice([1e-3, 1.0, 2.0**22, 2.0**26], (200, 1)) if size == "mixed" else size
    rows = [(i, (rng.normal(0, 1, (200, 6)) * scale)[i].tolist()) for i in range(200)]
    got = top_k.search(spark, frame(spark, rows, "double"), shard_rows=30, block_rows=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, 20)


def test_close_scores_are_told_apart(spark):
    """Large common part, differences of single units."""
    rng = np.random.default_rng(6)
    rows = [(i, [2.0**24, 2.0**24, float(x), float(y)]) for i, (x, y) in enumerate(rng.integers(-3, 4, (400, 2)) / 64)]
    got = top_k.search(spark, frame(spark, rows, "double"), shard_rows=50, block_rows=7)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, 20)


def test_roots_prune_shards(spark):
    """Clusters far apart: a block goes to few shards, and the result stays exact."""
    rng = np.random.default_rng(7)
    centre = np.eye(8) * 20
    rows = [(i, (centre[i % 8] + rng.normal(0, 0.1, 8)).tolist()) for i in range(800)]
    made = {}
    table = top_k.B.table
    try:
        top_k.B.table = lambda spark, df, name: made.setdefault(name, table(spark, df, name))
        got = top_k.search(spark, frame(spark, rows, "double"), shard_rows=50, block_rows=10)
    finally:
        top_k.B.table = table
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, 20)
    blocks, shards, sent = (made[x].count() for x in ("queries", "trees", "asks"))
    assert shards >= 16 and sent < 0.3 * blocks * shards


def test_other_queries(spark, rows):
    got = top_k.search(spark, frame(spark, rows), queries=top_k.F.col("vec_id") > 280, k=3, shard_rows=40, block_rows=5)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, 3, lambda i: i > 280)

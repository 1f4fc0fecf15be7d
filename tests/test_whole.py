"""Queries and plans do the whole job: no rows left out, no results that change with size."""

import os

import numpy as np
import pytest

from rastrel import queries
from rastrel.functions import vp8
from rastrel.plans import batching
from rastrel.tables import tiled

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no fixture tables")


@tables
def test_two_passes_take_every_picture(spark):
    want = {r.rel for r in tiled(spark, SF).select("rel").collect()}
    got = {r.rel: r for r in queries.rlambda_two_pass(spark, SF).collect()}
    assert set(got) == want and len(want) == 21


def test_two_passes_in_batches_are_those_of_single_pictures():
    rng = np.random.default_rng(8)
    images = [rng.integers(0, 256, (8, w, 3)).astype(np.uint8) for w in range(1, 9)]
    strength = np.array([0, 0.1, 0.4, 1, 0, 0.01, 0.7, 0.2])
    assert vp8.encode_rgb(images, 90, strength=strength) == [vp8.encode_rgb([x], 90, strength=float(s))[0] for x, s in zip(images, strength, strict=True)]


def greedy(sizes, room):
    group, held, out = 0, 0, []
    for s in sizes:
        if held and held + s > room:
            group, held = group + 1, 0
        held += s
        out.append(group)
    return out


def test_slices_tell_how_a_scan_leaves_them():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        room, held = int(rng.integers(1, 12)), int(rng.choice([0, 1, 4, 9, 30]))
        sizes = rng.choice([0, 0, 1, 2, 5, 11, 25, np.nan], int(rng.integers(1, 9)), p=[0.2, 0.1, 0.2, 0.2, 0.1, 0.1, 0.07, 0.03])
        want = greedy([held, *sizes], room)
        mine = [s for s, g in zip([held, *sizes], want, strict=True) if g == want[-1]]
        begun, left = batching._through(batching._ends(sizes, room), room, held)
        assert begun == want[-1] and left == pytest.approx(sum(mine), nan_ok=True), (room, held, sizes)


def test_greedy_groups_go_on_through_slices(spark):
    rng = np.random.default_rng(6)
    rows = [(k, i, int(s)) for k, n in ((0, 500), (1, 37), (2, 1)) for i, s in enumerate(rng.choice([0, 1, 3, 8, 40], n))]
    df = spark.createDataFrame(rows, "k int, n int, size long").repartition(5)
    want = {(k, i): g for k in range(3) for i, g in enumerate(greedy([s for own, _, s in rows if own == k], 20))}
    for run in (1, 7, 1000):
        got = batching.byte_groups(df, ["k"], "n", "size", 20, 0, run).collect()
        assert len(got) == len(rows) and {(r.k, r.n): r.group_id for r in got} == want


def test_rare_sizes_are_planned_behind_many_others(spark):
    odd = spark.range(110_000).selectExpr("cast(1 + id % 1000 * 2 AS int) AS h", "cast(1 + id div 1000 * 2 AS int) AS w")  # none may be padded
    odd = odd.union(odd).union(odd).union(odd)  # each is commoner than the rare ones
    rare = spark.createDataFrame([(1024, 512)] * 3 + [(1040, 512), (1, 1)], "h int, w int")
    got = batching.bucketed(odd.union(rare)).where("bucket_h IS NOT NULL").groupBy("h", "w", "bucket_h", "bucket_w").count().collect()
    assert {tuple(r) for r in got} == {(1024, 512, 1040, 512, 3), (1040, 512, 1040, 512, 1)}


def test_greedy_groups_of_many_rows(spark):
    """One key, equal sizes: full groups but the last, whatever the slices."""
    df = spark.range(40_000).selectExpr("0 AS k", "id AS n", "40000 AS size")
    got = batching.byte_groups(df, ["k"], "n", "size", 1 << 30, 0).groupBy("group_id").count().orderBy("group_id").collect()
    assert [r["count"] for r in got] == [(1 << 30) // 40_000, 40_000 - (1 << 30) // 40_000]

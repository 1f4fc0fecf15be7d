"""Every query of the engine against its SQL on an independent engine."""

import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from rastrel import oracle, queries
from rastrel.plans import batching

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no fixture tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for x in os.listdir(SF):
        p = f"{SF}/{x}"
        c.execute(f"CREATE VIEW {x.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def plain_bucket_plan(sql, cols, rows):
    """Every picture is in a bucket that holds it; those of one size are in one bucket; the commonest size keeps its own."""
    sizes = Counter((-(-h // 16) * 16, -(-w // 16) * 16) for w, h in sql.execute("SELECT p_size * 16 + p_partkey % 5 * 3, p_partkey % 40 * 16 + 16 + p_partkey % 3 FROM part").fetchall())
    plan = batching.plan_buckets([(*k, n) for k, n in sizes.items()])
    want = Counter()
    for k, n in sizes.items():
        want[plan.get(k, (None, None))] += n
    assert {(r.bucket_h, r.bucket_w): r.n for r in rows} == want
    assert all(r.bucket_h is None or (r.max_h <= r.bucket_h and r.max_w <= r.bucket_w) for r in rows)


def plain_huffman(sql, cols, rows):
    """Within the limit, complete, and not far above the code without one."""
    best = dict(sql.execute(oracle.SQL["huffman_bits"]).fetchall())
    assert {r.lang for r in rows} == set(best)
    assert all(r.longest <= 15 and r.kraft <= 1 << 15 and best[r.lang] <= r.bits <= 1.001 * best[r.lang] for r in rows)


def plain_outcomes(sql, cols, rows):
    """Each picture by itself: the size and PSNR of what it becomes."""
    assert {r.status for r in rows} <= {"ok", "fallback"} and len(rows) == 21
    assert all((r.status == "fallback" or r.psnr >= 34) and 0 < r.dst_bytes and r.src_bytes > 0 for r in rows)


def plain_two_pass(sql, cols, rows):
    assert len(rows) == 21 and all(r.bytes <= r.plain_bytes and (r.psnr >= 36 or r.strength == 0) for r in rows)


PLAIN = {"bucket_plan": plain_bucket_plan, "huffman_lengths": plain_huffman, "outcome_sizes": plain_outcomes, "rlambda_two_pass": plain_two_pass}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in oracle.SQL:
        PLAIN[name](sql, cols, df.collect())
        return
    cur = sql.execute(oracle.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

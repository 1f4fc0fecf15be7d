import hashlib
from collections import defaultdict

import numpy as np
import pytest

from rastrel.llm import line_dedup as L

WHITE = " \t\n\x0b\x0c\r"
LOW = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    held = defaultdict(list)
    low = lambda i: -(1 << 63) if i is None else i
    key = lambda x: x.strip(WHITE).translate(LOW)
    for n, r in enumerate(rows):
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].append((low(r[0]), n if r[0] is None else -1))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        drop = [len(set(h := held.get(key(x), []))) >= 3 and max(h)[0] != low(r[0]) for x in lines]
        kept = "\n".join(x for x, d in zip(lines, drop, strict=True) if not d)
        out.append((r[0], len(lines), sum(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(spark, docs, corpus):
    got = L.dedup(spark, docs, block_bytes=4000)
    assert sorted(map(tuple, got.collect()), key=str) == brute(corpus)
    assert any(r[2] for r in brute(corpus))


def test_texts_and_other_columns(spark, docs, corpus):
    got = L.dedup(spark, docs, block_bytes=4000, carry=("lang", "source"), digest=False)
    assert got.columns == ["doc_id", "text", "lang", "source"]
    assert got.count() == len(corpus)
    assert got.where("text is null").count() == sum(r[1] is None for r in corpus)


def test_empty(spark, empty):
    assert L.dedup(spark, empty).collect() == []


def test_carried_columns_may_have_any_names(spark, docs, corpus):
    got = L.dedup(spark, docs, block_bytes=4000, carry=("block", "shard", "n_chars"), digest=False)
    assert got.columns == ["doc_id", "text", "block", "shard", "n_chars"]
    assert sorted((r.doc_id, r.block, r.shard, r.n_chars) for r in got.collect() if r.doc_id is not None) == sorted((r[0], r[5], r[6], r[4]) for r in corpus if r[0] is not None)


def test_filter_and_table_are_reversible():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 1 << 62, (2000, 2)).astype(np.uint64), axis=0) for _ in range(2))
    b = np.unique(np.concatenate([b, a[:500]]), axis=0)
    ref = lambda k, s: (np.full(len(k), s), k[:, 0].copy(), k[:, 1].copy(), np.ones(len(k), np.int64), np.full(len(k), s))
    x = L.LineShard()
    x.insert(*ref(a, 1))
    before = (x.hi.copy(), x.n.copy(), x.top.copy())
    x.insert(*ref(b, 2))
    assert len(x.frequent(2)[0]) == 500 and (x.frequent(2)[2] == 2).all()
    assert x.filter.contains(b[:, 0] ^ b[:, 1]).all()
    x = L.LineShard.of(x.state())
    x.delete(*ref(b, 2)[:3])
    assert all((p == q).all() for p, q in zip(before, (x.hi, x.n, x.top), strict=True))
    assert x.filter.contains(a[:, 0] ^ a[:, 1]).all()
    gone = b[~np.isin(b[:, 0], a[:, 0])]
    assert x.filter.contains(gone[:, 0] ^ gone[:, 1]).mean() < 0.01


def test_only_what_was_inserted_can_be_deleted():
    x = L.LineShard()
    u = lambda *v: np.array(v, np.uint64)
    i = lambda *v: np.array(v, np.int64)
    x.insert(i(1, 1, 2), u(10, 20, 20), u(0, 0, 0), i(1, 1, 1), i(1, 1, 2))
    for src, hi in ((i(2), u(10)), (i(1), u(30)), (i(3), u(20)), (i(1, 1), u(10, 10))):
        with pytest.raises(KeyError):
            x.delete(src, hi, np.zeros(len(hi), np.uint64))
    assert x.src.tolist() == [1, 1, 2] and x.filter.contains(u(10, 20)).all()
    x.delete(i(2), u(20), u(0))
    assert x.hi.tolist() == [10, 20] and x.src.tolist() == [1, 1]


def test_suspects_hold_all_that_is_met_again():
    rng = np.random.default_rng(4)
    parts = []
    for _ in range(30):
        k = np.unique(rng.integers(0, 5000, 300).astype(np.uint64))
        parts.append((k, np.zeros(len(k), np.uint64), (rng.random(len(k)) < 0.01) * 3 + 1))
    keys, n = np.unique(np.concatenate([p[0] for p in parts]), return_counts=True)
    got = L.suspects(parts, 3)
    assert np.isin(keys[n > 1], got).all() and np.isin(np.concatenate([p[0][p[2] >= 3] for p in parts]), got).all()
    alone = np.setdiff1d(keys[n == 1], np.concatenate([p[0][p[2] >= 3] for p in parts]))
    assert np.isin(alone, got).sum() < 5


def test_index_takes_documents_back(spark, docs):
    """After deletions the index is that of what is left, keepers included; only the deleted documents are read."""
    know = lambda state: sorted(map(tuple, L.frequent(state).collect()))
    docs = docs.where("doc_id IS NOT NULL").persist()
    first, second = docs.where("doc_id < 90"), docs.where("doc_id >= 90")
    kw = {"n_shards": 4, "spread": 3, "block_bytes": 4000}
    one = L.index(first, **kw).persist()
    two = L.index(second, one, **kw).persist()
    assert know(two) == know(L.index(docs, n_shards=2, spread=1)) and know(two)
    gone, rest = second.where("doc_id % 3 = 0"), second.where("doc_id % 3 <> 0")
    less = L.delete(gone, two, **kw)
    assert know(less) == know(L.index(first.union(rest), **kw)) != know(two)
    assert know(L.delete(second, two, **kw)) == know(one)
    states = [L.LineShard.of(bytes(r.state)) for r in L.delete(first, one, **kw).collect()]
    assert states and all(not len(x.hi) and not x.filter.slots.any() for x in states)


def test_index_and_dedup_agree(spark, docs):
    """A line is dropped where the index, after insertions and a deletion, says so."""
    docs = docs.where("doc_id IS NOT NULL").persist()
    state = L.delete(docs.where("doc_id % 4 = 1"), L.index(docs, n_shards=4), n_shards=4)
    keep = {(r.hi, r.lo): r.keeper for r in L.frequent(state).collect()}
    rest = docs.where("doc_id % 4 <> 1")
    for r, d in zip(sorted(L.dedup(spark, rest).collect()), sorted(rest.select("doc_id", "text").collect(), key=lambda r: (r.doc_id, r.text or "")), strict=False):
        keys = L.line_keys((d.text or "").encode())[2].view(np.int64)
        if d.doc_id not in (3, 7):  # repeated ids
            assert r.doc_id == d.doc_id and r.n_dropped == sum(keep.get((int(h), int(lo)), d.doc_id) != d.doc_id for h, lo in keys)


def test_many_empty_texts_make_many_blocks(spark):
    from rastrel.llm import _blocks as B

    docs = B.documents(spark.range(1_000_000).selectExpr("id AS doc_id", "'' AS text"))
    blocks, n = B.in_blocks(docs, B.text_bytes(docs), L.BLOCK)
    assert n > 16 and blocks.groupBy("block").count().agg({"count": "max"}).first()[0] < 50_000


def test_very_long_text(spark):
    line = "this line is in three of the documents"
    long = "\n".join(f"line number {i} of a very long text" for i in range(150_000))
    rows = [(1, long + "\n" + line, 0), (2, line, 0), (3, line + "\n" + long[:2000], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int")
    assert sorted(map(tuple, L.dedup(spark, df).collect())) == brute(rows)

"""Suffix-array dedup (operator 5): bytes covered by a string of ``length`` bytes that starts earlier.

Which strings have to meet is settled by anchors: the anchor of a window of ``length`` bytes is the
place of its least 24-byte hash, so equal windows have their anchors at the same place and with the
same hash, about one anchor for every 39 bytes. Windows in a row with the same anchor form a *run*, a
piece of text of length .. length + 76 bytes.

1. Every block of documents sends the distinct hashes of its anchors to buckets, which answer which of
   them occur twice or more in the corpus, and how often. All other text can hold no repeat.
2. Every block sends the runs of those anchors to shards, by anchor hash: equal runs once, from their
   first place; the later ones are known to be repeats. Runs of a very frequent anchor are dealt over
   several shards.
3. A shard builds the suffix array of its runs (Larsson-Sadakane refinement), the common prefixes
   (Kasai) and from both the classes of equal windows. In a class, all but the first are repeats.
4. The classes of anchors that several shards share are merged: each shard sends its sorted classes
   (128-bit hashes of the windows, by hash ranges), and sorted lists are merged by binary search.
5. Every block gets back which windows repeat, and cuts what they cover.

Order: by doc_id (nulls first), then by text bytes among rows with the same doc_id, then by start; so
of two equal rows the later one goes, even when both have no doc_id. Null or empty texts, and texts
under ``length`` bytes, lose nothing. Very long texts are whole: a text's runs go to many shards. An empty
table gives an empty result. Other columns are ignored. ``block_bytes`` and ``shard_bytes`` say how many
blocks and shards there are; a message goes from each block to each shard, so both grow with the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import _blocks as B

LENGTH, K = 100, 24
BLOCK, SHARD, HEAVY = 4 << 20, 3 << 19, 2048
CHUNK = 1 << 17


def _words(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places as big-endian numbers; data has 8 bytes more."""
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[k : k + n]
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The suffix array of bytes, by Larsson-Sadakane refinement from 8-byte keys.

    Only suffixes whose rank isn't settled are sorted again, each time by the rank of the suffix that
    starts as far on as is known to agree.
    """
    n = len(data)
    place = np.int32 if n < 1 << 31 else np.int64
    key = _words(np.concatenate([data, np.zeros(8, np.uint8)]), n)
    sa = np.argsort(key, kind="stable").astype(place)
    key = key[sa]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    if not data.all():
        # zero bytes behind the end would tie with zero bytes in the text: shorter suffixes come first
        tail = np.maximum(0, 8 - (n - sa))
        sa = sa[np.lexsort((-tail, np.cumsum(new)))]
        tail = np.maximum(0, 8 - (n - sa))
        new |= np.concatenate([[True], tail[1:] != tail[:-1]])
    rank = np.empty(n + 1, place)
    rank[sa], rank[n] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=place), place(0))) + 1, 0
    h = 8
    idx = np.flatnonzero(~(new & np.append(new[1:], True))).astype(place)
    while len(idx):
        s = sa[idx]
        k = (rank[s].astype(np.int64) << 32) | rank[np.minimum(s.astype(np.int64) + h, n)]
        o = np.argsort(k, kind="stable")
        s, k = s[o], k[o]
        sa[idx] = s
        new = np.concatenate([[True], k[1:] != k[:-1]])
        rank[s] = idx[np.maximum.accumulate(np.where(new, np.arange(len(idx)), 0))] + 1
        idx = idx[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, start: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in sa, the length (up to most) of the prefix it shares with the one before it.

    Kasai's scan, for all pieces (which start at ``start``) side by side: a suffix shares at least one
    byte less than the suffix one place before it did, so comparing goes on from there.
    """
    n = len(data)
    wide = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    word = np.lib.stride_tricks.as_strided(wide, (n + most + 8, 8), (1, 1))
    phi = np.empty(n, sa.dtype)
    phi[sa[1:]], phi[sa[0]] = sa[:-1], -1
    out = np.zeros(n, np.int32)
    size = np.diff(np.append(start, n))
    order = np.argsort(-size, kind="stable")
    at, size = start[order].copy(), size[order]
    h = np.zeros(len(at), np.int64)
    for step in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -step, side="left"))
        at, h, size = at[:live], h[:live], size[:live]
        p = phi[at].astype(np.int64)
        h = np.where(p >= 0, np.maximum(h - 1, 0), 0)
        go = np.flatnonzero((p >= 0) & (h < most))
        while len(go):
            a, b = at[go] + h[go], p[go] + h[go]
            same = word[np.minimum(a, n)] == word[np.minimum(b, n)]
            room = np.minimum(most - h[go], n - np.maximum(a, b))
            run = np.minimum(np.where(same.all(1), 8, same.argmin(1)), room)
            h[go] += run
            go = go[(run == 8) & (room > 8)]
        out[at] = h
        at = at + 1
    return out[sa]


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of all texts: first window, number of windows, place of the anchor, hash of the anchor.

    data: the bytes of all texts and ``length`` more; off: their offsets.
    """
    n, width = int(off[-1]), length - K + 1
    ok_to = np.repeat(off[1:] - length, np.diff(off)) if n else np.empty(0, np.int64)  # the last window of each place's text
    out = []
    for c in range(0, n, CHUNK):
        m = min(CHUNK, n - c)
        k = min(m + width - 1, len(data) - c - K + 1)
        seg = data[c : c + k + K]
        if k < width:
            break
        v = _words(np.concatenate([seg, np.zeros(8, np.uint8)]), k + 16)
        h = B.mix(v[:k] * np.uint64(0x9E3779B97F4A7C15) ^ (v[8 : k + 8] * np.uint64(0xC2B2AE3D27D4EB4F) + v[16 : k + 16]) * np.uint64(0x165667B19E3779F9))
        low = np.uint64((1 << 18) - 1)
        m_ = (h & ~low) | np.arange(k, dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            m_ = np.minimum(m_[:-span], m_[span:])
            span *= 2
        if span < width:
            m_ = np.minimum(m_[: -(width - span)], m_[width - span :])
        m = min(m, len(m_))
        at = (m_[:m] & low).astype(np.int64)
        here = np.arange(c, c + m)
        ok = here <= ok_to[c : c + m]
        first = ok & np.concatenate([[True], (at[1:] != at[:-1]) | ~ok[:-1]])
        last = ok & np.concatenate([(at[1:] != at[:-1]) | ~ok[1:], [True]])
        # a text ends inside the window of the place before its successor's first window, so runs never join two texts
        s, e = here[first], here[last]
        a = at[first]
        out.append((s, e - s + 1, a + c, h[a]))
    if not out:
        z = np.empty(0, np.int64)
        return z, z, z, np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _hashes(n_buckets: int, length: int):
    def send(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        h, count = np.unique(anchors(*B.Docs(t).joined(length), length)[3], return_counts=True)
        out = [(s, block, B.pack(h[i], np.minimum(count[i], 1 << 30).astype(np.uint32))) for s, i in B.by_bucket(h, n_buckets)]
        return _table(("bucket", "block", "blob"), out)

    return send


def _table(names: tuple[str, ...], out: list[tuple]) -> pa.Table:
    kinds = {"blob": pa.binary()}
    cols = list(zip(*out, strict=True)) or [[] for _ in names]
    return pa.table({k: pa.array(c, kinds.get(k, pa.int32())) for k, c in zip(names, cols, strict=True)})


def _repeated(t: pa.Table) -> pa.Table:
    """Answers each block with the hashes that occur twice or more, and how often."""
    blocks, parts = t.column("block").to_pylist(), [B.unpack(x) for x in t.column("blob").to_pylist()]
    keys = np.concatenate([p[0] for p in parts])
    own = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    o = np.argsort(keys, kind="stable")
    first = np.concatenate([[True], keys[o][1:] != keys[o][:-1]])
    total = np.add.reduceat(np.concatenate([p[1] for p in parts]).astype(np.int64)[o], np.flatnonzero(first))
    total = total[np.cumsum(first) - 1]
    hit = o[total > 1]
    total = np.minimum(total[total > 1], 1 << 30)
    back = np.lexsort((keys[hit], own[hit]))
    hit, total = hit[back], total[back]
    out = [(blocks[own[hit[i[0]]]], B.pack(keys[hit[i]], total[i].astype(np.uint32))) for i in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(own[hit])) + 1) if len(i)]
    return _table(("block", "blob"), out)


def _runs(n_shards: int, length: int, heavy: int):
    """To shards: the runs of repeated anchors. To the block itself ("known"): runs that repeat an earlier one of the block."""

    def send(t: pa.Table, r: pa.Table) -> pa.Table:
        names = ("shard", "block", "known", "blob")
        if not t.num_rows or not r.num_rows:
            return _table(names, [])
        block = t.column("block")[0].as_py()
        d = B.Docs(t)
        data, off = d.joined(length)
        start, n, at, h = anchors(data, off, length)
        parts = [B.unpack(x) for x in r.column("blob").to_pylist()]
        keys, total = (np.concatenate(x) for x in zip(*parts, strict=True))
        o = np.argsort(keys)
        keys, total = keys[o], total[o]
        pos = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[pos] == h
        start, n, h, total = start[hit], n[hit], h[hit], total[pos[hit]]
        if not len(start):
            return _table(names, [])
        raw = data.tobytes()
        first: dict[bytes, int] = {}
        rep = np.array([first.setdefault(raw[s : s + k], i) for i, (s, k) in enumerate(zip(start.tolist(), (n + length - 1).tolist(), strict=True))])
        me = np.arange(len(rep))
        again = rep != me
        out = [(int(block) % n_shards, block, 1, B.pack(start[again], n[again].astype(np.int32)))] if again.any() else []
        one = np.flatnonzero(~again)
        doc = np.searchsorted(off, start[one], side="right") - 1
        # a frequent anchor's runs go to as many shards as they fill
        turn = np.where(total[one] > heavy, B.mix(B.mix(start[one].astype(np.uint64)) + np.uint64(block)) % np.maximum(1, -(-total[one].astype(np.int64) // heavy)).astype(np.uint64), 0).astype(np.uint64)
        shard = B.deal(h[one] + turn * np.uint64(0x9E3779B97F4A7C15), n_shards).astype(np.int64)
        o = np.argsort(shard, kind="stable")
        for i in np.split(o, np.flatnonzero(np.diff(shard[o])) + 1):
            k = one[i]
            size = n[k] + length - 1
            flat = np.repeat(start[k] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out.append((int(shard[i[0]]), block, 0, B.pack(data[flat], start[k], (start[k] - off[doc[i]]), n[k].astype(np.int32), d.ids[doc[i]], doc[i].astype(np.int32), (total[k] > heavy).astype(np.uint8), level=5)))
        return _table(names, out)

    return send


_FOUND = pa.schema([("kind", pa.string()), ("block", pa.int32()), ("merge", pa.int64()), ("shard", pa.int32()), ("blob", pa.binary())])


def _shard(length: int, n_merge: int):
    def run(t: pa.Table) -> pa.Table:
        out = [("hit", b, None, None, x) for b, k, x in zip(t.column("block").to_pylist(), t.column("known").to_pylist(), t.column("blob").to_pylist(), strict=True) if k]
        own = t.column("shard")[0].as_py()
        src = [(b, B.unpack(x)) for b, k, x in zip(t.column("block").to_pylist(), t.column("known").to_pylist(), t.column("blob").to_pylist(), strict=True) if not k]
        if src:
            hits, merge = windows(src, length)
            out += [("hit", b, None, None, x) for b, x in hits]
            if merge is not None:
                cls, where = merge
                for s, i in B.by_bucket(cls[:, 0].copy(), n_merge):
                    o = i[np.lexsort((cls[i, 1], cls[i, 0]))]
                    out.append(("open", None, s, own, B.pack(cls[o, 0], cls[o, 1], *(x[o] for x in where))))
        return B.rows(_FOUND, list(zip(*out, strict=True)) or [[]] * 5)

    return run


def windows(src: list[tuple[int, list[np.ndarray]]], length: int):
    """Of the runs in a shard: by block, the windows that repeat an earlier one; and the classes of frequent anchors."""
    block = np.repeat([b for b, _ in src], [len(x[1]) for _, x in src])
    data = np.concatenate([x[0] for _, x in src])
    place, inner, n, ids, doc, hot = (np.concatenate([x[i] for _, x in src]) for i in range(1, 7))
    size = n.astype(np.int64) + length - 1
    begin = np.cumsum(size) - size
    # the order of the runs' first windows; windows of one run follow it place by place
    o = np.lexsort((inner, doc, block, ids))
    doc_key = np.stack([ids[o], block[o], doc[o]], 1)
    turn = np.empty(len(o), np.int64)
    turn[o] = np.cumsum(np.concatenate([[False], (doc_key[1:] != doc_key[:-1]).any(1)]))
    # equal runs from different blocks: all but the first repeat
    raw = data.tobytes()
    first: dict[bytes, int] = {}
    rep = np.empty(len(o), np.int64)
    for i in o.tolist():
        rep[i] = first.setdefault(raw[begin[i] : begin[i] + size[i]], i)
    one = np.sort(np.flatnonzero(rep == np.arange(len(rep))))
    gone = np.flatnonzero(rep != np.arange(len(rep)))
    hit_run, hit_at, hit_n = [gone], [np.zeros(len(gone), np.int64)], [n[gone].astype(np.int64)]
    # text of the distinct runs
    s1 = size[one]
    b1 = np.cumsum(s1) - s1
    text = data[np.repeat(begin[one] - b1, s1) + np.arange(s1.sum())]
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa, b1, length)
    run_of = np.repeat(np.arange(len(one)), s1)
    cls = np.cumsum(lcp < length)
    r = run_of[sa]
    o2 = sa - b1[r]
    win = o2 < n[one][r]
    cls, r, o2 = cls[win], r[win], o2[win]
    order = (turn[one][r] << 32) | (inner[one][r] + o2)
    cut = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])) if len(cls) else np.empty(0, np.int64)
    least = np.minimum.reduceat(order, cut)
    size_c = np.diff(np.append(cut, len(cls)))
    later = order != np.repeat(least, size_c)
    a, b = one[r[later]], o2[later]
    o = np.lexsort((b, a))
    a, b = a[o], b[o]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1] + 1)])[: len(a)]
    f = np.flatnonzero(new)
    hit_run.append(a[f])
    hit_at.append(b[f])
    hit_n.append(np.diff(np.append(f, len(a))))
    a, b, c = (np.concatenate(x) for x in (hit_run, hit_at, hit_n))
    o = np.argsort(block[a], kind="stable")
    a, b, c = a[o], b[o], c[o]
    hits = [(int(block[a[i[0]]]), B.pack(place[a[i]] + b[i], c[i].astype(np.int32))) for i in np.split(np.arange(len(a)), np.flatnonzero(np.diff(block[a])) + 1) if len(i)]
    keep = ~later & (hot[one][r] > 0)
    if not keep.any():
        return hits, None
    r, o2 = r[keep], o2[keep]
    i = one[r]
    at = (begin[i] + o2).tolist()
    key = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[x : x + length]) for x in at), np.uint64).reshape(-1, 2)
    return hits, (key, (ids[i], block[i].astype(np.int64), doc[i].astype(np.int64), inner[i] + o2, place[i] + o2))


_CLASS = np.dtype([("hi", np.uint64), ("lo", np.uint64)])


def _merge(t: pa.Table) -> pa.Table:
    """Classes that several shards hold: sorted lists are merged, two and two, by binary search; all but the first of a class repeat."""
    lists = []
    for x in t.column("blob").to_pylist():
        hi, lo, *rest = B.unpack(x)
        k = np.empty(len(hi), _CLASS)
        k["hi"], k["lo"] = hi, lo
        lists.append((k, np.stack(rest, 1)))
    hits: list[np.ndarray] = []
    while len(lists) > 1:
        lists = [_merged(*lists[i : i + 2], hits) if i + 1 < len(lists) else lists[i] for i in range(0, len(lists), 2)]
    out = []
    if hits:
        x = np.concatenate(hits)
        x = x[np.lexsort((x[:, 4], x[:, 1]))]
        for i in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x[:, 1])) + 1) if len(x) else []:
            out.append((int(x[i[0], 1]), B.pack(x[i, 4], np.ones(len(i), np.int32))))
    return _table(("block", "blob"), out)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], hits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Both lists as one; of a class in both the earlier window stays and the later one is a hit."""
    (keys, best), (k, rest) = a, b
    at = _find(keys, k)
    old = at >= 0
    mine, theirs = np.flatnonzero(old), at[old]
    earlier = _before(rest[mine], best[theirs])
    hits.append(np.where(earlier[:, None], best[theirs], rest[mine]))
    best = best.copy()
    best[theirs[earlier]] = rest[mine[earlier]]
    into = _at(keys, k[~old])
    return np.insert(keys, into, k[~old]), np.insert(best, into, rest[~old], axis=0)


def _at(keys: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where each of k goes into the sorted keys; binary search by the high half, then on among equal ones."""
    at = np.searchsorted(keys["hi"], k["hi"])
    while True:
        i = np.minimum(at, max(0, len(keys) - 1))
        on = (at < len(keys)) & (keys["hi"][i] == k["hi"]) & (keys["lo"][i] < k["lo"]) if len(keys) else np.zeros(len(k), bool)
        if not on.any():
            return at
        at = at + on


def _find(keys: np.ndarray, k: np.ndarray) -> np.ndarray:
    at = _at(keys, k)
    i = np.minimum(at, max(0, len(keys) - 1))
    same = (at < len(keys)) & (keys["hi"][i] == k["hi"]) & (keys["lo"][i] == k["lo"]) if len(keys) else np.zeros(len(k), bool)
    return np.where(same, at, -1)


def _before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By doc_id, block, document and place."""
    out = np.zeros(len(a), bool)
    tie = np.ones(len(a), bool)
    for c in range(4):
        out |= tie & (a[:, c] < b[:, c])
        tie &= a[:, c] == b[:, c]
    return out


def spans(spark: SparkSession, docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK, shard_bytes: int = SHARD, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """The documents by block, and packed (place, number) of the windows that repeat, by block."""
    B.ready(spark)
    docs = B.documents(docs)
    total = B.text_bytes(docs)
    blocks, n_blocks = B.in_blocks(docs, total, block_bytes)
    n_buckets = max(8, n_blocks // 8)
    n_shards = max(8, -(-total // shard_bytes))
    sent = blocks.groupBy("block").applyInArrow(B.trimmed(_hashes(n_buckets, length)), "bucket int, block int, blob binary")
    told = sent.groupBy("bucket").applyInArrow(B.trimmed(_repeated), "block int, blob binary")
    runs = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(B.trimmed(_runs(n_shards, length, heavy)), "shard int, block int, known int, blob binary")
    found = runs.groupBy("shard").applyInArrow(B.trimmed(_shard(length, n_shards)), "kind string, block int, merge long, shard int, blob binary")
    found = B.table(spark, found, "windows")  # the shuffled texts and runs go once it is written
    merged = found.where("kind = 'open'").select("merge", "shard", "blob").groupBy("merge").applyInArrow(B.trimmed(_merge), "block int, blob binary")
    return blocks, found.where("kind = 'hit'").select("block", "blob").union(merged)


def _cut(length: int, digest: bool):
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()) if digest else ("kept", pa.binary())])

    def run(t: pa.Table, r: pa.Table) -> pa.Table:
        if not t.num_rows:
            return out.empty_table()
        d = B.Docs(t)
        data, off = d.joined()
        change = np.zeros(len(data) + 1, np.int32)
        for x in r.column("blob").to_pylist() if r.num_rows else []:
            place, n = B.unpack(x)
            np.add.at(change, place, 1)
            np.add.at(change, place + n + length - 1, -1)
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        del change
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        first[off[:-1][np.diff(off) > 0]] = gone[off[:-1][np.diff(off) > 0]]
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[off])
        n_spans = np.diff(np.concatenate([[0], np.cumsum(first)])[off])
        kept = [x if not k else data[a:b][~gone[a:b]].tobytes() for x, k, a, b in zip(d.raw, removed.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True)]
        last = pa.array([hashlib.sha256(x).hexdigest() for x in kept]) if digest else pa.array(kept, pa.binary())
        return pa.table([d.doc_ids(), pa.array(np.diff(off)), pa.array(removed), pa.array(n_spans), last], schema=out)

    return run


def dedup(spark: SparkSession, docs: DataFrame, length: int = LENGTH, digest: bool = True, **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 or, without digest, the kept bytes of every row."""
    blocks, hits = spans(spark, docs, length, **sizes)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary")
    return blocks.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(B.trimmed(_cut(length, digest)), schema)

"""Line dedup (operator 2): sharded cuckoo filters backed by exact reference-count tables.

Lines are keyed by the 128-bit xxh3 hash of the line, stripped of ASCII white space at both ends and
with A-Z lower-cased.

* ``dedup`` (all at once): every block of documents sends each key once, with the number of its documents
  that hold the line and the largest of their ids. A shard of keys passes them through its cuckoo filter:
  a key that the filter has not seen, of too few documents by itself, only goes into the filter. Keys met
  again are suspects; the references (key, block, documents, largest id) of those alone are put into the
  exact table and counted. A false positive is one more suspect and changes no result.
* ``index``, ``delete`` and ``frequent`` (incremental): a shard holds a reference for each (key, document).
  The filter answers "never seen" without touching the table; whatever may have been seen is looked up
  exactly. Deleting a document takes back its references, which must be there, and so restores the state
  before it came, keepers included. The references of one key are spread over ``spread`` shards, so a line
  that very many documents hold doesn't fill one.

Nulls and ties: a null text is one empty line; a null doc_id counts as smaller than all others and
each such row is a document of its own; rows that share a doc_id are one document for counting, and
all of them keep the line if that doc_id is the largest. The index takes documents with an id only; rows
of one doc_id go in, and come out, together. Very long texts are split whole, line by line, in the block
they are in. Other columns are passed through when named in ``carry``, whatever their names, and are never
read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _blocks as B

WHITE = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
BLOCK, SHARD, SPREAD = 2 << 20, 16 << 20, 8


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, filled and probed by whole arrays of 64-bit keys."""

    def __init__(self, capacity: int = 64):
        self.m = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / 3))))
        self.slots = np.zeros((self.m, 4), np.uint16)

    def _at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = B.mix(keys)
        fp = ((h >> np.uint64(48)).astype(np.uint16)) | np.uint16(1)
        return fp, (h & np.uint64(self.m - 1)).astype(np.int64)

    def _other(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (B.mix(fp.astype(np.uint64)) & np.uint64(self.m - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, at = self._at(keys)
        return (self.slots[at] == fp[:, None]).any(1) | (self.slots[self._other(fp, at)] == fp[:, None]).any(1)

    def _place(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts what fits into free slots; returns what is left over."""
        order = np.argsort(at, kind="stable")
        a = at[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        free = self.slots[a] == 0
        fits = rank < free.sum(1)
        # the (rank + 1)th free slot of the bucket
        slot = (np.cumsum(free, 1) > rank[:, None]).argmax(1)
        put = order[fits]
        self.slots[a[fits], slot[fits]] = fp[put]
        return order[~fits]

    def insert(self, keys: np.ndarray) -> bool:
        """Adds keys that it doesn't hold. False: it is too full, and must be built anew, larger."""
        fp, at = self._at(keys)
        for turn in range(200):
            left = self._place(fp, at)
            if not len(left):
                return True
            fp, at = fp[left], self._other(fp[left], at[left])
            left = self._place(fp, at)
            if not len(left):
                return True
            fp, at = fp[left], at[left]
            # one newcomer a bucket takes the place of an older fingerprint, which moves on
            _, one = np.unique(at, return_index=True)
            slot = (turn + fp[one]) % 4
            old = self.slots[at[one], slot].copy()
            self.slots[at[one], slot] = fp[one]
            fp[one] = old
            at[one] = self._other(old, at[one])
        return False

    def delete(self, keys: np.ndarray) -> None:
        fp, at = self._at(keys)
        for f, a, b in zip(fp, at, self._other(fp, at), strict=True):
            for place in (a, b):
                hit = np.flatnonzero(self.slots[place] == f)
                if len(hit):
                    self.slots[place, hit[0]] = 0
                    break


class LineShard:
    """References (key, source, documents, largest id) of a shard, with the filter of the keys it holds. A source is a block or a document."""

    def __init__(self):
        self.hi = self.lo = np.empty(0, np.uint64)
        self.src = self.n = self.top = np.empty(0, np.int64)
        self.filter = CuckooFilter()

    def _find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The first reference of each key, or -1. Keys that the filter denies are not looked up."""
        out = np.full(len(hi), -1, np.int64)
        ask = np.flatnonzero(self.filter.contains(hi ^ lo)) if len(self.hi) else np.empty(0, np.int64)
        at = np.searchsorted(self.hi, hi[ask])
        while len(ask):
            ok = (at < len(self.hi)) & (self.hi[np.minimum(at, len(self.hi) - 1)] == hi[ask])
            ask, at = ask[ok], at[ok]
            same = self.lo[at] == lo[ask]
            out[ask[same]] = at[same]
            ask, at = ask[~same], at[~same] + 1
        return out

    def _sorted(self, hi, lo, src, n, top) -> None:
        o = np.lexsort((src, lo, hi))
        self.hi, self.lo, self.src, self.n, self.top = hi[o], lo[o], src[o], n[o], top[o]

    def insert(self, src: np.ndarray, hi: np.ndarray, lo: np.ndarray, n: np.ndarray, top: np.ndarray) -> None:
        """Adds references; a (key, source) may come once."""
        keys = np.unique(np.stack([hi, lo]), axis=1)
        new = self._find(keys[0], keys[1]) < 0
        fresh = keys[0, new] ^ keys[1, new]
        self._sorted(*(np.concatenate(x) for x in ((self.hi, hi), (self.lo, lo), (self.src, src), (self.n, n), (self.top, top))))
        room = 3 * self.filter.m
        if len(fresh) and (self._keys() > room or not self.filter.insert(fresh)):
            self._rebuild()

    def _first(self) -> np.ndarray:
        if not len(self.hi):
            return np.empty(0, np.int64)
        return np.flatnonzero(np.concatenate([[True], (self.hi[1:] != self.hi[:-1]) | (self.lo[1:] != self.lo[:-1])]))

    def _keys(self) -> int:
        return len(self._first())

    def _rebuild(self) -> None:
        at, size = self._first(), 2 * self._keys()
        while True:
            self.filter = CuckooFilter(size)
            if self.filter.insert(self.hi[at] ^ self.lo[at]):
                return
            size *= 2

    def delete(self, src: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> None:
        """Takes references back; each must be there."""
        at = self._find(hi, lo)
        if (at < 0).any():
            raise KeyError("a line that was never inserted")
        if not len(at):
            return
        while True:
            ok = (at < len(self.src)) & (self.hi[np.minimum(at, len(self.hi) - 1)] == hi) & (self.lo[np.minimum(at, len(self.lo) - 1)] == lo)
            if not ok.all():
                raise KeyError("a reference that was never inserted")
            wrong = self.src[at] != src
            if not wrong.any():
                break
            at = at + wrong
        if len(np.unique(at)) < len(at):
            raise KeyError("a reference that is taken back twice")
        keep = np.ones(len(self.hi), bool)
        keep[at] = False
        before = self.hi ^ self.lo
        self._sorted(*(x[keep] for x in (self.hi, self.lo, self.src, self.n, self.top)))
        self.filter.delete(np.setdiff1d(before[~keep], self.hi ^ self.lo))

    def counts(self) -> tuple[np.ndarray, ...]:
        """hi, lo, the number of documents and the largest id of every key."""
        at = self._first()
        if not len(at):
            return self.hi, self.lo, self.n, self.top
        return self.hi[at], self.lo[at], np.add.reduceat(self.n, at), np.maximum.reduceat(self.top, at)

    def frequent(self, least: int) -> tuple[np.ndarray, ...]:
        """hi, lo and the largest id of the keys that at least so many documents hold."""
        hi, lo, n, top = self.counts()
        many = n >= least
        return hi[many], lo[many], top[many]

    def state(self) -> bytes:
        return B.pack(self.hi, self.lo, self.src, self.n, self.top, self.filter.slots.ravel())

    @classmethod
    def of(cls, state: bytes) -> LineShard:
        x = cls()
        x.hi, x.lo, x.src, x.n, x.top, slots = (a.copy() for a in B.unpack(state))
        x.filter.slots = slots.reshape(-1, 4)
        x.filter.m = len(x.filter.slots)
        return x


def line_keys(text: bytes, min_chars: int = MIN_CHARS) -> tuple[list[bytes], list[int], np.ndarray]:
    """The lines of a text, which of them are long enough to count, and the keys of those (k, 2)."""
    lines = text.split(b"\n")
    at, keys = [], []
    for i, x in enumerate(lines):
        if len(x) >= min_chars:
            k = x.strip(WHITE).lower()
            if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode("utf-8", "replace")) >= min_chars):
                at.append(i)
                keys.append(xxhash.xxh3_128_digest(k))
    return lines, at, np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


MESSAGE = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("blob", pa.binary())])
REPLY = pa.schema([("block", pa.int32()), ("blob", pa.binary())])
STATE = pa.schema([("shard", pa.int32()), ("state", pa.binary())])


def _keys(t: pa.Table, min_chars: int) -> tuple[B.Docs, np.ndarray, np.ndarray]:
    """The documents of a block, and the distinct (key, document) of all their lines, sorted."""
    d = B.Docs(t)
    keys = [line_keys(x, min_chars)[2] for x in d.raw]
    doc = np.repeat(np.arange(len(d)), [len(k) for k in keys])
    k = np.concatenate(keys) if keys else np.empty((0, 2), np.uint64)
    # rows with one doc_id are one document; those without are told apart
    own = np.where(d.null, np.arange(len(d)), np.searchsorted(d.ids, d.ids))[doc]
    o = np.lexsort((own, k[:, 1], k[:, 0]))
    k, own = k[o], own[o]
    new = np.concatenate([[True], (k[1:] != k[:-1]).any(1) | (own[1:] != own[:-1])])[: len(k)]
    return d, k[new], own[new]


def _messages(n_shards: int, min_chars: int):
    def send(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        d, k, own = _keys(t, min_chars)
        at = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(1)])[: len(k)])
        n = np.diff(np.append(at, len(k)))
        top = np.maximum.reduceat(d.ids[own], at) if len(at) else np.empty(0, np.int64)
        k = k[at]
        out = [(s, block, B.pack(k[i, 0], k[i, 1], n[i], top[i])) for s, i in B.by_bucket(k[:, 0], n_shards)]
        return B.rows(MESSAGE, list(zip(*out, strict=True)) or [[], [], []])

    return send


def suspects(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: int) -> np.ndarray:
    """Of the keys (hi, lo) of many sources, each with its number of documents, those that may be in enough: met before, or enough in one source. Sorted hi ^ lo."""
    room = sum(len(p[0]) for p in parts)
    while True:
        seen, again = CuckooFilter(room), [np.empty(0, np.uint64)]
        for hi, lo, n in parts:
            k = hi ^ lo
            known = seen.contains(k)
            again.append(k[known | (n >= least)])
            if not seen.insert(k[~known]):
                break
        else:
            return np.unique(np.concatenate(again))
        room *= 2


def _replies(min_docs: int):
    def answer(t: pa.Table) -> pa.Table:
        parts = [(b, *B.unpack(x)) for b, x in zip(t.column("block").to_pylist(), t.column("blob").to_pylist(), strict=True)]
        often = suspects([p[1:4] for p in parts], min_docs)
        refs = []
        for block, hi, lo, n, top in parts:
            k = hi ^ lo
            hit = often[np.minimum(np.searchsorted(often, k), len(often) - 1)] == k if len(often) else np.zeros(len(k), bool)
            refs.append((np.full(int(hit.sum()), block, np.int64), hi[hit], lo[hit], n[hit], top[hit]))
        refs = [np.concatenate(x) for x in zip(*refs, strict=True)]
        shard = LineShard()
        shard.insert(*refs)
        hi, lo, top = shard.frequent(min_docs)
        known = LineShard()
        known._sorted(hi, lo, np.zeros(len(hi), np.int64), np.ones(len(hi), np.int64), top)
        known._rebuild()
        at = known._find(refs[1], refs[2])
        hit = np.flatnonzero(at >= 0)
        hit = hit[np.argsort(refs[0][hit], kind="stable")]
        out = []
        for part in np.split(hit, np.flatnonzero(np.diff(refs[0][hit])) + 1) if len(hit) else []:
            out.append((int(refs[0][part[0]]), B.pack(refs[1][part], refs[2][part], known.top[at[part]])))
        return B.rows(REPLY, list(zip(*out, strict=True)) or [[], []])

    return answer


def index(docs: DataFrame, state: DataFrame | None = None, n_shards: int = 16, spread: int = SPREAD, min_chars: int = MIN_CHARS, block_bytes: int = BLOCK) -> DataFrame:
    """The state of every shard after inserting docs, into ``state`` if given. Keep n_shards and spread for all later calls."""
    return _update(docs, state, "insert", n_shards, spread, min_chars, block_bytes)


def delete(docs: DataFrame, state: DataFrame, n_shards: int = 16, spread: int = SPREAD, min_chars: int = MIN_CHARS, block_bytes: int = BLOCK) -> DataFrame:
    """The states after deleting docs (as they were inserted): no other document is read."""
    return _update(docs, state, "delete", n_shards, spread, min_chars, block_bytes)


def _update(docs: DataFrame, state: DataFrame | None, what: str, n_shards: int, spread: int, min_chars: int, block_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    B.ready(spark)
    plain = B.documents(docs).where("doc_id IS NOT NULL")
    blocks = B.in_blocks(plain, B.text_bytes(plain), block_bytes)[0]
    state = state if state is not None else spark.createDataFrame([], "shard int, state binary")

    def send(t: pa.Table) -> pa.Table:
        d, k, own = _keys(t, min_chars)
        turn = B.mix(d.ids[own].view(np.uint64)) % np.uint64(spread)
        out = [(s, 0, B.pack(k[i, 0], k[i, 1], d.ids[own[i]])) for s, i in B.by_bucket(k[:, 0] + turn * np.uint64(0x9E3779B97F4A7C15), n_shards)]
        return B.rows(MESSAGE, list(zip(*out, strict=True)) or [[], [], []])

    def both(old: pa.Table, new: pa.Table) -> pa.Table:
        shard = LineShard.of(old.column("state")[0].as_py()) if old.num_rows else LineShard()
        if new.num_rows:
            hi, lo, ids = (np.concatenate(x) for x in zip(*(B.unpack(x) for x in new.column("blob").to_pylist()), strict=True))
            if what == "insert":
                shard.insert(ids, hi, lo, np.ones(len(ids), np.int64), ids)
            else:
                shard.delete(ids, hi, lo)
        return B.rows(STATE, [[(old if old.num_rows else new).column("shard")[0].as_py()], [shard.state()]])

    msgs = blocks.groupBy("block").applyInArrow(send, "shard int, block int, blob binary")
    state = state.toDF(*state.columns)
    return state.groupBy("shard").cogroup(msgs.groupBy("shard")).applyInArrow(both, "shard int, state binary")


def frequent(state: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """hi, lo and keeper (the largest doc_id) of the keys that at least so many documents hold."""

    def run(batches):
        for b in batches:
            for s in b.column("state").to_pylist():
                hi, lo, n, top = LineShard.of(s).counts()
                yield pa.record_batch({"hi": pa.array(hi.view(np.int64)), "lo": pa.array(lo.view(np.int64)), "n": pa.array(n), "keeper": pa.array(top)})

    got = state.mapInArrow(run, "hi long, lo long, n long, keeper long").groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))
    return got.where(F.col("n") >= min_docs).select("hi", "lo", "keeper")


def dedup(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, block_bytes: int = BLOCK, shard_bytes: int = SHARD, carry: tuple[str, ...] = (), digest: bool = True) -> DataFrame:
    """Drops frequent lines in all documents but the one with the largest id.

    Returns doc_id, n_lines, n_dropped and kept_sha256 or, without digest, doc_id, text and the carried columns.
    There is a shard for every ``shard_bytes`` of text; a message goes from each block to each shard, so both sizes grow with the input.
    """
    B.ready(spark)
    total = B.text_bytes(B.documents(docs))
    plain = B.wide(docs, carry)
    extra = tuple(plain.columns[2:])
    blocks, _ = B.in_blocks(plain, total, block_bytes, extra)
    msgs = blocks.groupBy("block").applyInArrow(_messages(max(8, total // shard_bytes), min_chars), "shard int, block int, blob binary")
    replies = msgs.groupBy("shard").applyInArrow(_replies(min_docs), "block int, blob binary")
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" if digest else "doc_id long, text string" + "".join(f", {c} {kinds[c]}" for c in extra)

    def finish(t: pa.Table, r: pa.Table) -> pa.Table:
        d = B.Docs(t)
        known = LineShard()
        if r.num_rows:
            hi, lo, top = (np.concatenate(x) for x in zip(*(B.unpack(x) for x in r.column("blob").to_pylist()), strict=True))
            known._sorted(hi, lo, np.zeros(len(hi), np.int64), np.ones(len(hi), np.int64), top)
            known._rebuild()
        n_lines, n_dropped, kept = [], [], []
        for me, raw in zip(d.ids, d.raw, strict=True):
            lines, at, keys = line_keys(raw, min_chars)
            found = known._find(keys[:, 0], keys[:, 1])
            drop = {at[i] for i in np.flatnonzero(found >= 0) if known.top[found[i]] != me}
            n_lines.append(len(lines))
            n_dropped.append(len(drop))
            kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else raw)
        if digest:
            return pa.table({"doc_id": d.doc_ids(), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())})
        rest = t.select(list(extra)).take(pa.array(d.order))
        no_text = t.column("text").combine_chunks().is_null().take(pa.array(d.order)).to_pylist()
        text = pa.array([None if no else x for x, no in zip(kept, no_text, strict=True)], pa.binary()).cast(pa.string())
        return pa.table([d.doc_ids(), text, *rest.columns], names=["doc_id", "text", *extra])

    out = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, schema)
    return out if digest else out.select("doc_id", "text", *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)))

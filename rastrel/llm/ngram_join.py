"""N-gram Jaccard join (operator 8): T-occurrence search with DivideSkip, and the classes it links.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Two documents can only link
if the shingles that come first in a common order, rarest first, meet. So the join runs in these steps:

1. Every block of documents sends its distinct shingles, cut to a few bits, to buckets, which answer
   with the magnitude of their document frequency.
2. Every block takes each set's prefix in the order (magnitude, hash). Prefix shingles that another
   document holds make candidates; these form candidate classes (components), computed in Spark.
3. Each candidate class, or each part of a large one (at most about ``part`` documents and PART_BYTES), is
   searched: inverted lists of the documents not yet reached; short lists are merged, long ones are
   probed by binary search (DivideSkip); pairs that share enough are checked exactly.
4. The parts of a large class are joined. First one member of each part's largest group stands for its
   part; these are searched in parts again, and so on until one is left: the main group. What is still
   outside goes to the parts that hold one of its prefix shingles, at most ``TURN`` senders a task.
5. Links, and equal sets, which are kept apart from the start, make the classes.

No list of pairs is ever made, no shingle is left out for being frequent, and there is no cap. A class
may hold most documents: what is looked up by class is found in a broadcast table for classes of over
a thousandth of all rows (fewer than a thousand), by a join for the others.

Nulls and ties: a null or empty text, or one without words, has an empty set and links with nothing.
A null doc_id is allowed; it counts as larger than all others in ``component_id`` (null only if the
class holds no id). Repeated rows are rows of their own and link. Very long texts are whole sets; words
are hashed for about a megabyte of whole texts at a time. An empty table gives an empty result. Other
columns are ignored; ``representatives`` carries named ones, whatever their names.
Hashes stand for shingles: 64 bits within a block, 48 where two sets of a class are compared; two
different shingles of a pair of documents collide about once in 10**9 pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _blocks as B
from ._components import components, local, look_up

WORDS, PERCENT = 5, 75
BLOCK, PART, PART_BYTES, TURN = 4 << 20, 512, 16 << 20, 64
_RANDOM = np.random.default_rng(8).integers(1, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    up, down = np.full(n, _STEP), np.full(n, inverse)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words, and the number of words of each document."""
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    off = np.cumsum([0] + [len(x) + 1 for x in raw])
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[lower] * up[:-1], out=total[1:])
    h = B.mix((total[end] - total[start]) * down[start])
    return h, np.diff(np.searchsorted(start, off))


def shingle_sets(raw: list[bytes], n: int = WORDS, piece: int = 1 << 20) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, worked out for about piece bytes of whole texts at a time."""
    out, group, size = [], [], 0
    for x in raw:
        group.append(x)
        size += len(x)
        if size > piece:
            out += _sets(group, n)
            group, size = [], 0
    return out + (_sets(group, n) if group else [])


def _sets(raw: list[bytes], n: int) -> list[np.ndarray]:
    h, count = words(raw)
    s = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        s += h[k : k + len(s)] * _RANDOM[256 + k]
    s = B.mix(s)
    out, at = [], 0
    for c in count.tolist():
        if c >= n:
            out.append(np.unique(s[at : at + c - n + 1]))
        elif c:
            out.append(B.mix(np.sum(h[at : at + c] * _RANDOM[266 : 266 + c], dtype=np.uint64, keepdims=True) + np.uint64(c)))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


class _Block:
    """Sets of the documents of a block, and for each the first document with the same set."""

    def __init__(self, t: pa.Table, n: int):
        self.block = t.column("block")[0].as_py()
        self.docs = B.Docs(t)
        self.sets = shingle_sets(self.docs.raw, n)
        first: dict[bytes, int] = {}
        self.rep = [first.setdefault(xxhash.xxh3_128_digest(s.tobytes()), i) if len(s) else i for i, s in enumerate(self.sets)]
        self.firsts = [i for i, r in enumerate(self.rep) if i == r and len(self.sets[i])]

    def cut(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct cut shingles of the block in order, and how many sets hold each."""
        if not self.firsts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return np.unique(np.concatenate([self.sets[i] for i in self.firsts]) >> np.uint64(64 - bits), return_counts=True)


def _count(bits: int, n_buckets: int, n: int):
    def send(t: pa.Table) -> pa.Table:
        b = _Block(t, n)
        keys, counts = b.cut(bits)
        out = [(s, b.block, B.pack(keys[i], np.minimum(counts[i], 1 << 30).astype(np.uint32))) for s, i in B.by_range(keys, bits, n_buckets)]
        return pa.table(dict(zip(("bucket", "block", "blob"), [pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[], [], []], (pa.int32(), pa.int32(), pa.binary()), strict=True)], strict=True)))

    return send


def _frequency(t: pa.Table) -> pa.Table:
    """Answers each message with the magnitude of the frequency of its shingles, in the same order."""
    parts = [B.unpack(x) for x in t.column("blob").to_pylist()]
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    first = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    total = np.add.reduceat(np.concatenate([p[1] for p in parts]).astype(np.int64)[order], np.flatnonzero(first))
    size = np.empty(len(keys), np.uint8)
    size[order] = np.floor(np.log2(total)).astype(np.uint8)[np.cumsum(first) - 1]
    ends = np.cumsum([len(p[0]) for p in parts])[:-1]
    return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "blob": pa.array([B.pack(x) for x in np.split(size, ends)], pa.binary())})


def _kept(s: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: enough to tell the shingles of a class apart."""
    return s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _set(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


FOUND = "block int, kind string, uid long, doc_id long, n_shingles long, rep long, cand long, bucket int, blob binary, ahead binary"
_FOUND = pa.schema([("block", pa.int32()), ("kind", pa.string()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("rep", pa.int64()), ("cand", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary()), ("ahead", pa.binary())])


def _prefixes(bits: int, n_buckets: int, n_meet: int, n: int, percent: int):
    def find(t: pa.Table, r: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _FOUND.empty_table()
        b = _Block(t, n)
        keys, _ = b.cut(bits)
        size = np.zeros(len(keys), np.uint8)
        answer = dict(zip(r.column("bucket").to_pylist(), r.column("blob").to_pylist(), strict=True)) if r.num_rows else {}
        for s, i in B.by_range(keys, bits, n_buckets):
            size[i] = B.unpack(answer[s])[0]
        base = b.block << 32
        shared, owner, mask = [], [], {}
        for i in b.firsts:
            s = b.sets[i]
            m = size[np.searchsorted(keys, s >> np.uint64(64 - bits))]
            p = len(s) - -(-percent * len(s) // 100) + 1
            ahead = np.argsort(m, kind="stable")[:p]  # s is in the order of its hashes
            ahead = ahead[m[ahead] > 0]
            if len(ahead):
                shared.append(s[ahead])
                owner.append(np.full(len(ahead), i))
                mask[i] = np.packbits(np.isin(np.arange(len(s)), ahead)).tobytes()
        cand: dict[int, int] = {}
        posts = []
        if shared:
            tok, own = np.concatenate(shared), np.concatenate(owner)
            o = np.lexsort((own, tok))
            tok, own = tok[o], own[o]
            same = np.flatnonzero(tok[1:] == tok[:-1])
            lab = local(len(b.docs), own[same], own[same + 1])
            cand = {int(i): base + int(lab[i]) for i in np.unique(own)}
            group = lab[own]
            o = np.lexsort((group, tok))
            tok, group = tok[o], group[o]
            keep = np.concatenate([[True], (tok[1:] != tok[:-1]) | (group[1:] != group[:-1])])
            tok, group = tok[keep], group[keep] + base
            posts = [(k, B.pack(tok[i], group[i])) for k, i in B.by_bucket(tok, n_meet)]
        d, k = len(b.docs), len(posts)
        ids = pa.concat_arrays([b.docs.doc_ids(), pa.nulls(k, pa.int64())])
        none = [None] * k
        return pa.table(
            [
                pa.array([b.block] * (d + k), pa.int32()),
                pa.array(["doc"] * d + ["post"] * k),
                pa.array([base + i for i in range(d)] + none, pa.int64()),
                ids,
                pa.array([len(s) for s in b.sets] + none, pa.int64()),
                pa.array([base + x for x in b.rep] + none, pa.int64()),
                pa.array([cand.get(i) for i in range(d)] + none, pa.int64()),
                pa.array([None] * d + [x[0] for x in posts], pa.int32()),
                pa.array([_kept(b.sets[i]) if i in cand else None for i in range(d)] + [x[1] for x in posts], pa.binary()),
                pa.array([mask.get(i) for i in range(d)] + none, pa.binary()),
            ],
            schema=_FOUND,
        )

    return find


def _meet(t: pa.Table) -> pa.Table:
    """Edges between the local groups that share a prefix shingle."""
    parts = [B.unpack(x) for x in t.column("blob").to_pylist()]
    tok, group = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    o = np.lexsort((group, tok))
    tok, group = tok[o], group[o]
    first = np.concatenate([[True], tok[1:] != tok[:-1]])
    head = group[np.flatnonzero(first)[np.cumsum(first) - 1]]
    e = np.unique(np.stack([head, group], 1)[head != group], axis=0)
    return pa.table({"a": e[:, 0], "b": e[:, 1]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


class Lists:
    """Inverted lists over sets, for T-occurrence queries."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray):
        self.sets, self.size = sets, np.array([len(s) for s in sets])
        tok = np.concatenate([sets[i] for i in members]) if len(members) else np.empty(0, np.uint64)
        own = np.repeat(members, self.size[members])
        o = np.lexsort((own, tok))
        tok, self.post = tok[o], own[o].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.empty(0, np.int64)
        self.tokens, self.start = tok[first], np.append(first, len(tok))
        self.flat = (np.repeat(np.arange(len(first)), np.diff(self.start)) << 32) | self.post

    def search(self, s: np.ndarray, percent: int, alive: np.ndarray) -> np.ndarray:
        """The living members whose Jaccard similarity with s is at least percent."""
        at = np.searchsorted(self.tokens, s)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == s)] if len(self.tokens) else at[:0]
        need = -(-percent * len(s) // 100)  # shared by any two that link
        if len(at) < need:
            return at[:0]
        length = self.start[at + 1] - self.start[at]
        order = np.argsort(length, kind="stable")
        longest = max(2, int(length[order[-1]]))
        n_long = min(need - 1, int(need / (0.1 * np.log2(longest) + 1)))
        short, long = at[order[: len(at) - n_long]], at[order[len(at) - n_long :]]
        k = self.start[short + 1] - self.start[short]
        total = int(k.sum())
        flat = np.arange(total) + np.repeat(self.start[short] - (np.cumsum(k) - k), k)
        found = self.post[flat]
        found = np.sort(found[alive[found]], kind="stable")  # merges the sorted lists
        if not len(found):
            return found
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        times = np.diff(np.append(first, len(found)))
        enough = times >= need - n_long
        doc, overlap = found[first[enough]], times[enough]
        if len(doc) and n_long:
            key = (long[None, :] << 32) | doc[:, None]
            hit = np.searchsorted(self.flat, key)
            overlap = overlap + (self.flat[np.minimum(hit, len(self.flat) - 1)] == key).sum(1)
        return doc[100 * overlap >= percent * (len(s) + self.size[doc] - overlap)]


def link(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each set the smallest index that links reach. Walks from set to set, searching only those not yet reached."""
    n = len(sets)
    label, alive = np.arange(n), np.ones(n, bool)
    lists, listed = Lists(sets, np.arange(n)), n
    for root in range(n):
        if not alive[root]:
            continue
        alive[root] = False
        queue = [root]
        while queue:
            left = int(alive.sum())
            if not left:
                break
            if left < listed // 2:
                lists, listed = Lists(sets, np.flatnonzero(alive)), left
            found = lists.search(sets[queue.pop()], percent, alive)
            alive[found] = False
            label[found] = root
            queue.extend(found.tolist())
        if not alive.any():
            break
    return label


LABEL = "uid long, comp long, sub int, parts int, label long, blob binary, ahead binary"
_LABEL = pa.schema([("uid", pa.int64()), ("comp", pa.int64()), ("sub", pa.int32()), ("parts", pa.int32()), ("label", pa.int64()), ("blob", pa.binary()), ("ahead", pa.binary())])


def _search(percent: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("comp", "ascending"), ("sub", "ascending"), ("uid", "ascending")])
        comp, uid = t.column("comp").to_numpy(), t.column("uid").to_numpy()
        sets = [_set(x) for x in t.column("blob").to_pylist()]
        label = np.empty(len(uid), np.int64)
        key = np.stack([comp, t.column("sub").to_numpy()], 1)
        for part in np.split(np.arange(len(uid)), np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1):
            label[part] = uid[part[link([sets[i] for i in part], percent)]]
        large = pa.array([n > 1 for n in t.column("parts").to_pylist()], pa.bool_())
        kept = [pa.compute.if_else(large, t.column(c).combine_chunks(), None) for c in ("blob", "ahead")]  # small classes are done
        return pa.table([t.column("uid"), t.column("comp"), t.column("sub"), t.column("parts"), pa.array(label), *kept], schema=_LABEL)

    return run


HEADS = "comp long, label long, `to` long, main boolean, n long, blob binary"
_HEADS = pa.schema([("comp", pa.int64()), ("label", pa.int64()), ("to", pa.int64()), ("main", pa.bool_()), ("n", pa.int64()), ("blob", pa.binary())])


def _unify(percent: int):
    """Of the heads of a class, or of a part of them, what each links to; the largest group is the main one, and its root goes on for all."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("uid")
        uid, n = t.column("uid").to_numpy(), t.column("n").to_numpy()
        root = link([_set(x) for x in t.column("blob").to_pylist()], percent)
        weight = np.bincount(root, weights=n)
        best = int(weight.argmax())
        top = np.arange(len(uid)) == best
        blob = pa.compute.if_else(pa.array(top), t.column("blob").combine_chunks(), None)
        return pa.table([t.column("comp"), pa.array(uid), pa.array(uid[root]), pa.array(root == best), pa.array(np.where(top, int(weight[best]), 0)), blob], schema=_HEADS)

    return run


def _main_groups(spark: SparkSession, large: DataFrame, percent: int, part: int) -> tuple[DataFrame, DataFrame]:
    """(comp, label, main) of the label that stands for each part, and the links (a, b) found between such labels."""
    count = large.groupBy("comp", "sub", "label").agg(F.count("*").alias("n")).groupBy("comp", "sub").agg(F.max_by("label", F.struct("n", "label")).alias("uid"), F.max("n").alias("n"))
    heads = large.where("uid = label").select("comp", "sub", "uid", "blob").join(count, ["comp", "sub", "uid"]).select("comp", "uid", "n", "blob")
    state, links = None, None
    while True:
        size = heads.groupBy("comp").agg(F.count("*").alias("n"), F.sum(F.octet_length("blob")).alias("bytes"))
        parts = F.ceil(F.greatest(F.col("n") / part, F.col("bytes") / PART_BYTES)).cast("int").alias("parts")
        dealt = look_up(heads.withColumnRenamed("n", "own"), size.select("comp", "n", parts), "comp", heads.count())
        dealt = dealt.select("comp", "uid", F.col("own").alias("n"), "blob", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int").alias("sub"))
        level = B.table(spark, dealt.groupBy("comp", "sub").applyInArrow(_unify(percent), HEADS), "heads")
        slim = level.select("comp", "label", "to", "main")
        links = (links.union if links else lambda x: x)(slim.select(F.col("label").alias("a"), F.col("to").alias("b")))
        if state is None:
            state = slim
        else:  # main if all that stood for it were; the next level's label is this one's root
            up = slim.select(F.col("label").alias("to"), F.col("to").alias("next"), F.col("main").alias("above"))
            state = state.join(up, "to", "left").select("comp", "label", F.coalesce("next", "to").alias("to"), (F.col("main") & F.coalesce("above", F.lit(False))).alias("main"))
        heads = level.where("blob IS NOT NULL").select("comp", F.col("label").alias("uid"), "n", "blob")
        if not heads.groupBy("comp").count().where("count > 1").limit(1).count():
            return state.select("comp", "label", "main"), links


def _ahead(blob: bytes, mask: bytes) -> np.ndarray:
    """The prefix shingles of a set."""
    s = _set(blob)
    return s[np.unpackbits(np.frombuffer(mask, np.uint8), count=len(s)).astype(bool)]


OFFER = "bucket int, comp long, sub int, held binary, asked binary"
_OFFER = pa.schema([("bucket", pa.int32()), ("comp", pa.int64()), ("sub", pa.int32()), ("held", pa.binary()), ("asked", pa.binary())])
ROUTE = "comp long, sub int, blob binary"
_ROUTE = pa.schema([("comp", pa.int64()), ("sub", pa.int32()), ("blob", pa.binary())])


def _offers(n_buckets: int):
    """A part's prefix shingles, and those of its documents outside the main group with their places (by uid), by buckets of shingles."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("uid")
        comp, sub = t.column("comp")[0].as_py(), t.column("sub")[0].as_py()
        ahead = [_ahead(x, m) for x, m in zip(t.column("blob").to_pylist(), t.column("ahead").to_pylist(), strict=True)]
        out = [i for i, m in enumerate(t.column("main").to_pylist()) if not m]
        held = {k: x for k, x in _dealt(np.unique(np.concatenate(ahead)), None, n_buckets)}
        asked = {}
        if out:
            tok, own = np.concatenate([ahead[i] for i in out]), np.repeat(out, [len(ahead[i]) for i in out]).astype(np.int32)
            o = np.lexsort((own, tok))
            asked = {k: x for k, x in _dealt(tok[o], own[o], n_buckets)}
        rows = [(k, comp, sub, held[k], asked.get(k)) for k in held]
        return B.rows(_OFFER, list(zip(*rows, strict=True)) or [[]] * 5)

    return run


def _dealt(tok: np.ndarray, own: np.ndarray | None, n: int):
    for k, i in B.by_bucket(tok, n):
        yield k, B.pack(tok[i]) if own is None else B.pack(tok[i], own[i])


def _routes(t: pa.Table) -> pa.Table:
    """Tells each part which of its documents have to go where: to the other parts of the class that hold one of their prefix shingles."""
    out = []
    comps = t.column("comp").to_numpy()
    for comp in np.unique(comps[t.column("asked").is_valid().to_numpy()]).tolist():
        own = t.filter(pa.compute.equal(t.column("comp"), comp))
        subs = own.column("sub").to_numpy()
        held = [B.unpack(x)[0] for x in own.column("held").to_pylist()]
        tok, sub = np.concatenate(held), np.repeat(subs, [len(x) for x in held])
        o = np.argsort(tok, kind="stable")
        tok, sub = tok[o], sub[o]
        for me, x in zip(subs.tolist(), own.column("asked").to_pylist(), strict=True):
            if x is None:
                continue
            ask, doc = B.unpack(x)
            a, z = np.searchsorted(tok, ask), np.searchsorted(tok, ask, side="right")
            n = z - a
            to = sub[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            pair = np.unique((np.repeat(doc.astype(np.int64), n) << 32) | to)
            pair = pair[(pair & 0xFFFFFFFF) != me]
            if len(pair):
                out.append((comp, me, B.pack((pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32))))
    return B.rows(_ROUTE, list(zip(*out, strict=True)) or [[]] * 3)


ASK = "comp long, sub int, turn int, label long, blob binary"
_ASK = pa.schema([("comp", pa.int64()), ("sub", pa.int32()), ("turn", pa.int32()), ("label", pa.int64()), ("blob", pa.binary())])


def _asks(t: pa.Table, r: pa.Table) -> pa.Table:
    """The sets that leave a part, one row for each part they go to."""
    if not t.num_rows or not r.num_rows:
        return _ASK.empty_table()
    t = t.sort_by("uid")
    doc, to = (np.concatenate(x) for x in zip(*(B.unpack(x) for x in r.column("blob").to_pylist()), strict=True))
    pair = np.unique((doc.astype(np.int64) << 32) | to)
    doc, to = pa.array(pair >> 32), (pair & 0xFFFFFFFF).astype(np.int32)
    n = len(pair)
    turn = np.full(n, t.column("sub")[0].as_py() // TURN, np.int32)
    return pa.table([pa.array(np.full(n, t.column("comp")[0].as_py())), pa.array(to), pa.array(turn), t.column("label").take(doc), t.column("blob").take(doc)], schema=_ASK)


def _across(percent: int):
    def run(part: pa.Table, ask: pa.Table) -> pa.Table:
        # links between labels
        out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        if not part.num_rows or not ask.num_rows:
            return out.empty_table()
        lab = part.column("label").to_numpy()
        lists = Lists([_set(x) for x in part.column("blob").to_pylist()], np.arange(len(lab)))
        a, b = [], []
        for m, x in zip(*(ask.column(c).to_pylist() for c in ("label", "blob")), strict=True):
            found = lists.search(_set(x), percent, lab != m)
            hit = np.unique(lab[found])
            a += [m] * len(hit)
            b += hit.tolist()
        return pa.table({"a": a, "b": b}, schema=out)

    return run


def _outside(spark: SparkSession, large: DataFrame, percent: int, part: int, n_buckets: int) -> DataFrame:
    """(label, end): the smallest label that the links between the parts of large classes reach."""
    state, links = _main_groups(spark, large, percent, part)
    now = large.join(state, ["comp", "label"], "left").select("uid", "comp", "sub", "label", F.coalesce("main", F.lit(False)).alias("main"), "blob", "ahead")
    now = B.table(spark, now, "inside")
    route = now.groupBy("comp", "sub").applyInArrow(B.trimmed(_offers(n_buckets)), OFFER).groupBy("bucket").applyInArrow(B.trimmed(_routes), ROUTE)
    ask = now.groupBy("comp", "sub").cogroup(route.groupBy("comp", "sub")).applyInArrow(B.trimmed(_asks), ASK)
    ask = B.table(spark, ask, "asks")
    # a part that many ask is searched in turns
    inside = now.select("comp", "sub", "label", "blob").join(ask.select("comp", "sub", "turn").distinct(), ["comp", "sub"])
    inside, ask = (x.toDF(*x.columns) for x in (inside, ask))  # told apart by name
    across = inside.groupBy("comp", "sub", "turn").cogroup(ask.groupBy("comp", "sub", "turn")).applyInArrow(B.trimmed(_across(percent)), "a long, b long")
    return components(links.union(across)).toDF("label", "end")


def _labels(spark: SparkSession, docs: DataFrame, n: int, percent: int, block_bytes: int, part: int) -> tuple[DataFrame, int, int]:
    """block, uid, doc_id, n_shingles and label (that of its class) of every row; the number of rows at most, and that of blocks."""
    total = B.text_bytes(docs)
    blocks, n_blocks = B.in_blocks(docs, total, block_bytes)
    most = max(1, total // B.ROW_BYTES)
    bits = min(64, max(32, int(np.ceil(np.log2(max(2, total / 4)))) + 13))
    n_buckets = max(8, n_blocks // 4)
    n_meet = max(24, n_blocks // 8)  # an edge may be found in each of these
    n_files = max(8, n_blocks // 4)
    blocks = blocks.repartition(n_files, "block")  # as the table of prefixes is bucketed: a task writes one file
    asked = blocks.groupBy("block").applyInArrow(B.trimmed(_count(bits, n_buckets, n)), "bucket int, block int, blob binary")
    told = asked.groupBy("bucket").applyInArrow(B.trimmed(_frequency), "block int, bucket int, blob binary").repartition(n_files, "block")
    found = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(B.trimmed(_prefixes(bits, n_buckets, n_meet, n, percent)), FOUND)
    with B.bucketed(spark, found, "prefixes", "block", n_files) as (found, plain):
        edges = found.where("kind = 'post'").select("bucket", "blob").groupBy("bucket").applyInArrow(_meet, "a long, b long")
        group = components(edges)
        cand = found.where("kind = 'doc' AND cand IS NOT NULL")
        slim = cand.select("block", "uid", "cand", F.octet_length("blob").alias("size")).join(group.withColumnRenamed("node", "cand"), "cand", "left").select("block", "uid", "size", F.coalesce("label", "cand").alias("comp"))
        many = slim.groupBy("comp").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
        parts = F.ceil(F.greatest(F.col("n") / part, F.col("bytes") / PART_BYTES)).cast("int").alias("parts")
        slim = look_up(slim.select("block", "uid", "comp"), many.select("comp", "n", parts), "comp", most)
        # the sets stay where they are; where each one goes is told to its block
        told = slim.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("uid", F.struct("comp", "parts")))).alias("to"))
        dealt = cand.select("block", "uid", "blob", "ahead").join(told, "block").withColumn("t", F.try_element_at("to", F.col("uid"))).where("t IS NOT NULL")
        dealt = dealt.select("uid", "t.comp", "t.parts", F.pmod(F.xxhash64("uid"), F.col("t.parts")).cast("int").alias("sub"), "blob", "ahead")
        bin_ = F.when(F.col("parts") > 1, F.xxhash64("comp", "sub")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(max(12, n_blocks))))
        done = B.table(spark, dealt.withColumn("bin", bin_).groupBy("bin").applyInArrow(B.trimmed(_search(percent)), LABEL), "parts")
    label = done.select(F.col("uid").alias("rep"), "label")

    large = done.where("parts > 1")
    if large.limit(1).count():
        joined = _outside(spark, large, percent, part, n_meet)
        label = label.join(joined, "label", "left").select("rep", F.coalesce("end", "label").alias("label"))

    # equal sets of a block share the label of their first
    rows = plain.where("kind = 'doc'").select("block", "uid", "doc_id", "n_shingles", "rep").join(label, "rep", "left")
    return rows.select("block", "uid", "doc_id", "n_shingles", F.coalesce("label", "rep").alias("label")), most, n_blocks


def classes(spark: SparkSession, docs: DataFrame, n: int = WORDS, percent: int = PERCENT, block_bytes: int = BLOCK, part: int = PART) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reached by links) of every row of docs."""
    B.ready(spark)
    rows, most, _ = _labels(spark, B.documents(docs), n, percent, block_bytes, part)
    least = rows.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    return look_up(rows, least, "label", most).select("doc_id", "n_shingles", "component_id")


def representatives(spark: SparkSession, docs: DataFrame, carry: tuple[str, ...] = (), n: int = WORDS, percent: int = PERCENT, block_bytes: int = BLOCK, part: int = PART) -> DataFrame:
    """doc_id, text and the carried columns of one row of each class: the least doc_id (rows without one come last), of its rows the first by text."""
    B.ready(spark)
    rows, most, n_blocks = _labels(spark, B.documents(docs), n, percent, block_bytes, part)
    first = rows.groupBy("label").agg(F.min_by("uid", F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = look_up(rows.select("block", "uid", "label"), first, "label", most).where("uid <> first").groupBy("block").agg(F.collect_list(F.col("uid").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("gone"))
    wide = B.wide(docs, carry)
    key = B.in_blocks(wide, n_blocks, 1, tuple(c for c in wide.columns[2:]))[0]
    kinds = {f.name: f.dataType.simpleString() for f in wide.schema}
    names = wide.columns

    def keep(t: pa.Table, g: pa.Table) -> pa.Table:
        t = t.select(names)
        if t.num_rows and g.num_rows:
            order = B.Docs(t).order
            t = t.take(pa.array(np.sort(np.delete(order, g.column("gone")[0].as_py()))))
        return t

    left = key.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(keep, ", ".join(f"{c} {kinds[c]}" for c in names))
    return left.select("doc_id", F.col("text").cast("string").alias("text"), *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)))

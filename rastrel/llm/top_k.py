"""Exact top-k search by inner product (operator 10): ball-tree branch and bound per shard.

Every vector is indexed. Vectors near the same one of up to ``MOST_CELLS`` centres go to the same shards, of
about ``shard_rows`` vectors each; the centres come from a sample of at most ``SAMPLE`` vectors a centre and
only make balls small, results don't depend on them. Each shard builds a ball tree over its distinct vectors.
Queries are a stated set; they travel in blocks of near ones. The search runs in these steps:

1. The roots of all trees (centre, radius) are kept in a table of their own, by groups. Every block is held
   against every group; each query goes to the shard whose root has the largest upper bound q.c + |q| r
   (to the next ones too, if those before hold under k + 1 rows), and the best leaves there give it a first
   kth score.
2. Every block is held against the roots again, and each query is sent to the shards whose root bound
   reaches its kth score, and to no other. A shard keeps a queue of nodes, the one with the largest bound
   first; a node is opened only for the queries whose kth score it can reach.
3. What the shards return is merged by query.

Of equal vectors only the k + 1 smallest ids can be among the results (one may be the query's own), so no
more of them leave a batch or are kept in a shard; that is exact and keeps copies from filling a shard.
A tree goes to one task for every ``TURN`` blocks that ask it.

Vectors that are null or hold null or non-finite components (before or after scaling) take no part; vectors
of different length don't meet. Ties go to the smaller vec_id; a null vec_id is no query and comes last.
Repeated rows are queries and candidates of their own: a query leaves out one row with its id and vector.
Other columns are ignored. An empty table gives an empty result.

Scores are exact: sums of products that may leave 53 bits are added as 64-bit integers, those that may leave
64 bits as Python's integers. Scores beyond 64 bits are held at the limits, and tie there. kth scores travel
as integers and are rounded down where they are compared with a bound.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _blocks as B

K, SCALE, EVERY = 20, 64, 20
SHARD_ROWS, BLOCK_ROWS, LEAF = 8192, 512, 128
MOST_CELLS, SAMPLE, TURN, ROOTS = 1024, 64, 64, 1024
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float | None = SCALE) -> DataFrame:
    """vec_id, vec (double) and dim, only whole vectors."""
    v = F.col(vec_col)
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * F.lit(float(scale or 1))) < F.lit(float("inf"))))
    return df.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vec")).withColumn("dim", F.size("vec"))


def _matrix(vec: pa.Array, dim: int, scale: float | None) -> np.ndarray:
    m = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), dim)
    return np.floor(m * scale) if scale else m


def _ids(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(x.fill_null(HIGH)).astype(np.int64), np.asarray(x.is_null())


def _whole(t: pa.Table, c: str) -> pa.Array:
    x = t.column(c)
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: where each begins, and the rank of every row in its run."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return first, np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))


def _codes(m: np.ndarray) -> np.ndarray:
    """Equal numbers for equal vectors."""
    if not m.shape[1]:
        return np.zeros(len(m), np.int64)
    return np.unique(np.ascontiguousarray(m + 0.0).view(f"V{m.shape[1] * 8}").ravel(), return_inverse=True)[1]


class BallTree:
    """Nodes in arrays: the rows lo..hi of the reordered points, centre, radius, children (or -1)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        nodes: list[list[int]] = []
        centre, radius = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            p = points[self.order[lo:hi]]
            c = p.mean(0)
            if parent >= 0:
                nodes[parent][2 + side] = len(nodes)
            me = len(nodes)
            nodes.append([lo, hi, -1, -1])
            centre.append(c)
            # rounding must not make a ball too small
            radius.append(np.sqrt(((p - c) ** 2).sum(1).max()) * (1 + 1e-9) + 1e-9 + 1e-12 * np.abs(p).max(initial=0) * max(1, p.shape[1]))
            if hi - lo > leaf and np.isfinite(radius[-1]):
                far = p[((p - c) ** 2).sum(1).argmax()]
                other = p[((p - far) ** 2).sum(1).argmax()]
                o = np.argsort(p @ (other - far), kind="stable")
                self.order[lo:hi] = self.order[lo:hi][o]
                mid = (lo + hi) // 2
                todo += [(mid, hi, me, 1), (lo, mid, me, 0)]
        self.nodes, self.centre, self.radius = np.array(nodes), np.array(centre), np.array(radius)


def bounds(q: np.ndarray, norm: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries (rows) with what the balls (columns) hold; rounding never makes one too small."""
    with np.errstate(all="ignore"):
        most = norm[:, None] * (np.sqrt((centre * centre).sum(1)) + radius)[None, :]
        out = q @ centre.T + norm[:, None] * radius[None, :] + 1e-9 * most + 1e-6
    return np.where(np.isnan(out), np.inf, out)


def _down(kth: np.ndarray) -> np.ndarray:
    """Integers as floats that are no larger."""
    return np.nextafter(kth.astype(np.float64), -np.inf)


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products of vectors of whole numbers, held within 64 bits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(1, q.shape[1])
    if most < float(1 << 53):
        return (q @ p.T).astype(np.int64)
    if most < float(1 << 62) and max(np.abs(q).max(), np.abs(p).max()) < float(1 << 62):
        return q.astype(np.int64) @ p.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return (whole(q) @ whole(p).T).clip(LOW, HIGH).astype(np.int64)


class Shard:
    """A ball tree over the distinct vectors of a shard and the smallest ids of each."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, null: np.ndarray, keep: int):
        code = _codes(points)
        o = np.lexsort((ids, null, code))
        code, points, ids, null = code[o], points[o], ids[o], null[o]
        first, rank = _runs(code)
        self.tree = BallTree(points[first])
        self.points = points[first][self.tree.order]
        few = rank < keep
        size = np.minimum(np.diff(np.append(first, len(code))), keep)
        n = size[self.tree.order]
        flat = np.repeat((np.cumsum(size) - size)[self.tree.order] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.start = np.concatenate([[0], np.cumsum(n)])
        self.ids, self.null = ids[few][flat], null[few][flat]

    def pack(self) -> bytes:
        t = self.tree
        return B.pack(self.points.ravel(), self.start, self.ids, self.null, t.nodes.ravel(), t.centre.ravel(), t.radius)

    @classmethod
    def of(cls, blob: bytes, dim: int) -> Shard:
        x, t = cls.__new__(cls), BallTree.__new__(BallTree)
        p, x.start, x.ids, x.null, nodes, centre, t.radius = B.unpack(blob)
        t.nodes = nodes.reshape(-1, 4)
        x.points, t.centre = p.reshape(len(x.start) - 1, dim), centre.reshape(len(t.nodes), dim)
        x.tree = t
        return x

    def search(self, q: np.ndarray, own: np.ndarray, own_null: np.ndarray, k: int, kth: np.ndarray, first_leaf: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place of the id, score) of what can be among each query's k best; kth: scores known to be reached, or LOW."""
        t, kth = self.tree, kth.copy()
        norm = np.sqrt((q * q).sum(1)) * (1 + 1e-9)
        bound = lambda n, who: bounds(q[who], norm[who], t.centre[n : n + 1], t.radius[n : n + 1])[:, 0]
        everyone = np.arange(len(q))
        heap = [(-float(bound(0, everyone).max(initial=-np.inf)), 0, everyone)]
        got = [np.empty(0, np.int64)] * 3
        seen = np.zeros(len(q), bool)
        while heap:
            _, n, who = heapq.heappop(heap)
            if first_leaf:
                who = who[~seen[who]]
            who = who[bound(n, who) >= _down(kth[who])]
            if not len(who):
                continue
            lo, hi, left, right = t.nodes[n]
            if left >= 0:
                pair = np.stack([bound(c, who) for c in (left, right)])
                for j, c in enumerate((left, right)):
                    mine = pair[j] >= np.maximum(pair[1 - j], _down(kth[who])) if first_leaf else pair[j] >= _down(kth[who])
                    if mine.any():
                        heapq.heappush(heap, (-float(pair[j][mine].max()), int(c), who[mine]))
                continue
            seen[who] = True
            s = products(q[who], self.points[lo:hi])
            a, b = np.nonzero(s >= kth[who][:, None])
            m = self.start[lo + b + 1] - self.start[lo + b]
            flat = np.repeat(self.start[lo + b] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            new = [np.repeat(who[a], m), flat, np.repeat(s[a, b], m)]
            # the query's own row: one with its id and vector
            same = np.repeat((q[who[a]] == self.points[lo + b]).all(1), m)
            w = np.flatnonzero(same & (self.ids[flat] == own[new[0]]) & (self.null[flat] == own_null[new[0]]))
            mine = np.zeros(len(flat), bool)
            mine[w[np.unique(new[0][w], return_index=True)[1]]] = True
            x = [np.concatenate([g, y[~mine]]) for g, y in zip(got, new, strict=True)]
            o = np.lexsort((self.ids[x[1]], self.null[x[1]], ~x[2], x[0]))
            x = [y[o] for y in x]
            _, rank = _runs(x[0])
            full = rank == k - 1
            kth[x[0][full]] = np.maximum(kth[x[0][full]], x[2][full])
            got = [y[rank < k] for y in x]
        return got[0], got[1], got[2]


def _centres(x: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """n centres of the sample's rows: rows chosen by squared distance from those chosen before, then a few rounds of means."""
    rng, at = np.random.default_rng(0), [0]
    far = np.full(len(x), np.inf)
    with np.errstate(all="ignore"):
        while len(at) < n:
            far = np.minimum(far, np.nan_to_num(((x - x[at[-1]]) ** 2).sum(1), nan=0.0))
            total = np.cumsum(far / max(1e-300, far.max()))
            at.append(int(np.searchsorted(total, rng.random() * total[-1])) if total[-1] > 0 else len(at) % len(x))
    c = x[at]
    for _ in range(rounds):
        at = _nearest(x, c)
        count = np.bincount(at, minlength=n)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(count[:, None] > 0, total / np.maximum(1, count)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.nan_to_num((c * c).sum(1)[None, :] - 2 * (x @ c.T), nan=np.inf).argmin(1)


class Cells:
    """Centres by length of vectors, and how many shards (or blocks) each cell is dealt over."""

    def __init__(self, centres: dict[int, np.ndarray]):
        self.centres, self.parts, self.other = centres, {}, 1

    @classmethod
    def fit(cls, v: DataFrame, n: int, shard_rows: int, scale: float | None) -> Cells:
        """Centres from the rows with the least hashes: SAMPLE for each of about n / shard_rows cells, at most MOST_CELLS."""
        cells = min(MOST_CELLS, -(-n // shard_rows))
        if cells < 2:
            return cls({})
        t = v.orderBy(F.xxhash64("vec_id", "vec"), "vec_id", "vec").limit(SAMPLE * cells).select("dim", "vec").toArrow()
        dims = t.column("dim").to_numpy()
        out = {}
        for d in np.unique(dims[dims > 0]).tolist():
            m = _matrix(_whole(t.filter(pa.array(dims == d)), "vec"), d, scale)
            out[d] = _centres(m, max(1, round(cells * len(m) / len(dims))))
        return cls(out)

    def of(self, b: pa.RecordBatch, scale: float | None) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(dim, places, vectors, cell) for each length in a batch."""
        dims = b.column("dim").to_numpy()
        out = []
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            m = _matrix(b.column("vec").take(pa.array(at)), d, scale)
            out.append((d, at, m, _nearest(m, self.centres[d]) if d in self.centres else np.zeros(len(m), np.int64)))
        return out

    def dealt(self, v: DataFrame, rows: int, scale: float | None) -> Cells:
        """The same centres; the counts of v's rows say over how many parts each cell goes."""
        new = Cells(self.centres)

        def count(batches):
            for b in batches:
                for d, _, _, c in self.of(b, scale):
                    u, n = np.unique(c, return_counts=True)
                    yield pa.record_batch({"dim": pa.array(np.full(len(u), d if d in self.centres else -1), pa.int32()), "cell": pa.array(u, pa.int32()), "n": pa.array(n, pa.int64())})

        for r in v.select("dim", "vec").mapInArrow(count, "dim int, cell int, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n")).collect():  # a row for each centre
            if r.dim < 0:
                new.other = max(1, -(-r.n // rows))
            else:
                new.parts.setdefault(r.dim, np.ones(len(self.centres[r.dim]), np.int64))[r.cell] = max(1, -(-r.n // rows))
        return new

    def number(self, d: int, cell: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The shard (or block) of rows of length d, by cell and a salt."""
        parts = self.parts.get(d)
        if parts is None:
            return (B.mix(salt) % np.uint64(self.other)).astype(np.int32)
        first = np.cumsum(parts) - parts
        return (first[cell] + (B.mix(salt) % parts[cell].astype(np.uint64)).astype(np.int64)).astype(np.int32)


_OUT = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
OUT = "dim int, block int, row long, query_id long, vec_id long, score long"
_ASK = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("turn", pa.int32()), ("block", pa.int32()), ("asks", pa.binary())])
ASK = "dim int, shard int, turn int, block int, asks binary"
_SCORES = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("blob", pa.binary())])
SCORES = "dim int, block int, blob binary"


def search(spark: SparkSession, df: DataFrame, queries: Column | None = None, k: int = K, scale: float | None = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows of every query, exactly.

    queries: which rows ask (by vec_id); every one divisible by 20 unless stated. Without a scale the components must be whole numbers.
    """
    B.ready(spark)
    v = vectors(df, id_col, vec_col, scale)
    asking = v.where(F.col("vec_id") % EVERY == 0 if queries is None else queries)
    cells = Cells.fit(v, v.count(), shard_rows, scale)
    shards, packs = cells.dealt(v, shard_rows, scale), cells.dealt(asking, block_rows, scale)

    def spread(batches):
        for b in batches:
            for d, at, m, cell in shards.of(b, scale):
                ids, null = _ids(b.column("vec_id").take(pa.array(at)))
                # of equal vectors the k + 1 smallest ids
                code = _codes(m)
                o = np.lexsort((ids, null, code))
                few = np.sort(o[_runs(code[o])[1] <= k])
                shard = shards.number(d, cell[few], b.column("salt").to_numpy()[at[few]].view(np.uint64))
                yield pa.record_batch({"dim": pa.array(np.full(len(few), d, np.int32)), "shard": pa.array(shard), "vec_id": b.column("vec_id").take(pa.array(at[few])), "vec": pa.ListArray.from_arrays(pa.array(np.arange(len(few) + 1) * d, pa.int32()), pa.array(m[few].ravel()))})

    def build(t: pa.Table) -> pa.Table:
        d = t.column("dim")[0].as_py()
        ids, null = _ids(_whole(t, "vec_id"))
        x = Shard(_matrix(_whole(t, "vec"), d, None), ids, null, k + 1)
        root = B.pack(x.tree.centre[0], x.tree.radius[:1], np.array([len(x.ids)]))
        return pa.table({"dim": t.column("dim").slice(0, 1), "shard": t.column("shard").slice(0, 1), "tree": pa.array([x.pack()], pa.binary()), "root": pa.array([root], pa.binary())})

    salted = v.select("dim", "vec_id", "vec", F.xxhash64("vec_id", "vec").alias("salt"))
    made = salted.mapInArrow(spread, "dim int, shard int, vec_id long, vec array<double>").groupBy("dim", "shard").applyInArrow(B.trimmed(build), "dim int, shard int, tree binary, root binary")
    made = B.table(spark, made, "trees")
    trees = made.select("dim", "shard", "tree")

    def pack_blocks(batches):
        for b in batches:
            for d, at, m, cell in packs.of(b, scale):
                block = packs.number(d, cell, b.column("salt").to_numpy()[at].view(np.uint64))
                yield pa.record_batch({"dim": pa.array(np.full(len(at), d, np.int32)), "block": pa.array(block), "vec_id": b.column("vec_id").take(pa.array(at)), "vec": pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * d, pa.int32()), pa.array(m.ravel()))})

    def gather(t: pa.Table) -> pa.Table:
        m = _matrix(_whole(t, "vec"), t.column("dim")[0].as_py(), None)
        return pa.table({"dim": t.column("dim").slice(0, 1), "block": t.column("block").slice(0, 1), "asks": pa.array([B.pack(m.ravel(), *_ids(_whole(t, "vec_id")))], pa.binary())})

    # rows that repeat are dealt by their place, so that copies of one query don't fill a block; the blocks are written once
    placed = asking.select("dim", "vec_id", "vec", F.monotonically_increasing_id().alias("salt"))
    blocks = placed.mapInArrow(pack_blocks, "dim int, block int, vec_id long, vec array<double>").groupBy("dim", "block").applyInArrow(gather, "dim int, block int, asks binary")
    blocks = B.table(spark, blocks, "queries").withColumn("turn", F.floor(F.col("block") / TURN).cast("int"))

    def group(t: pa.Table) -> pa.Table:
        c, r, n = zip(*(B.unpack(x) for x in t.column("root").to_pylist()), strict=True)
        return pa.table({"dim": t.column("dim").slice(0, 1), "grp": t.column("grp").slice(0, 1), "roots": pa.array([B.pack(t.column("shard").to_numpy(), *(np.concatenate(y) for y in (c, r, n)))], pa.binary())})

    roots = made.select("dim", "shard", "root", F.floor(F.col("shard") / ROOTS).cast("int").alias("grp")).groupBy("dim", "grp").applyInArrow(group, "dim int, grp int, roots binary")
    # each group of roots meets the blocks of a turn
    roots = B.table(spark, roots, "roots")
    turns = blocks.select("dim", "turn").distinct()
    meet = roots.join(turns, "dim")
    groups = meet.select("dim", "grp", "turn")

    def against(side: DataFrame, run, schema: str) -> DataFrame:
        asks = side.join(groups, ["dim", "turn"])
        return meet.groupBy("dim", "grp", "turn").cogroup(asks.toDF(*asks.columns).groupBy("dim", "grp", "turn")).applyInArrow(run, schema)

    def held(r: pa.Table, d: int) -> tuple[np.ndarray, ...]:
        shard, c, radius, n = B.unpack(r.column("roots")[0].as_py())
        return shard, c.reshape(len(shard), d), radius, n

    def enough(who: np.ndarray, bound: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Places of the shards with the largest bounds that together hold more than k rows, for each query."""
        o = np.lexsort((-bound, who))
        first, _ = _runs(who[o])
        before = np.cumsum(n[o]) - n[o]
        return o[before - np.repeat(before[first], np.diff(np.append(first, len(o)))) <= k]

    def best(r: pa.Table, t: pa.Table) -> pa.Table:
        out = []
        if r.num_rows and t.num_rows:
            d = r.column("dim")[0].as_py()
            shard, c, radius, n = held(r, d)
            for block, x in zip(t.column("block").to_pylist(), t.column("asks").to_pylist(), strict=True):
                q, ids, _ = B.unpack(x)
                q = q.reshape(len(ids), d)
                bound = bounds(q, np.sqrt((q * q).sum(1)), c, radius)
                who, at = np.repeat(np.arange(len(q)), len(shard)), np.tile(np.arange(len(shard)), len(q))
                few = enough(who, bound.ravel(), n[at])
                out.append((d, block, B.pack(who[few], shard[at[few]], bound.ravel()[few], n[at[few]])))
        return B.rows(_SCORES, list(zip(*out, strict=True)) or [[]] * 3)

    def ask_row(d: int, shard: int, block: int, who: np.ndarray, x: list[np.ndarray], kth: np.ndarray) -> tuple:
        q, ids, null = x[0].reshape(len(x[1]), d), x[1], x[2]
        return d, shard, block // TURN, block, B.pack(who.astype(np.int64), q[who].ravel(), ids[who], null[who], kth[who])

    def choose(t: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if t.num_rows and b.num_rows:
            d, block, x = b.column("dim")[0].as_py(), b.column("block")[0].as_py(), B.unpack(b.column("asks")[0].as_py())
            who, shard, bound, n = (np.concatenate(y) for y in zip(*(B.unpack(z) for z in t.column("blob").to_pylist()), strict=True))
            few = enough(who, bound, n)
            who, shard = who[few], shard[few]
            out = [ask_row(d, s, block, np.sort(who[shard == s]), x, np.full(len(x[1]), LOW)) for s in np.unique(shard).tolist()]
        return B.rows(_ASK, list(zip(*out, strict=True)) or [[]] * 5)

    def visit(asks: DataFrame, run, schema: str) -> DataFrame:
        where = trees.join(asks.select("dim", "shard", "turn").distinct(), ["dim", "shard"])
        asks = asks.toDF(*asks.columns)
        return where.groupBy("dim", "shard", "turn").cogroup(asks.groupBy("dim", "shard", "turn")).applyInArrow(B.trimmed(run), schema)

    def seed(t: pa.Table, a: pa.Table) -> pa.Table:
        out = []
        if t.num_rows and a.num_rows:
            d = t.column("dim")[0].as_py()
            shard = Shard.of(t.column("tree")[0].as_py(), d)
            for block, x in zip(a.column("block").to_pylist(), a.column("asks").to_pylist(), strict=True):
                who, q, ids, null, kth = B.unpack(x)
                at, _, score = shard.search(q.reshape(len(ids), d), ids, null, k, kth, first_leaf=True)
                out.append((d, block, B.pack(who[at], score)))
        return B.rows(_SCORES, list(zip(*out, strict=True)) or [[]] * 3)

    def share(t: pa.Table) -> pa.Table:
        who, score = (np.concatenate(x) for x in zip(*(B.unpack(x) for x in t.column("blob").to_pylist()), strict=True))
        o = np.lexsort((~score, who))
        who, score = who[o], score[o]
        full = _runs(who)[1] == k - 1  # the kth of each query that has so many
        return B.rows(_SCORES, [t.column("dim").slice(0, 1).combine_chunks(), t.column("block").slice(0, 1).combine_chunks(), [B.pack(who[full], score[full])]])

    def send(r: pa.Table, t: pa.Table) -> pa.Table:
        out = []
        if r.num_rows and t.num_rows:
            d = r.column("dim")[0].as_py()
            shard, c, radius, _ = held(r, d)
            for block, asked, known in zip(*(t.column(x).to_pylist() for x in ("block", "asks", "blob")), strict=True):
                x = B.unpack(asked)
                q = x[0].reshape(len(x[1]), d)
                kth = np.full(len(q), LOW)
                if known is not None:
                    who, score = B.unpack(known)
                    kth[who] = score
                reach = bounds(q, np.sqrt((q * q).sum(1)) * (1 + 1e-9), c, radius) >= _down(kth)[:, None]
                out += [ask_row(d, int(shard[j]), block, np.flatnonzero(reach[:, j]), x, kth) for j in np.flatnonzero(reach.any(0))]
        return B.rows(_ASK, list(zip(*out, strict=True)) or [[]] * 5)

    def find(t: pa.Table, a: pa.Table) -> pa.Table:
        out = [_OUT.empty_table()]
        if t.num_rows and a.num_rows:
            d = t.column("dim")[0].as_py()
            shard = Shard.of(t.column("tree")[0].as_py(), d)
            for block, x in zip(a.column("block").to_pylist(), a.column("asks").to_pylist(), strict=True):
                who, q, ids, null, kth = B.unpack(x)
                at, got, score = shard.search(q.reshape(len(ids), d), ids, null, k, kth)
                n = len(at)
                out.append(pa.table([pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(who[at]), pa.array(ids[at], mask=null[at]), pa.array(shard.ids[got], mask=shard.null[got]), pa.array(score)], schema=_OUT))
        return pa.concat_tables(out).combine_chunks()

    first = against(blocks, best, SCORES).groupBy("dim", "block").cogroup(blocks.groupBy("dim", "block")).applyInArrow(choose, ASK)
    kth = visit(B.table(spark, first, "first-asks"), seed, SCORES).groupBy("dim", "block").applyInArrow(share, SCORES)
    kth = B.table(spark, kth, "kth")
    asks = B.table(spark, against(blocks.join(kth, ["dim", "block"], "left"), send, ASK), "asks")
    found = visit(asks, find, OUT)
    w = Window.partitionBy("dim", "block", "row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

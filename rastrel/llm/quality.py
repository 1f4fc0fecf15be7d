"""Quality classifier (operator 6): a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins; cyclic boosting adds a small step of a shallow tree to
one table after the other, on the residuals of all others. Then the pairs of features that explain most
of what is left get tables of their own, by steps of shallow trees that cut along either feature. A score is the sum of table entries, looked up by bins, passed
through the logistic function.

Features are counts over the whole text: kinds of characters, lengths of words and lines, repeated
words and lines. Neither language, source, id nor labels are inputs.

The model is fitted on at most ``max_rows`` labelled documents (20,000; those with the smallest hash of
doc_id), which bounds what reaches the driver: so many labels are looked for, and of the rows that share their
ids so many again are taken, by hash of id and text. Labels that are null are left out; without labelled rows
the score is 0.5, with one class only it is near that class. Null or empty texts are scored as texts
without characters. Repeated rows get equal scores. Very long texts are scored whole, in a batch of their
own. Scores tie where all bins do. Other columns are passed through when named in ``carry``, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _blocks as B
from .ngram_join import words

MAX_ROWS, BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 20_000, 32, 8, 8, 250, 60, 0.1
THRESHOLD, FOLDS = 0.3, 5
PIECE = 1 << 20

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n\r\x0b\x0c",
    "stop": b".,;:'\"-",
    "shout": b"!?",
    "mark": b"#$%&*+/<=>@[\\]^_`{|}~()",
    "beyond": bytes(range(128, 256)),
}
NAMES = [*_KINDS, "log_length", "word_length", "long_word", "word_ends_odd", "word_repeats", "words_new", "lines_new", "line_length", "same_byte"]


def _per_text(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(x)])[off])


def features(raw: list[bytes]) -> np.ndarray:
    """A row of numbers for each text."""
    out = []
    group, size = [], 0
    for x in raw:
        group.append(x)
        size += len(x)
        if size > PIECE:
            out.append(_features(group))
            group, size = [], 0
    if group:
        out.append(_features(group))
    return np.concatenate(out) if out else np.empty((0, len(NAMES)))


def _features(raw: list[bytes]) -> np.ndarray:
    joined = [x + b"\n" for x in raw]
    data = np.frombuffer(b"".join(joined), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) for x in joined])])
    n = np.maximum(1, np.diff(off) - 1)
    f = []
    for kind in _KINDS.values():
        hit = np.zeros(256, bool)
        hit[list(kind)] = True
        f.append(np.maximum(0, _per_text(hit[data], off) - (kind == _KINDS["line"])) / n)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h, count = words(raw)
    at = np.concatenate([[0], np.cumsum(count)])
    w = np.maximum(1, count)
    length = (end - start).astype(np.int64)
    last = data[end - 1] if len(end) else np.empty(0, np.uint8)
    odd = np.isin(last, np.frombuffer(_KINDS["mark"] + _KINDS["shout"], np.uint8))
    same = np.concatenate([[False], h[1:] == h[:-1]])[: len(h)]
    same[at[:-1][count > 0]] = False  # a text's first word repeats none of the text before
    new = [len(np.unique(h[a:b])) for a, b in itertools.pairwise(at.tolist())]
    lines = [x.split(b"\n") for x in raw]
    again = np.concatenate([[False], data[1:] == data[:-1]])
    again[off[:-1]] = again[off[1:] - 1] = False  # neither a text's neighbours nor the line end put behind it count
    f += [
        np.log1p(np.diff(off) - 1),
        _per_text(length, at) / w,
        _per_text(length > 20, at) / w,
        _per_text(odd, at) / w,
        _per_text(same, at) / w,
        np.array(new) / np.sqrt(w) / np.sqrt(np.maximum(1, np.minimum(w, 400))),
        np.array([len(set(x)) / len(x) for x in lines]),
        np.log1p((np.diff(off) - 1) / np.array([len(x) for x in lines])),
        _per_text(again, off) / n,
    ]
    return np.stack(f, 1).astype(np.float64)


class AdditiveModel:
    """cuts: the bin edges of each feature; tables: a value for each bin; pairs: the same for two features."""

    def __init__(self, cuts, tables, pairs, base):
        self.cuts, self.tables, self.pairs, self.base = cuts, tables, pairs, base

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]
        z = np.full(len(x), self.base)
        for b, t in zip(bins, self.tables, strict=True):
            z += t[b]
        for i, j, ci, cj, t in self.pairs:
            z += t[np.searchsorted(ci, x[:, i], side="right"), np.searchsorted(cj, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, damp: float = 1.0) -> np.ndarray:
    """The step of a tree with few leaves over ordered bins, from the sums of gradients and curvatures."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    ends = [0, len(g)]
    gain_of = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + damp)
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in itertools.pairwise(ends):
            m = np.arange(a + 1, b)
            if len(m):
                gain = gain_of(a, m) + gain_of(m, b) - gain_of(a, b)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), int(m[k])))
        if not best[1]:
            break
        ends = sorted([*ends, best[1]])
    out = np.zeros(len(g))
    for a, b in itertools.pairwise(ends):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + damp)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, damp: float = 1.0) -> np.ndarray:
    """The step of a tree with few leaves over a table of two features' bins: each leaf is a rectangle, cut in two along the better feature."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    total = lambda c, r: c[r[1], r[3]] - c[r[0], r[3]] - c[r[1], r[2]] + c[r[0], r[2]]
    gain_of = lambda r: total(cg, r) ** 2 / (total(ch, r) + damp)
    rects = [(0, g.shape[0], 0, g.shape[1])]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for r in rects:
            for k in (1, 3):
                m = np.arange(r[k - 1] + 1, r[k])
                if len(m):
                    low, high = ((r[0], m, r[2], r[3]), (m, r[1], r[2], r[3])) if k == 1 else ((r[0], r[1], r[2], m), (r[0], r[1], m, r[3]))
                    gain = gain_of(low) + gain_of(high) - gain_of(r)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (float(gain[i]), r, [tuple(int(v[i]) if np.ndim(v) else v for v in x) for x in (low, high)])
        if best[1] is None:
            break
        rects.remove(best[1])
        rects += best[2]
    out = np.zeros(g.shape)
    for r in rects:
        out[r[0] : r[1], r[2] : r[3]] = total(cg, r) / (total(ch, r) + damp)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS, rate: float = RATE) -> AdditiveModel:
    """Cyclic boosting of one table after another, then of the tables of the best pairs."""
    if not len(x):
        return AdditiveModel([np.empty(0)] * len(NAMES), [np.zeros(1)] * len(NAMES), [], 0.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    cuts = [_edges(x[:, j], bins) for j in range(x.shape[1])]
    b = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    z = np.full(len(x), base)
    for _ in range(rounds if 0 < y.sum() < len(y) else 0):
        for j, t in enumerate(tables):
            if len(t) < 2:
                continue
            p = 1 / (1 + np.exp(-z))
            step = rate * _tree(np.bincount(b[j], y - p, len(t)), np.bincount(b[j], p * (1 - p), len(t)))
            t += step
            z += step[b[j]]
    found = []
    if 0 < y.sum() < len(y):
        few = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
        c = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(few)]
        p = 1 / (1 + np.exp(-z))
        worth = []
        for i, j in itertools.combinations(range(x.shape[1]), 2):
            k = c[i] * (len(few[j]) + 1) + c[j]
            worth.append((float((np.bincount(k, y - p) ** 2 / (np.bincount(k, p * (1 - p)) + 1)).sum()), i, j))
        for _, i, j in sorted(worth, reverse=True)[:pairs]:
            found.append((i, j, few[i], few[j], np.zeros((len(few[i]) + 1, len(few[j]) + 1))))
        for _ in range(pair_rounds):
            for i, j, _, _, t in found:
                p = 1 / (1 + np.exp(-z))
                k = c[i] * t.shape[1] + c[j]
                step = rate * _grid_tree(np.bincount(k, y - p, t.size).reshape(t.shape), np.bincount(k, p * (1 - p), t.size).reshape(t.shape))
                t += step
                z += step[c[i], c[j]]
    return AdditiveModel(cuts, tables, found, base)


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for no doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, folds: int = FOLDS) -> AdditiveModel:
    """Fits the model on labelled documents outside fold 0."""
    B.ready(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(folds) != 0))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    texts = B.documents(docs).join(F.broadcast(known), "doc_id")  # at most max_rows ids
    texts = texts.select("quality", "text", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("of"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches):
            x = features([t or b"" for t in b.column("text").to_pylist()])
            yield pa.record_batch({"quality": b.column("quality").cast(pa.int32()), "x": pa.array(list(x), pa.list_(pa.float64())), "h": b.column("h"), "of": b.column("of")})

    got = texts.mapInArrow(read, "quality int, x array<double>, h long, of long").orderBy("h", "of", "quality").limit(max_rows).toPandas()
    x = np.stack(got["x"].to_numpy()) if len(got) else np.empty((0, len(NAMES)))
    y = got["quality"].to_numpy(dtype=float)
    o = np.lexsort((*x.T, y)) if len(x) else []
    return fit(x[o], y[o])


def score(spark: SparkSession, docs: DataFrame, model: AdditiveModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier), and the carried columns of every row."""
    B.ready(spark)
    wide = B.wide(docs, carry)
    extra = {f.name: f.dataType.simpleString() for f in wide.schema.fields[2:]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches):
            s = model.score(features([t or b"" for t in b.column("text").to_pylist()]))
            yield pa.record_batch([b.column("doc_id"), pa.array(s), *(b.column(c) for c in extra)], names=["doc_id", "score", *extra])

    scored = wide.mapInArrow(run, "doc_id long, score double" + "".join(f", {c} {k}" for c, k in extra.items()))
    return scored.select("doc_id", "score", *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)))

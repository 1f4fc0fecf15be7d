"""Language identification (operator 7): interpolated Kneser-Ney character models.

For each language the counts of all character 4-grams of its training texts are summed over the corpus;
the counts of shorter contexts are derived from them. Keys of four 16-bit code points stand in sorted
arrays, found by binary search. The text gets the language of the least cross-entropy per character.

Texts are lower-cased; every run of characters that are not letters is one space. Code points above
16 bits are folded into 16. ``rejected`` tells that the cross-entropy is higher than almost all
(``quantile``) held-back training texts of that language have, by models without them, times ``margin``.
A language whose training rows are all in one of ``PARTS`` parts by doc_id can hold none back and has no
such limit. The score, the share of the chosen language among all by likelihood of the whole text, is halved for
rejected texts.

A null text, or one without a letter, is ``und`` with score 0. Rows without a language or id train nothing. Without
training rows all texts are ``und``. Of languages that tie, the first by name is taken. Repeated rows count, and
are identified, again. Very long texts are counted and scored whole. An empty table gives an empty result. Other
columns are never inputs.

Counts are taken from all training rows and grow with them. They are summed by ranges of 4-grams, ``RANGES`` tasks
for each language; each model is as large as the language has distinct 4-grams, and is held once by the driver
and by every worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _blocks as B
from .quality import fold

ORDER, FOLDS, HELD, PARTS = 4, 3, 1, 16
QUANTILE, MARGIN, RANGES = 0.995, 1.15, 16
PIECE, KEPT = 1 << 20, 3_000_000
LETTER = np.uint16(0)


@lru_cache(1)
def _classes() -> np.ndarray:
    """For each code point: 32 (no letter), or the lower-case code point folded into 16 bits."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[i] = low if low < 0x10000 else 0xE000 | (low * 0x9E37 >> 3 & 0x1FFF)
    return out.astype(np.uint16)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each letter or space, and the text it is of. Texts start after spaces."""
    joined = "".join(f"\x00\x00\x00{t}\x00" for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) + 4 for t in texts])
    own = np.repeat(np.arange(len(texts)), size)
    c = _classes()[cp]
    lead = np.concatenate([np.arange(3) + s for s in np.cumsum(size) - size]) if len(texts) else np.empty(0, np.int64)
    keep = (c != 32) | np.concatenate([[True], c[:-1] != 32])
    keep[lead] = True
    first = lead[2::3] + 1
    keep[first] = c[first] != 32  # no space right after the lead
    c, own = c[keep].astype(np.uint64), own[keep]
    is_lead = np.zeros(len(keep), bool)
    is_lead[lead] = True
    is_lead = is_lead[keep]
    k = c.copy()
    for i in (1, 2, 3):
        k[i:] |= c[:-i] << np.uint64(16 * i)
    return k[~is_lead], own[~is_lead]


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str], bool]]:
    """Groups of whole texts of about PIECE characters."""
    at, group, size = [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        at.append(i)
        group.append(t)
        size += len(t)
        if size > PIECE:
            yield at, group
            at, group, size = [], [], 0
    if group:
        yield at, group


class KneserNey:
    """Interpolated Kneser-Ney from the counts of the highest order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int):
        self.alphabet, self.levels = alphabet, []
        mask = (1 << 64) - 1
        for n in range(ORDER, 0, -1):
            d1, d2 = (counts == 1).sum(), (counts == 2).sum()
            discount = float(d1 / (d1 + 2 * d2)) if d1 and d2 else 0.5
            ctx = keys >> np.uint64(16)
            at = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(keys) else np.empty(0, np.int64)
            self.levels.append((n, discount, keys, counts.astype(np.float64), ctx[at], np.add.reduceat(counts, at).astype(np.float64) if len(at) else np.empty(0), np.diff(np.append(at, len(keys))).astype(np.float64)))
            mask >>= 16
            keys, counts = np.unique(keys & np.uint64(mask), return_counts=True)  # how many characters come before

    def surprise(self, k: np.ndarray) -> np.ndarray:
        """-log2 of the probability of the last character of each 4-gram, given those before."""
        p = np.full(len(k), 1.0 / self.alphabet)
        for n, d, keys, counts, ctx, total, kinds in reversed(self.levels):
            own = k & np.uint64((1 << 16 * n) - 1) if n < 4 else k
            c = own >> np.uint64(16)
            at = np.minimum(np.searchsorted(ctx, c), max(0, len(ctx) - 1))
            if not len(ctx):
                continue
            seen = ctx[at] == c
            i = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            count = np.where(keys[i] == own, counts[i], 0.0)
            p = np.where(seen, (np.maximum(count - d, 0) + d * kinds[at] * p) / total[at], p)
        return -np.log2(p)


class Identifier:
    """The models of all languages, with the surprises of the 4-grams met so far."""

    def __init__(self, langs: list[str], models: list[KneserNey], limit: dict[str, float] | None = None):
        self.langs, self.models, self.limit = langs, models, limit or {}
        self.keys, self.cost = np.empty(0, np.uint64), np.empty((0, len(langs)), np.float32)

    def __getstate__(self):
        return {"langs": self.langs, "models": self.models, "limit": self.limit, "keys": np.empty(0, np.uint64), "cost": np.empty((0, len(self.langs)), np.float32)}

    def costs(self, u: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, u), max(0, len(self.keys) - 1))
        new = u if not len(self.keys) else u[self.keys[at] != u]
        if len(new):
            if len(self.keys) > KEPT:
                self.keys, self.cost, new = self.keys[:0], self.cost[:0], u
            cost = np.stack([m.surprise(new) for m in self.models], 1).astype(np.float32)
            into = np.searchsorted(self.keys, new)
            self.keys, self.cost = np.insert(self.keys, into, new), np.insert(self.cost, into, cost, axis=0)
            at = np.searchsorted(self.keys, u)
        return self.cost[at]

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character in each language, and the number of characters, 0 if there is no letter."""
        h, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        if not self.langs:
            return h, n
        for at, group in _pieces(texts):
            k, own = grams(group)
            letters = np.bincount(own, (k & np.uint64(0xFFFF)) != 32, len(group))
            u, back = np.unique(k, return_inverse=True)
            cost = self.costs(u)
            m = np.bincount(own, minlength=len(group))
            for j in range(len(self.langs)):
                h[at, j] = np.bincount(own, cost[back, j], len(group)) / np.maximum(1, m)
            n[at] = np.where(letters > 0, m, 0)
        return h, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        h, n = self.entropies(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        best = h.argmin(1)
        least = h[np.arange(len(h)), best]
        share = 1 / np.exp2(-(h - least[:, None]) * n[:, None]).sum(1)
        high = least > np.array([self.limit.get(x, np.inf) for x in self.langs])[best]
        none = n == 0
        lang = [self.langs[b] if not x else "und" for b, x in zip(best, none, strict=True)]
        return lang, np.where(none, 0.0, np.where(high, share / 2, share)), high | none


COUNTS = pa.schema([("lang", pa.string()), ("aside", pa.bool_()), ("range", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, bool], list] = {}
    part = 0
    for b in B.slices(batches, 4096):
        key = list(zip(b.column("lang").to_pylist(), b.column("aside").to_pylist(), strict=True))
        texts = [(t or b"").decode("utf-8", "replace") for t in b.column("text").to_pylist()]
        part = b.column("part")[0].as_py() if b.num_rows else part
        for x in sorted(set(key)):
            for _, group in _pieces([t for t, own in zip(texts, key, strict=True) if own == x]):
                u, n = np.unique(grams(group)[0], return_counts=True)
                held.setdefault(x, []).append((u, n))
                if len(held[x]) > 16:
                    held[x] = [_merge(held[x])]
    for x, parts in held.items():
        keys, n = _merge(parts)
        rows = [(*x, k, part, B.pack(keys[i], n[i])) for k, i in B.by_bucket(keys, RANGES)]
        yield from B.rows(COUNTS, list(zip(*rows, strict=True))).to_batches() if rows else []


def _sum(t: pa.Table) -> pa.Table:
    return B.rows(COUNTS, [[t.column(c)[0].as_py()] for c in ("lang", "aside", "range")] + [[0], [B.pack(*_merge([tuple(B.unpack(x)) for x in t.column("blob").to_pylist()]))]])


def train(spark: SparkSession, docs: DataFrame, lang_col: str = "lang", folds: int = FOLDS, held: int = HELD) -> Identifier:
    """Models of all languages, counted from all training rows.

    The limits of rejection come from about one in PARTS of each language's rows, all of them, and the models of the
    others. Those rows are the first part by a hash of doc_id that the language has.
    """
    B.ready(spark)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(folds) != held))
    known = known.withColumn("of", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    first = known.groupBy("lang").agg(F.min("of").alias("first"), F.max("of").alias("last"))
    known = known.join(F.broadcast(first), "lang").select("lang", "text", ((F.col("of") == F.col("first")) & (F.col("first") < F.col("last"))).alias("aside"))
    schema = "lang string, aside boolean, range int, part int, blob binary"
    counts = known.select("lang", "aside", "text", F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")).mapInArrow(_count, schema)
    counts = counts.groupBy("lang", "aside", "range", "part").applyInArrow(_sum, schema).groupBy("lang", "aside", "range").applyInArrow(_sum, schema)
    ranges: dict[tuple[str, bool], list] = {}
    for r in counts.toLocalIterator():  # at most 2 * RANGES rows for each language
        ranges.setdefault((r.lang, r.aside), []).append(tuple(B.unpack(bytes(r.blob))))
    found: dict[str, list] = {}
    for lang, aside in sorted(ranges):
        found.setdefault(lang, []).append((aside, _merge(ranges.pop((lang, aside)))))
    if not found:
        return Identifier([], [])
    alphabet = len(np.unique(np.concatenate([np.unique(k & np.uint64(0xFFFF)) for own in found.values() for _, (k, _) in own]))) + 1
    without = [(x, c) for x, own in sorted(found.items()) for aside, c in own if not aside]
    part = Identifier([x for x, _ in without], [KneserNey(*c, alphabet) for _, c in without])
    bits = known.where("aside").mapInArrow(_entropy(part), "lang string, bits double")
    limit = {r.lang: r.limit * MARGIN for r in bits.groupBy("lang").agg(F.percentile("bits", F.lit(QUANTILE)).alias("limit")).collect()}
    del without, part
    return Identifier(sorted(found), [KneserNey(*_merge([c for _, c in found[x]]), alphabet) for x in sorted(found)], limit)


def _entropy(model: Identifier):
    def run(batches):
        for b in B.slices(batches):
            lang = b.column("lang").to_pylist()
            h, n = model.entropies([(t or b"").decode("utf-8", "replace") for t in b.column("text").to_pylist()])
            j = [model.langs.index(x) if x in model.langs else -1 for x in lang]
            ok = [i for i, (x, m) in enumerate(zip(j, n, strict=True)) if x >= 0 and m]
            yield pa.record_batch({"lang": pa.array([lang[i] for i in ok], pa.string()), "bits": pa.array([float(h[i, j[i]]) for i in ok], pa.float64())})

    return run


def identify(spark: SparkSession, docs: DataFrame, model: Identifier) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row."""
    B.ready(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.slices(batches):
            lang, score, out = model.predict([None if t is None else t.decode("utf-8", "replace") for t in b.column("text").to_pylist()])
            yield pa.record_batch({"doc_id": b.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score), "rejected": pa.array(out)})

    return B.documents(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")

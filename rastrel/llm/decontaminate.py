"""Benchmark decontamination (operator 3): q-gram lemma filtering and banded alignment.

A passage of m characters with at most e edits shares at least m - q + 1 - q * e of the item's q-grams,
all on diagonals (place in the text minus place in the item) at most e apart. So the shared q-grams are
counted in bands of diagonals that overlap by e, bands with enough are kept, and alignment of the item
against the text of the band, within the band, decides.

The edit budget is ``rate`` (0.1) of the item's length, less for short items so that the bound stays
above zero. Letters are compared in lower case and white space as spaces. An item under ``MIN_CHARS``
characters has no budget and must stand between word borders; one under Q characters has no q-gram, matches
nothing and is listed by ``too_short``. Null items match nothing. Null or empty texts match nothing. Very long
texts are whole: their q-grams are taken at one go. Of several places of an item in a text the one with the
least edits is told, then the first; ``begin`` and ``end`` are where its alignment begins and ends.

The items are the small side. They are read in chunks of at most ``max_item_bytes`` (8 MB) and each chunk
goes through all texts, so the tables that a worker builds and holds are bounded whatever the size of the benchmark;
the driver holds the items' texts. Repeated
rows give repeated results; other columns are ignored. An empty table on either side gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _blocks as B

Q, RATE, MIN_CHARS, BAND = 8, 0.1, 24, 64
PIECE, MAX_ITEM_BYTES = 1 << 19, 8 << 20
BREAK = 0x110000
_MULT = np.random.default_rng(3).integers(1, 1 << 63, Q, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(1)
def _fold() -> np.ndarray:
    """Each code point in lower case, one for one; white space as a space."""
    out = np.arange(0x110001, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        low = c.lower()
        out[i] = 32 if c.isspace() else ord(low) if len(low) == 1 else i
    return out


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The folded code points of all texts, a break after each, and where each begins."""
    cp = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    out = _fold()[cp]
    out[begin[1:] - 1] = BREAK
    return out, begin


def _grams(cp: np.ndarray) -> np.ndarray:
    n = max(0, len(cp) - Q + 1)
    h = np.zeros(n, np.uint64)
    for k in range(Q):
        h += cp[k : k + n] * _MULT[k]
    return B.mix(h)


def budget(m: int, rate: float = RATE) -> int:
    """Edits allowed in an item of m characters."""
    return max(0, min(int(rate * m), (m - Q) // Q)) if m >= MIN_CHARS else 0


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int]:
    """The least edits of the item against a stretch of the text whose diagonals lie in low..high, and where that begins and ends.

    Over most: (most + 1, -1, -1). Row i holds the costs at diagonals low..high after i characters of the item, and
    beside them where the best alignment begins.
    """
    width = high - low + 1
    far = most + 1
    d = np.arange(low, high + 1)
    row = np.where((d >= 0) & (d <= len(text)), 0, far)
    start = d.copy()
    step = np.arange(width)
    for i, c in enumerate(item.tolist()):
        at = d + i  # the text character that diagonal d meets
        ok = (at >= 0) & (at < len(text))
        hit = np.zeros(width, bool)
        hit[ok] = text[at[ok]] == c
        new = np.minimum(row + ~hit, far)  # take both
        less = row[1:] + 1 < new[:-1]  # leave out the item's character
        new[:-1] = np.where(less, row[1:] + 1, new[:-1])
        start[:-1] = np.where(less, start[1:], start[:-1])
        new[(at + 1 < 0) | (at + 1 > len(text))] = far
        # leave out characters of the text: the least so far, and from where
        best = np.minimum.accumulate((new - step) * width + step)
        start = start[best % width]
        row = np.minimum(best // width + step, far)
        if row.min() > most:
            return far, -1, -1
    k = int(row.argmin())
    return (int(row[k]), int(start[k]), int(d[k]) + len(item)) if row[k] <= most else (far, -1, -1)


class Items:
    """The items of a chunk, with their q-grams in a sorted table."""

    def __init__(self, ids: list[int | None], texts: list[str], rate: float):
        self.ids = ids
        self.cps = [folded([t])[0][:-1] for t in texts]
        self.most = np.array([budget(len(c), rate) for c in self.cps])
        self.least = np.array([len(c) - Q + 1 - Q * e for c, e in zip(self.cps, self.most, strict=True)])
        grams = [_grams(c) for c in self.cps]
        g = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(x) for x in grams])
        place = np.concatenate([np.arange(len(x)) for x in grams]) if grams else np.empty(0, np.int64)
        o = np.argsort(g, kind="stable")
        g, self.item, self.place = g[o], item[o], place[o]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
        self.keys, self.start = g[first], np.append(first, len(g))
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.band = max(BAND, 1 << int(np.ceil(np.log2(max(1, self.most.max(initial=1))))))

    def candidates(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, band) of which enough q-grams are shared."""
        h = _grams(cp)
        at = np.flatnonzero(self.maybe[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        i = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[i] == h[at]
        at, i = at[ok], i[ok]
        n = self.start[i + 1] - self.start[i]
        flat = np.repeat(self.start[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item = self.item[flat]
        diagonal = np.repeat(at, n) - self.place[flat] + (1 << 24)
        band = diagonal // self.band
        also = diagonal % self.band < self.most[item]
        key = np.concatenate([(item << 32) | band, (item[also] << 32) | (band[also] - 1)])
        key, count = np.unique(key, return_counts=True)
        key = key[count >= self.least[key >> 32]]
        return key >> 32, (key & 0xFFFFFFFF) * self.band - (1 << 24)

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, begin, end), the best place of each item in each text."""
        cp, begin = folded(texts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for item, low in zip(*(x.tolist() for x in self.candidates(cp)), strict=True):
            it, e = self.cps[item], int(self.most[item])
            high = low + self.band + e
            # a band may lie across several texts
            a = int(np.searchsorted(begin, max(0, low - e), side="right")) - 1
            z = int(np.searchsorted(begin, min(len(cp) - 1, high + e + len(it)), side="right"))
            for t in range(a, min(z, len(texts))):
                lo, hi = max(int(begin[t]), low - e), min(int(begin[t + 1]) - 1, high + e + len(it))
                if hi - lo < len(it) - e:
                    continue
                d, start, end = _best(it, cp[lo:hi], low - e - lo, high + e - lo, e) if len(it) >= MIN_CHARS else _alone(it, cp[max(0, lo - 1) : hi + 1], lo - max(0, lo - 1))
                if d <= e:
                    new = (d, lo + start - int(begin[t]), lo + end - int(begin[t]))
                    best[t, item] = min(best.get((t, item), new), new)
        return [(t, i, *x) for (t, i), x in sorted(best.items())]


def _places(item: np.ndarray, text: np.ndarray) -> Iterator[int]:
    """Where the item stands in the text, exactly."""
    raw, want = text.tobytes(), item.tobytes()
    at = raw.find(want)
    while at >= 0:
        if at % 4 == 0:
            yield at // 4
        at = raw.find(want, at + 1)


def _best(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int]:
    at = next(_places(item, text), -1)
    return (0, at, at + len(item)) if at >= 0 else align(item, text, low, high, most)


def _alone(item: np.ndarray, text: np.ndarray, lead: int) -> tuple[int, int, int]:
    """The first place where a short item stands by itself; text has ``lead`` more characters before it."""
    word = lambda c: c < BREAK and chr(c).isalnum()
    for at in _places(item, text):
        end = at + len(item)
        before, after = at and word(text[at - 1]), end < len(text) and word(text[end])
        if not (before and word(item[0])) and not (after and word(item[-1])):
            return 0, at - lead, end - lead
    return 1, -1, -1


class Chunk:
    """Items as they travel: their tables are built where they are used, once for each worker process."""

    built: dict[str, Items] = {}

    def __init__(self, ids: list, texts: list, rate: float):
        self.parts, self.key = (ids, texts, rate), uuid.uuid4().hex

    def items(self) -> Items:
        if self.key not in Chunk.built:
            Chunk.built.clear()
            Chunk.built[self.key] = Items(*self.parts)
        return Chunk.built[self.key]


SCHEMA = "doc_id long, item_id long, edits int, begin int, end int"


def _chunks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for r in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where(F.length(text_col) >= Q).toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        size += 4 * len(r.t)
        if size > most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def too_short(items: DataFrame, text_col: str = "text") -> DataFrame:
    """The items that are not searched for: not null, but without a q-gram."""
    return items.where(F.length(F.col(text_col).cast("string")) < Q)


def _pieces(texts: list[bytes | None]) -> Iterator[tuple[list[int], list[str]]]:
    at, group, size = [], [], 0
    for i, t in enumerate(texts):
        if t:
            at.append(i)
            group.append(t.decode("utf-8", "replace"))
            size += len(group[-1])
            if size > PIECE:
                yield at, group
                at, group, size = [], [], 0
    if group:
        yield at, group


def find(spark: SparkSession, docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "item_id", text_col: str = "text", max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """A row (doc_id, item_id, edits, begin, end) for each text and item that meet; places in characters."""
    B.ready(spark)
    plain = B.documents(docs)

    def scan(chunk: Chunk):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = chunk.items()
            for b in B.slices(batches):
                ids = b.column("doc_id")
                for at, group in _pieces(b.column("text").to_pylist()):
                    hits = items.matches(group)
                    if hits:
                        t, i, e, a, z = zip(*hits, strict=True)
                        yield pa.record_batch({"doc_id": ids.take(pa.array([at[x] for x in t])), "item_id": pa.array([items.ids[x] for x in i], pa.int64()), "edits": pa.array(e, pa.int32()), "begin": pa.array(a, pa.int32()), "end": pa.array(z, pa.int32())})

        return run

    parts = [plain.mapInArrow(scan(Chunk(i, t, rate)), SCHEMA) for i, t in _chunks(items, id_col, text_col, max_item_bytes)]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], SCHEMA)


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text", max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """The rows of docs, all columns, that hold no item; one pass over the texts for each chunk of items."""
    B.ready(spark)
    for ids, texts in _chunks(items, "item_id", "text", max_item_bytes):
        chunk = Chunk(ids, texts, rate)

        def run(batches: Iterator[pa.RecordBatch], chunk: Chunk = chunk) -> Iterator[pa.RecordBatch]:
            items = chunk.items()
            for b in B.slices(batches):
                texts = [t.encode() if isinstance(t, str) else t for t in b.column(text_col).to_pylist()]
                bad = {at[h[0]] for at, group in _pieces(texts) for h in items.matches(group)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

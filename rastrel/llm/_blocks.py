"""Shared plumbing of the corpus operators: blocks of documents, packed messages, shared folder.

A *block* is a set of documents that share a hash of their id, about ``block_bytes`` of text. The
text moves once, to its block; what operators exchange afterwards are packed, compressed arrays
("messages") addressed to a bucket of keys, and packed replies addressed to a block. A frequent key
is one entry a block, whatever the number of its rows, so no bucket gathers the rows of a hot key.
"""

from __future__ import annotations

import ctypes
import inspect
import pickle
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import bucketed, new_path, table  # noqa: F401

ROOT = str(Path(__file__).resolve().parents[2])
LEAST = -(1 << 63)
#: The order of a null doc_id: before all others.


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package also where it is not installed."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text as UTF-8 bytes; other columns, whatever their names, are left out."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


#: What a row counts for besides its text, so that many short texts fill blocks too.
ROW_BYTES = 64


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES)).first()[0] or 0


def in_blocks(docs: DataFrame, total: int, block_bytes: int, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """docs with their block, and the number of blocks. Rows of one doc_id share a block; rows without one are dealt by text."""
    n = max(1, -(-total // block_bytes))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.select(F.pmod(key, F.lit(n)).cast("int").alias("block"), "doc_id", "text", *carry), n


def wide(df: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """doc_id and text as ``documents`` gives them, and the carried columns as c0, c1 and so on."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)))


def pack(*arrays, level: int = 1) -> bytes:
    """Arrays as compressed bytes. Sorted unsigned arrays are stored as byte planes of their steps."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype == np.uint64 and len(a) > 1 and (a[1:] >= a[:-1]).all():
            d = np.diff(a, prepend=np.uint64(0))
            out.append(("d", d.view(np.uint8).reshape(-1, 8).T.tobytes()))
        elif a.dtype.itemsize > 1:
            out.append((a.dtype.str, a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()))
        else:
            out.append((a.dtype.str, a.tobytes()))
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(out, 5))


def unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)):
        if kind == "d":
            out.append(np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64))
            continue
        k = np.dtype(kind)
        flat = np.frombuffer(raw, np.uint8)
        out.append((np.ascontiguousarray(flat.reshape(k.itemsize, -1).T) if k.itemsize > 1 else flat).view(k).ravel())
    return out


def trimmed(f):
    """f, giving memory back to the system after each call: a worker process lives on, and its free memory counts as used."""

    def call(*tables):
        out = f(*tables)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
        return out

    if len(inspect.signature(f).parameters) == 2:
        return lambda a, b: call(a, b)
    return lambda a: call(a)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble uint64 keys."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def deal(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each key."""
    return ((mix(keys) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def by_range(keys: np.ndarray, bits: int, n: int):
    """Yields (bucket, indices) of sorted keys of so many evenly used bits: buckets are ranges, in which steps stay small."""
    edge = np.array([(i << bits) // n for i in range(n)], np.uint64)
    cut = np.append(np.searchsorted(keys, edge), len(keys))
    for i in np.flatnonzero(np.diff(cut)):
        yield int(i), np.arange(cut[i], cut[i + 1])


def by_bucket(keys: np.ndarray, n: int):
    """Yields (bucket, indices); the indices keep the order of the keys."""
    if not len(keys):
        return
    b = deal(keys, n).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cut = np.flatnonzero(np.diff(b[order])) + 1
    for part in np.split(order, cut):
        yield int(b[part[0]]), part


def slices(batches, n: int = 1024):
    """The rows of Arrow batches, n at a time: texts are long, and a worker should hold few of them at once."""
    for b in batches:
        for lo in range(0, b.num_rows, n):
            yield b.slice(lo, n)


class Docs:
    """The documents of a block in an order that any run repeats: by doc_id, nulls first, then by text."""

    def __init__(self, t: pa.Table):
        ids = t.column("doc_id").combine_chunks()
        texts = t.column("text").combine_chunks()
        self.null = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(LEAST)).astype(np.int64)
        raw = [x or b"" for x in texts.to_pylist()]
        order = sorted(range(len(raw)), key=lambda i: (self.ids[i], not self.null[i], raw[i])) if len(set(self.ids.tolist())) < len(raw) else np.argsort(self.ids, kind="stable").tolist()
        self.order = np.asarray(order, np.int64)
        self.raw = [raw[i] for i in order]
        self.ids, self.null = self.ids[order], self.null[order]

    def __len__(self) -> int:
        return len(self.raw)

    def doc_ids(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.null)

    def joined(self, pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, with pad zero bytes behind them, and the offsets of the documents."""
        off = np.zeros(len(self.raw) + 1, np.int64)
        np.cumsum([len(x) for x in self.raw], out=off[1:])
        return np.frombuffer(b"".join([*self.raw, bytes(pad)]), np.uint8), off


def rows(schema: pa.Schema, cols: list) -> pa.Table:
    return pa.table([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(cols, schema, strict=True)], schema=schema)

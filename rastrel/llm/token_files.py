"""Token-ID output (operator 1): Arrow IPC files of equal-length sequences, and reading them back.

A file is an Arrow IPC file (the stream format with a footer) whose batches hold two fixed-size lists
a row: ``ids`` (16 bits wide where the vocabulary allows, else 32) and ``mask`` (bits, 1 where an id is real). Documents follow one another; only
the last sequence of a file is padded. All rows have one length, so sequence i of a file is a slice of
the memory-mapped buffer: row i % batch of batch i // batch. A second file beside it, ``.docs``, tells
for each document its id, its first place in the file and its number of tokens.

Where a tokenizer never joins characters across white space (``cuts_at_spaces`` reads that from its file),
texts are cut at spaces and line ends and each distinct piece is encoded once. Words are kept in a bounded
table for each worker; new plain words are encoded many at a time, and told apart by the vocabulary's
end-of-word marks. With any other tokenizer the library encodes every whole text.

Order: by doc_id, nulls first, then by a hash of the text. A null text has no ids but the end id. Rows
that repeat are written again. Very long texts are whole: with the table they are worked through slice by
slice, cut at spaces. Other columns are ignored. An empty table writes no file. Tasks write to names of
their own and only files named by tasks that succeeded are read, so a lost executor or a second attempt
leaves at most an unused file.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _blocks as B

SEQUENCE, BATCH, END_ID = 1024, 256, 1
WORDS_KEPT, SLICE, TOGETHER = 1_600_000, 3 << 20, 200
MARK, STOPS = "</w>", (".", ",", ";", ":", "!", "?")


def _members(part: dict | None, name: str) -> list[dict]:
    return [] if part is None else [y for x in part[name] for y in _members(x, name)] if part["type"] == "Sequence" else [part]


def cuts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer (its JSON) encodes a text as the pieces between its white space, one after another."""
    for n in _members(spec.get("normalizer"), "normalizers"):
        blank = n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+" and n["content"] == " "
        if n["type"] not in ("NFC", "NFD", "Lowercase", "StripAccents") and not blank:
            return False
    steps = _members(spec.get("pre_tokenizer"), "pretokenizers")
    if not steps:
        return False
    first, *rest = steps
    if first["type"] == "Split":
        # only matches are kept: none may hold white space
        rule = re.sub(r"\[\^[^\]]*\\s[^\]]*\]", "", first["pattern"].get("Regex", " "))
        if first["behavior"] != "Removed" or not first["invert"] or re.search(r"[ .]|\\[sSDWPZ]|\[\^", rule):
            return False
    elif first["type"] not in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
        return False
    if any(x.get("add_prefix_space") for x in rest) or any(" " in t["content"] for t in spec.get("added_tokens", [])):
        return False
    return spec["model"]["type"] in ("BPE", "WordPiece", "WordLevel") and not spec["model"].get("dropout")


class WordEncoder:
    """Ids of whole texts, by a table of the pieces between spaces where the tokenizer allows it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.by_words = cuts_at_spaces(json.loads(self.tok.to_str()))
        size = self.tok.get_vocab_size()
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        marked = [i for w, i in self.tok.get_vocab().items() if w.endswith(MARK)]
        self.ends = np.zeros(size, bool) if marked else None
        if marked:
            self.ends[marked] = True
        self.stops = {c: self.tok.encode(c, add_special_tokens=False).ids for c in STOPS}
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.ids = np.empty(0, self.kind)
        self.start = np.zeros(1, np.int64)

    def _plain(self, w: str) -> int:
        """How many words of the vocabulary's pre-tokenizer a piece surely is; 0 if that takes a closer look."""
        stem, marks = (w[:-1], 1) if w[-1:] in STOPS else (w, 0)
        if stem.isascii():
            return 1 + marks if stem.isalpha() else 0
        return 1 + marks if stem.lower().isalpha() and "\u03a3" not in stem and unicodedata.is_normalized("NFC", stem) else 0

    def _new(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        odd, some, count = [], [], []
        for i, w in enumerate(words):
            n = self._plain(w) if self.ends is not None else 0
            if not n:
                odd.append(i)
            elif n == 2 and (k := self.code.get(w[:-1])) is not None:
                out[i] = [*self.ids[self.start[k] : self.start[k + 1]].tolist(), *self.stops[w[-1]]]
            else:
                some.append(i)
                count.append(n)
        groups = [some[k : k + TOGETHER] for k in range(0, len(some), TOGETHER)]
        got = self.tok.encode_batch_fast([" ".join([words[i] for i in g]) for g in groups], add_special_tokens=False)
        for k, (g, e) in enumerate(zip(groups, got, strict=True)):
            ids = e.ids
            ends = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum(count[k * TOGETHER : k * TOGETHER + len(g)])
            if len(ends) != last[-1]:
                odd += g
                continue
            cut = [0, *ends[last - 1].tolist()]
            for i, a, z in zip(g, cut, cut[1:], strict=False):
                out[i] = ids[a:z]
        for i, e in zip(odd, self.tok.encode_batch_fast([words[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and the number of ids of each piece."""
        new = list(set(words).difference(self.code))
        if len(self.code) + len(new) > WORDS_KEPT:
            self._clear()
            new = list(set(words))
        if new:
            got = self._new(new)
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, np.array([i for x in got for i in x], self.kind)])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(x) for x in got])])
        code = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        n = self.start[code + 1] - self.start[code]
        return self.ids[np.repeat(self.start[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text, slice by slice, cut at spaces."""
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + SLICE)
            if end < len(text):
                cut = text.rfind(" ", at, end)
                if cut <= at:
                    cut = text.find(" ", end)
                end = len(text) if cut < 0 else cut + 1
            out.append(self.pieces(text[at:end].replace("\n", " ").split(" "))[0])
            at = end
        return np.concatenate(out) if out else np.empty(0, self.kind)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many texts, and how many each has. Long ones are taken alone."""
        if not self.by_words:
            got = [np.array(e.ids, self.kind) for x in texts for e in self.tok.encode_batch_fast([x], add_special_tokens=False)]
            return (np.concatenate(got), np.array([len(x) for x in got])) if got else (np.empty(0, self.kind), np.empty(0, np.int64))
        out, count, group = [], [], []

        def flush() -> None:
            if group:
                split = [t.replace("\n", " ").split(" ") for t in group]
                ids, n = self.pieces([w for s in split for w in s])
                out.append(ids)
                count.append(np.add.reduceat(n, np.cumsum([0] + [len(s) for s in split[:-1]])))
                group.clear()

        size = 0
        for t in texts:
            if len(t) > SLICE:
                flush()
                out.append(self.encode(t))
                count.append([len(out[-1])])
                continue
            group.append(t)
            size += len(t)
            if size > SLICE:
                flush()
                size = 0
        flush()
        return (np.concatenate(out), np.concatenate(count)) if out else (np.empty(0, self.kind), np.empty(0, np.int64))


@lru_cache(2)
def encoder_at(path: str) -> WordEncoder:
    """One for each worker process, so that its table of words lasts from task to task."""
    return WordEncoder(path)


def schema(sequence: int, kind: type = np.uint32) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Packs ids into equal-length sequences."""

    def __init__(self, sink, sequence: int, batch: int, kind: type = np.uint32):
        self.sequence, self.batch, self.rest, self.n = sequence, batch, [], 0
        self.held, self.kind = 0, kind
        self.schema = schema(sequence, kind)
        self.out = pa.ipc.new_file(sink, self.schema)

    def write(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        step = self.sequence * self.batch
        if self.held >= step:
            all_ids = np.concatenate(self.rest)
            for a in range(0, len(all_ids) - step + 1, step):
                self._batch(all_ids[a : a + step], step)
            self.rest = [all_ids[len(all_ids) // step * step :]]
            self.held = len(self.rest[0])

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.empty(0, self.kind)
        if len(ids):
            self._batch(np.append(ids, np.zeros(-len(ids) % self.sequence, self.kind)).astype(self.kind), len(ids))
        self.out.close()


class SequenceFile:
    """Random access to the sequences of a file; memory-mapped where the path is local."""

    def __init__(self, uri: str):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        self.file = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.file)
        self.batch = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 1
        self.sequence = self.reader.schema.field("ids").type.list_size

    def sequences(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """ids and mask of sequence i, without a copy."""
        b, k = self.reader.get_batch(i // self.batch), i % self.batch
        ids, mask = (b.column(c).flatten().slice(k * self.sequence, self.sequence) for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def ids(self, start: int, n: int) -> np.ndarray:
        """The n ids from a place of the file on."""
        step = self.sequence * self.batch
        out = []
        for b in range(start // step, -(-(start + n) // step)):
            x = self.reader.get_batch(b).column(0).flatten().to_numpy(zero_copy_only=True)
            out.append(x[max(0, start - b * step) : start + n - b * step])
        return np.concatenate(out) if len(out) != 1 else out[0]


def write(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str | None = None, sequence: int = SEQUENCE, batch: int = BATCH, end_id: int | None = END_ID) -> DataFrame:
    """Writes the files and returns their list: part, path, n_docs, n_tokens, base (ids in the files before)."""
    B.ready(spark)
    path = path or B.new_path(spark, "tokens")
    docs = B.documents(docs).withColumn("h", F.xxhash64("text"))
    docs = docs.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, index, place = None, None, [], 0
        for b in B.slices(batches):
            if not b.num_rows:
                continue
            if encoder is None:
                encoder = encoder_at(tokenizer)
                part = TaskContext.get().partitionId()
                fs, root = pa.fs.FileSystem.from_uri(path)
                fs.create_dir(root, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.arrow"
                sink = fs.open_output_stream(f"{root}/{name}")
                out = SequenceWriter(sink, sequence, batch, encoder.kind)
            texts = [(x or b"").decode("utf-8", "replace") for x in b.column("text").to_pylist()]
            ids, n = encoder.encode_all(texts)
            ends = np.cumsum(n)
            if end_id is not None:
                ids = np.insert(ids, ends, end_id)
                n = n + 1
            out.write(ids)
            index.append(pa.record_batch([b.column("doc_id"), pa.array(place + np.cumsum(n) - n), pa.array(n.astype(np.int64))], schema=DOCS))
            place += int(n.sum())
        if out is None:
            return
        out.close()
        sink.close()
        with fs.open_output_stream(f"{root}/{name}.docs") as f, pa.ipc.new_file(f, DOCS) as w:
            for x in index:
                w.write_batch(x)
        yield pa.record_batch({"part": pa.array([part]), "path": pa.array([f"{path}/{name}"]), "n_docs": pa.array([sum(x.num_rows for x in index)]), "n_tokens": pa.array([place])})

    files = B.table(spark, docs.mapInArrow(task, "part long, path string, n_docs long, n_tokens long"), "token-files")
    rows, base = [], 0
    for r in files.orderBy("part").toLocalIterator():  # a row for each file
        rows.append((r.part, r.path, r.n_docs, r.n_tokens, base))
        base += r.n_tokens
    return spark.createDataFrame(rows, "part long, path string, n_docs long, n_tokens long, base long")


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    B.ready(spark)
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                f = SequenceFile(uri)
                fs, p = pa.fs.FileSystem.from_uri(f"{uri}.docs")
                with fs.open_input_file(p) as s:
                    docs = pa.ipc.open_file(s).read_all().combine_chunks()
                for d in docs.to_batches():
                    start, n = d.column("start").to_numpy(), d.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(f.ids(a, k).astype("<u4", copy=False)) for a, k in zip(start.tolist(), n.tolist(), strict=True)]
                    yield pa.record_batch([d.column("doc_id"), pa.array(start + base), pa.array(n), pa.array(crc, pa.int64())], schema=out)

    n = max(1, files.count())
    return files.select("path", "base").repartition(n, "path").mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")

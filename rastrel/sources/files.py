"""Corpora as DataFrames: listing, header-only scan, chunks, format by content, and writing results."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.functions import udtf

from ..functions import containers, png

# The extensions taken besides .png.
EXTENSIONS = """.jpg .jpeg .jfif .webp .bmp .dib .tif .tiff .gif .jp2 .j2k .jpc .jxl .avif .heic .heif .hif .qoi .dds .apng
.tga .icb .vda .vst .ico .cur .psd .psb .ppm .pgm .pbm .pnm .pam .sgi .rgb .rgba .bw .int .inta .pcx .dcx .im .xpm .xbm
.pic .pixar .msp .wal .mpt .tex .fit .fits .fts""".split()
HEADER = 33
MAX_PIXELS = 24_000_000


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def listing(spark: SparkSession, src: str, recursive: bool = True, images: bool = True) -> DataFrame:
    """path, modificationTime, length, content of PNGs, or of all image files; the content is only read where it is used.

    Spark passes over files of no bytes; the source ``imagecorpus`` lists them too.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(src)
    ext = extension(F.col("path"))
    return files.where((ext == ".png") | (ext.isin(EXTENSIONS) if images else F.lit(False)))


def relative(path: Column, base: str) -> Column:
    """The path below base."""
    base = base.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)


def out_path(rel: Column) -> Column:
    return F.concat(F.regexp_replace(rel, r"\.[^./]+$", ""), F.lit(".webp"))


def common_base(df: DataFrame, path: str = "path") -> str:
    """The folder that all paths share: the common start of the least and the greatest."""
    r = df.agg(F.min(path).alias("a"), F.max(path).alias("b")).first()
    if r.a is None:
        return ""
    return os.path.dirname(r.a) if r.a == r.b else os.path.commonprefix([r.a, r.b]).rpartition("/")[0]


def big_endian(content: Column, at: int, n: int) -> Column:
    """n bytes from the 1-based place as a number; null beyond the end."""
    return F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("long")


def header(content: Column) -> Column:
    """struct<w, h, depth, color, interlace, mb_h, mb_w, legal> of a PNG's header; w and h are -1 for anything else."""
    is_png = (F.hex(F.substring(content, 1, 8)) == png.MAGIC.hex().upper()) & (F.hex(F.substring(content, 13, 4)) == b"IHDR".hex().upper()) & (F.octet_length(content) >= 26)
    w, h = (F.when(is_png, big_endian(content, k, 4)).otherwise(-1).cast("int") for k in (17, 21))
    depth, color, inter = (F.when(is_png, big_endian(content, k, 1)).cast("int") for k in (25, 26, 29))
    cells = lambda x: F.when(x > 0, F.floor((x + 15) / 16)).otherwise(-1).cast("int")
    pairs = [F.lit(100 * d + c) for d, cs in png.LEGAL.items() for c in cs]
    legal = is_png & (depth * 100 + color).isin(*pairs) & (w > 0) & (h > 0) & (big_endian(content, 27, 1) == 0) & (big_endian(content, 28, 1) == 0) & (inter <= 1)
    return F.struct(w.alias("w"), h.alias("h"), depth.alias("depth"), color.alias("color"), inter.alias("interlace"), cells(h).alias("mb_h"), cells(w).alias("mb_w"), F.coalesce(legal, F.lit(False)).alias("legal"))


def supported(h: Column) -> Column:
    """Whether the native path takes a picture: 8 bits, RGB or RGBA, not interlaced, sizes multiples of 16 up to 30,000."""
    size = lambda x: (x % 16 == 0) & (x <= 30000)
    return F.coalesce(h["legal"] & (h["depth"] == 8) & h["color"].isin(2, 6) & (h["interlace"] == 0) & size(h["w"]) & size(h["h"]), F.lit(False))


def gates(w: Column, h: Column) -> Column:
    """struct<too_large, odd, aligned>."""
    return F.struct((w.cast("long") * h > MAX_PIXELS).alias("too_large"), ((w % 2 == 1) | (h % 2 == 1)).alias("odd"), ((w % 16 == 0) & (h % 16 == 0)).alias("aligned"))


def format_of(content: Column) -> Column:
    """The format by the first bytes."""
    hx = F.hex(F.substring(content, 1, 12))
    box = F.substring(hx, 9, 8) == b"ftyp".hex().upper()
    starts = [("FFD8FF", "jpeg"), ("424D", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("474946383761", "gif"), ("474946383961", "gif"), ("FF4FFF51", "j2k"), ("0000000C6A502020", "j2k"), ("FF0A", "jxl"), ("0000000C4A584C20", "jxl"), ("44445320", "dds"), ("716F6966", "qoi"), ("89504E470D0A1A0A", "png")]
    out = F.when(hx.startswith("52494646") & (F.substring(hx, 17, 8) == "57454250"), "webp").when(box & F.substring(hx, 17, 8).isin("61766966", "61766973"), "avif").when(box, "heif")
    for magic, name in starts:
        out = out.when(hx.startswith(magic), name)
    return out


def _png_chunks(content: bytes | None) -> list[tuple[int, str, bytes, bool]]:
    if not content or content[:8] != png.MAGIC:
        return []
    out, at = [], 8
    for i, (kind, payload) in enumerate(png.chunks(content)):
        stored = content[at + 8 + len(payload) : at + 12 + len(payload)]
        out.append((i, kind, payload, stored == png.chunk(kind, payload)[-4:]))
        at += 12 + len(payload)
    return out


def chunks_of(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, seq, type, payload, crc_ok: the chunks of PNG files, by Arrow batches; other files have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *c) for i, x in enumerate(b.column(content).to_pylist()) for c in _png_chunks(x)]
            if rows:
                at, *cols = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.string(), pa.binary(), pa.bool_())
                yield pa.record_batch({**{k: b.column(k).take(pa.array(at)) for k in keys}, **{n: pa.array(c, k) for n, c, k in zip(("seq", "type", "payload", "crc_ok"), cols, kinds, strict=True)}})

    own = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, content).mapInArrow(run, f"{own}, seq int, type string, payload binary, crc_ok boolean")


@udtf(returnType="seq int, type string, payload binary, crc_ok boolean")
class PngChunks:
    """The chunks of a PNG; nothing for other content."""

    def eval(self, content: bytes):
        yield from _png_chunks(content)


@udtf(returnType="seq int, type string, payload binary")
class RiffChunks:
    """The chunks of a WebP file."""

    def eval(self, content: bytes):
        if content and content[:4] == b"RIFF" and content[8:12] == b"WEBP":
            for i, (kind, payload) in enumerate(containers.riff(content)):
                yield i, kind, payload


def register(spark: SparkSession) -> None:
    """png_chunks, riff_chunks and the data source imagecorpus."""
    spark.udtf.register("png_chunks", PngChunks)
    spark.udtf.register("riff_chunks", RiffChunks)
    spark.dataSource.register(ImageCorpus)


class _Files(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]):
        super().__init__(None)
        self.paths = paths


class ImageCorpus(DataSource):
    """Image files below a folder; reads ``headerBytes`` of each (33; 0: whole files). Writes rows (out_path, bytes) as files.

    Options: path; recursive (true); headerBytes; filesPerPartition (256).
    """

    @classmethod
    def name(cls) -> str:
        return "imagecorpus"

    def schema(self) -> str:
        return "path string, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def _uri(path: str):
    fs, root = pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    return fs, root


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.head = options["path"], int(options.get("headerbytes", options.get("headerBytes", HEADER)))
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        self.each = int(options.get("filespersplit", options.get("filesPerPartition", 256)))

    def partitions(self) -> list[_Files]:
        fs, root = _uri(self.path)
        found = sorted((f.path, f.size) for f in fs.get_file_info(pa.fs.FileSelector(root, recursive=self.recursive)) if f.is_file and os.path.splitext(f.path)[1].lower() in (".png", *EXTENSIONS))
        return [_Files(found[i : i + self.each]) for i in range(0, len(found), self.each)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        fs, _ = _uri(self.path)
        for path, size in partition.paths:
            with fs.open_input_file(path) as f:
                yield path, size, f.read(self.head or size)


class _Done(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class _Writer(DataSourceWriter):
    """Files are written under a hidden name and renamed when all tasks are through, so a second attempt leaves no half file."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator) -> _Done:
        fs, root = _uri(self.path)
        from pyspark import TaskContext

        tag, done = TaskContext.get().taskAttemptId(), []
        for r in rows:
            target = f"{root}/{r['out_path']}"
            fs.create_dir(os.path.dirname(target), recursive=True)
            with fs.open_output_stream(f"{target}.{tag}~") as f:
                f.write(bytes(r["bytes"]))
            done.append((f"{target}.{tag}~", target))
        return _Done(done)

    def commit(self, messages: list[_Done]) -> None:
        fs, _ = _uri(self.path)
        for m in messages:
            for a, b in m.files if m else []:
                fs.move(a, b)

    def abort(self, messages: list[_Done]) -> None:
        fs, _ = _uri(self.path)
        for m in messages:
            for a, _b in m.files if m else []:
                fs.delete_file(a)

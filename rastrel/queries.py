"""Queries over the fixture tables, one for each group of operators."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import color, containers, lossless, png, quant, vp8
from .operators import convert, kernels, outcomes
from .plans import batching
from .sources import files
from .tables import inputs, load, pictures, pixels, planes, sizes, tiled

QUALITY = 75


# --- pixels, transforms, levels


def psnr_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """Squared error of quantised planes and PSNR by label."""
    q = F.shiftright(F.col("px") + 8, 4) * 16
    p = pixels(spark, sf).withColumn("d", F.col("px") - q)
    g = p.groupBy("label").agg(F.count("*").alias("n"), F.sum("px").alias("sum_px"), F.sum(F.col("d") * F.col("d")).alias("sse"))
    return g.select("label", "n", "sum_px", "sse", F.round(outcomes.psnr(F.col("sse"), F.col("n")), 6).alias("psnr"))


def plane_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """A15."""
    return pixels(spark, sf).groupBy("label", "px").agg(F.count("*").alias("n"))


def run_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of one value (in 32 steps) along each plane."""
    p = pixels(spark, sf).select("vec_id", "pos", F.shiftright("px", 3).alias("v"))
    return outcomes.runs(p, ["vec_id"], "pos", "v").groupBy("v", "run").agg(F.count("*").alias("n"))


def _whole(spark: SparkSession, sf: str) -> DataFrame:
    return planes(spark, sf).where("vec_id IS NOT NULL AND size(px) = 64 AND forall(px, x -> x IS NOT NULL)").select("vec_id", "px")


def fdct(spark: SparkSession, sf: str) -> DataFrame:
    """F10."""
    return kernels.fdct(_whole(spark, sf))


def _sixteen(spark: SparkSession, sf: str) -> DataFrame:
    """mb and the 16 DC values of its four planes; 0 where there is none."""
    dc = kernels.block_dc(_whole(spark, sf)).select(F.floor(F.col("vec_id") / 4).alias("mb"), (F.col("vec_id") % 4).alias("i"), "dc")
    own = dc.groupBy("mb").agg(F.map_from_entries(F.collect_list(F.struct("i", "dc"))).alias("m"))  # four planes at most
    none = F.array_repeat(F.lit(0).cast("long"), 4)
    return own.select("mb", F.flatten(F.array(*(F.coalesce(F.try_element_at("m", F.lit(i).cast("long")), none) for i in range(4)))).alias("dc"))


def fwht(spark: SparkSession, sf: str) -> DataFrame:
    """of the 16 DC values of four planes."""
    return kernels.fwht(_sixteen(spark, sf), "mb")


def iwht(spark: SparkSession, sf: str) -> DataFrame:
    """the DC values that come back from it."""
    return kernels.iwht(_sixteen(spark, sf), "mb")


def idct(spark: SparkSession, sf: str) -> DataFrame:
    """the residuals that the levels come back as."""
    return kernels.residuals(_whole(spark, sf), QUALITY)


def pad_planes(spark: SparkSession, sf: str) -> DataFrame:
    """parts of planes, of all sizes, made even and brought to the grid."""
    w, h = (F.col("vec_id") % 8 + 1).cast("int"), (F.floor(F.col("vec_id") / 8) % 8 + 1).cast("int")
    return kernels.padded(_whole(spark, sf).withColumn("w", w).withColumn("h", h))


def quantize_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Levels by position, and the error of what comes back."""
    e = F.col("c") - F.col("back")
    return kernels.levels(_whole(spark, sf), QUALITY).groupBy("k", "level").agg(F.count("*").alias("n"), F.sum(e * e).alias("sse"))


def zigzag_last(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks by the scan place of their last level; -1 for empty blocks."""
    return kernels.last_places(_whole(spark, sf), QUALITY).groupBy("last").agg(F.count("*").alias("blocks"))


def nz_context(spark: SparkSession, sf: str) -> DataFrame:
    """Each block's context from the blocks to the left and above; 32 planes stand side by side, four rows make one picture."""
    nz = kernels.last_places(_whole(spark, sf), QUALITY)
    at = nz.select(F.floor(F.col("vec_id") / 128).alias("pic"), (F.floor(F.col("vec_id") % 128 / 32) * 2 + F.floor(F.col("block") / 2)).cast("int").alias("y"), (F.col("vec_id") % 32 * 2 + F.col("block") % 2).cast("int").alias("x"), "nz")
    left = F.coalesce(F.lag("nz").over(Window.partitionBy("pic", "y").orderBy("x")), F.lit(0))
    up = F.coalesce(F.lag("nz").over(Window.partitionBy("pic", "x").orderBy("y")), F.lit(0))
    return at.select("nz", (left + up).alias("ctx")).groupBy("ctx", "nz").agg(F.count("*").alias("n"))


def y2_context(spark: SparkSession, sf: str) -> DataFrame:
    """The DC slot's context skips macroblocks with 4x4 modes."""
    p = planes(spark, sf).select("vec_id", F.floor(F.col("vec_id") / 32).alias("row"), (F.get("px", F.lit(0)) % 3 == 0).alias("small"), (F.get("px", F.lit(1)) % 2).cast("int").alias("nz"))
    w = Window.partitionBy("row").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, -1)
    return p.select("vec_id", F.coalesce(F.last(F.when(~F.col("small"), F.col("nz")), ignorenulls=True).over(w), F.lit(0)).alias("ctx"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each plane with its left and upper neighbour of a raster 16 wide; null outside."""
    p = _whole(spark, sf)
    left = p.select((F.col("vec_id") + 1).alias("vec_id"), F.col("px").alias("l"))
    up = p.select((F.col("vec_id") + 16).alias("vec_id"), F.col("px").alias("u"))
    return p.join(left.where("vec_id % 16 <> 0"), "vec_id", "left").join(up, "vec_id", "left")


def _modes(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id and the error of each whole-block mode DC, TM, V, H, predicted from source pixels."""
    return kernels.mode_errors(_pairs(spark, sf))


def predict_argmin(spark: SparkSession, sf: str) -> DataFrame:
    """The mode of least weighted cost; ties go to the smaller one."""
    cost = F.zip_with("sse", F.array(*(F.lit(c * vp8.WEIGHT_UV) for c in vp8.COST_UV)), lambda s, f: s * vp8.WEIGHT_SSE + f)
    m = _modes(spark, sf).withColumn("cost", cost)
    return m.select("vec_id", (F.array_position("cost", F.array_min("cost")) - 1).cast("int").alias("mode"), F.array_min("cost").alias("cost"))


def mode_top3(spark: SparkSession, sf: str) -> DataFrame:
    """The three best modes by error, stable."""
    best = F.slice(F.array_sort(F.transform("sse", lambda s, i: F.struct(s.alias("sse"), i.alias("mode")))), 1, 3)
    return _modes(spark, sf).select("vec_id", F.posexplode(best).alias("rank", "b")).select("vec_id", "rank", F.col("b.mode").cast("int").alias("mode"), "b.sse")


def predict_fours(spark: SparkSession, sf: str) -> DataFrame:
    """The errors of the ten 4x4 modes of every block, edges of the frame among them."""
    return kernels.small_mode_errors(_whole(spark, sf)).select("vec_id", "block", F.posexplode("sse").alias("mode", "sse"))


def _rgb(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") % 256).alias("g"), F.col("l_quantity").cast("long").alias("b"))


def rgb_to_y(spark: SparkSession, sf: str) -> DataFrame:
    """F1."""
    return kernels.luma(_rgb(spark, sf)).groupBy("y").agg(F.count("*").alias("n"))


def rgb_to_uv(spark: SparkSession, sf: str) -> DataFrame:
    """of the sums of four pixels, the lines of an order in order; the last line fills an incomplete cell."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "r", "g", "b")
    p = _rgb(spark, sf).withColumn("n", F.row_number().over(order) - 1).withColumn("cell", F.floor(F.col("n") / 4).cast("int"))
    cell = p.groupBy("l_orderkey", "cell").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{c}") for c in "rgb"), F.max_by(F.struct(*"rgb"), "n").alias("last"))
    return kernels.chroma(cell.select("l_orderkey", "cell", *((F.col(f"s{c}") + (4 - F.col("n")) * F.col(f"last.{c}")).alias(c) for c in "rgb")), ["l_orderkey", "cell"])


def quality_to_q(spark: SparkSession, sf: str) -> DataFrame:
    """F14."""

    def run(b: pa.RecordBatch) -> dict:
        return {"quality": b.column("id").cast(pa.int32()), "q": pa.array([quant.quality_index(x) for x in b.column("id").to_pylist()], pa.int32())}

    return kernels.mapped(spark.range(1, 101), run, "quality int, q int")


def quant_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The dimension table at three qualities, with the mean step of each plane."""
    rows = [r for q in (75, 90, 95) for r in quant.table(range(q, q + 1))]
    t = spark.createDataFrame(rows, quant.SCHEMA)
    mean = F.shiftright(F.sum("q").over(Window.partitionBy("quality", "plane")) + 8, 4)
    return t.withColumn("q_avg", mean)


# --- planning


def size_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """A1."""
    return batching.size_histogram(sizes(spark, sf))


def batch_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """A2, W5, O2."""
    s = sizes(spark, sf).withColumn("mb_w", F.floor((F.col("w") + 15) / 16).cast("int")).drop("h")
    return batching.batches(s, ["mb_w"], "rel", 16).groupBy("mb_w", "batch_id").agg(F.count("*").alias("n"), F.min("rel").alias("first"), F.max("rel").alias("last"))


def batch_slices(spark: SparkSession, sf: str) -> DataFrame:
    """A2, W5, O1, O2 through many slices: the batch of every picture."""
    s = sizes(spark, sf).select("rel", F.floor((F.col("w") + 15) / 16).cast("int").alias("mb_w"))
    return batching.batches(s, ["mb_w"], "rel", 16, part=100).select("mb_w", "rel", "batch_id")


def byte_slices(spark: SparkSession, sf: str) -> DataFrame:
    """A5 through many slices: the greedy group of every page."""
    p = inputs(spark, sf).select((F.col("page_id") % 3).cast("int").alias("k"), "page_id", "size")
    return batching.byte_groups(p, ["k"], "page_id", "size", 1 << 14, 0, run=9).select("k", "page_id", "group_id")


def raw_size_adam7(spark: SparkSession, sf: str) -> DataFrame:
    """With and without interlacing."""
    s = sizes(spark, sf).withColumn("color", F.get(F.array(*(F.lit(c) for c in (0, 2, 4, 6))), (F.col("w") % 4).cast("int"))).withColumn("depth", F.when(F.col("h") % 2 == 0, 8).otherwise(16))
    size = lambda i: batching.raw_size(F.col("w"), F.col("h"), F.col("depth"), F.col("color"), F.lit(i))
    return s.select("rel", size(0).alias("plain"), size(1).alias("interlaced"))


def bucket_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The plan made from the histogram, joined back to the pictures."""
    s = sizes(spark, sf).select("rel", (F.floor((F.col("h") + 15) / 16) * 16).cast("int").alias("h"), (F.floor((F.col("w") + 15) / 16) * 16).cast("int").alias("w"))
    return batching.bucketed(s).groupBy("bucket_h", "bucket_w").agg(F.count("*").alias("n"), F.max("h").alias("max_h"), F.max("w").alias("max_w"))


def byte_groups(spark: SparkSession, sf: str) -> DataFrame:
    """A5: pages in greedy groups of at most 64 KB for each host key."""
    p = inputs(spark, sf).select((F.col("page_id") % 3).cast("int").alias("k"), "page_id", "size")
    return batching.byte_groups(p, ["k"], "page_id", "size", 1 << 16, 0).groupBy("k", F.lit(0).cast("long").alias("batch_id"), "group_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def size_gates(spark: SparkSession, sf: str) -> DataFrame:
    """P2, P3, P4."""
    g = sizes(spark, sf).select(files.gates(F.col("w") * 6, F.col("h") * 6).alias("g")).select("g.*")
    return g.groupBy("too_large", "odd", "aligned").agg(F.count("*").alias("n"))


def largest_group(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest size of each orientation."""
    n = sizes(spark, sf).groupBy("w", "h").agg(F.count("*").alias("n"))
    key = F.struct("n", -F.col("w"), -F.col("h"))
    return n.groupBy((F.col("h") > F.col("w")).alias("portrait")).agg(F.max_by("w", key).alias("w"), F.max_by("h", key).alias("h"), F.max("n").alias("n"))


# --- files


def _existing(spark: SparkSession, sf: str) -> DataFrame:
    return inputs(spark, sf).where("page_id % 5 = 0").select(files.out_path(F.col("rel")).alias("out_path")).distinct()


def skip_existing(spark: SparkSession, sf: str) -> DataFrame:
    """P1, P7, J1, J7."""
    return outcomes.pending(inputs(spark, sf).withColumn("out_path", files.out_path(F.col("rel"))), _existing(spark, sf)).select("rel", "out_path")


def delete_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs whose output exists, PNGs only."""
    i = inputs(spark, sf).where(files.extension(F.col("rel")) == ".png").withColumn("out_path", files.out_path(F.col("rel")))
    return outcomes.finished(i, _existing(spark, sf)).select("rel", "out_path")


def first_writer(spark: SparkSession, sf: str) -> DataFrame:
    """K2, K4: one input for each output."""
    return outcomes.first_writer(inputs(spark, sf).select("rel", "size", files.out_path(F.col("rel")).alias("out_path")))


def path_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """K4."""
    i = inputs(spark, sf).select(files.out_path(F.col("rel")).alias("out_path"))
    return i.groupBy("out_path").agg(F.count("*").alias("n")).where("n > 1")


def corpus_union(spark: SparkSession, sf: str) -> DataFrame:
    """PNGs and other pictures, by extension."""
    i = inputs(spark, sf).withColumn("ext", files.extension(F.col("rel")))
    a, b = i.where(F.col("ext") == ".png"), i.where(F.col("ext").isin(files.EXTENSIONS))
    return a.unionByName(b).groupBy("ext").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def meta_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Texts before and after, by place; a full outer join."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("raw"))
    a = c.where("turn % 5 <> 4")
    b = c.where("turn % 7 <> 6").withColumn("raw", F.when(F.col("conv_id") % 10 == 3, F.lit("x")).otherwise(F.col("raw")))
    j = a.join(b.withColumnRenamed("raw", "raw2"), ["conv_id", "turn"], "full_outer")
    what = F.when(F.col("raw").isNull(), "added").when(F.col("raw2").isNull(), "lost").when(F.col("raw").eqNullSafe(F.col("raw2")), "same").otherwise("changed")
    return j.groupBy("conv_id", what.alias("what")).agg(F.count("*").alias("n"))


def crc_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed tenth of the files."""
    return inputs(spark, sf).where(outcomes.sampled(F.col("rel"), 10)).select("rel")


def md5_check(spark: SparkSession, sf: str) -> DataFrame:
    """A23."""
    return load(spark, sf, "pages").select("page_id", F.md5(F.col("html").cast("binary")).alias("md5"))


def adler32(spark: SparkSession, sf: str) -> DataFrame:
    """A22."""

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        import zlib

        return x.map(lambda b: zlib.adler32(b) if b is not None else None)

    return load(spark, sf, "pages").select("page_id", run(F.col("html").cast("binary")).alias("adler"))


def format_sniff(spark: SparkSession, sf: str) -> DataFrame:
    """Formats by the first bytes; a table of samples and all pages."""
    samples = [bytes.fromhex(x) for x in ("ffd8ffe000104a464946", "52494646aaaaaaaa57454250", "424d1234", "49492a0008", "4d4d002a00", "474946383761", "474946383961", "ff4fff51", "ff0a", "0000000c4a584c20", "0000001c6674797061766966", "0000001c6674797068656963", "44445320", "716f6966", "89504e470d0a1a0a", "1234")]
    s = spark.createDataFrame([(x,) for x in samples], "content binary").union(load(spark, sf, "pages").select(F.col("html").cast("binary")))
    return s.groupBy(files.format_of(F.col("content")).alias("format")).agg(F.count("*").alias("n"))


def png_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Header fields of PNG files by column expressions."""
    h = pictures(spark, sf).select("vec_id", files.header(F.col("content")).alias("h"))
    return h.select("vec_id", "h.w", "h.h", "h.depth", "h.color", "h.interlace", "h.mb_h", "h.mb_w", "h.legal", files.supported(F.col("h")).alias("native"))


def png_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all files, counted by kind, with their checksums."""
    c = files.chunks_of(pictures(spark, sf).select("vec_id", "content"), ["vec_id"])
    return c.groupBy("type").agg(F.count("*").alias("n"), F.count_if("crc_ok").alias("ok"))


def png_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of decoded pixels of all colour kinds, depths and interlaces."""

    def run(it):
        for pdf in it:
            a = [png.decode(bytes(c)) for c in pdf["content"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "red": [int(x[..., 0].sum()) for x in a], "alpha": [int(x[..., 3].sum()) for x in a], "opaque": [bool((x[..., 3] == 255).all()) for x in a]})

    return pictures(spark, sf).mapInPandas(run, "vec_id long, red long, alpha long, opaque boolean")


def png_text(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and physical size out of the chunks, by column expressions."""
    c = files.chunks_of(pictures(spark, sf).select("vec_id", "content"), ["vec_id"])
    text = F.decode(F.col("payload"), "ISO-8859-1")
    t = c.where(F.col("type").isin("tEXt", "pHYs")).groupBy("vec_id").agg(F.max(F.when(F.col("type") == "tEXt", F.substring_index(text, "\0", 1))).alias("key"), F.max(F.when(F.col("type") == "tEXt", F.substring_index(text, "\0", -1))).alias("value"), F.max(F.when(F.col("type") == "pHYs", files.big_endian(F.col("payload"), 1, 4))).alias("per_meter"))
    return t


def riff_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Containers around page texts, with and without metadata, and their chunks as they are read back."""

    def run(b: pa.RecordBatch) -> dict:
        out = []
        for i, html in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True):
            raw = html.encode()
            frame = b"\x10\2\0\x9d\1\x2a" + (1 + i % 5000).to_bytes(2, "little") + (1 + i % 300).to_bytes(2, "little") + raw
            data = containers.webp(frame, None, raw[:7] if i % 3 == 1 else None, raw[:10] if i % 2 else None, None)
            out += [(i, k, kind, len(x), hashlib.md5(x).hexdigest()) for k, (kind, x) in enumerate(containers.riff(data))]
        cols = zip(("page_id", "seq", "type", "size", "md5"), zip(*out, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()), strict=True)
        return {n: pa.array(c, k) for n, c, k in cols}

    return kernels.mapped(load(spark, sf, "pages").where("html IS NOT NULL").select("page_id", "html"), run, "page_id long, seq int, type string, size long, md5 string")


def rgba_psnr(spark: SparkSession, sf: str) -> DataFrame:
    """Decoded pictures against themselves in steps of 16, over all four channels."""

    def run(b: pa.RecordBatch) -> dict:
        a = [png.decode(x) for x in b.column("content").to_pylist()]
        return {"vec_id": b.column("vec_id"), "psnr": pa.array([round(color.psnr(x, x >> 4 << 4), 6) for x in a], pa.float64())}

    return kernels.mapped(pictures(spark, sf).select("vec_id", "content"), run, "vec_id long, psnr double")


def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Among pictures, files that are none fail one by one and come back as they were."""
    pages = load(spark, sf, "pages").where("html IS NOT NULL").select(F.concat(F.lit("bad/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".jpg").otherwise(".png")).alias("rel"), F.col("html").cast("binary").alias("content"))
    all_ = tiled(spark, sf).select("rel", "content").unionByName(pages)
    bad = convert.quarantine(convert.convert(all_, min_psnr=None), all_)
    return bad.select("rel", F.md5("content").alias("md5"))


# --- entropy and lossless coding


def _histogram(spark: SparkSession, sf: str) -> DataFrame:
    """lang, b, n: letters by language."""
    d = load(spark, sf, "documents").select("lang", F.explode(F.split(F.col("text"), "")).alias("b"))
    return d.where("b <> ''").groupBy("lang", "b").agg(F.count("*").alias("n"))


def entropy_bits(spark: SparkSession, sf: str) -> DataFrame:
    """Bits of the letters of each language."""
    t = F.sum("n").over(Window.partitionBy("lang"))
    return _histogram(spark, sf).withColumn("bits", -F.col("n") * F.log2(F.col("n") / t)).groupBy("lang").agg(F.sum("n").alias("letters"), F.round(F.sum("bits") / F.sum("n"), 6).alias("bits"))


def prefix_code(spark: SparkSession, sf: str) -> DataFrame:
    """Symbol and extra bits of lengths 1 to 4096."""

    def run(b: pa.RecordBatch) -> dict:
        symbol, bits, extra = lossless.prefix_codes(b.column("id").to_numpy())
        return {"value": b.column("id"), "symbol": pa.array(symbol.astype(np.int32)), "bits": pa.array(bits.astype(np.int32)), "extra": pa.array(extra)}

    return kernels.mapped(spark.range(1, 4097), run, "value long, symbol int, bits int, extra long")


def canonical_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical codes of lengths by rule, by length and symbol, first bit highest."""
    lens = spark.range(0, 16).select(F.col("id").cast("int").alias("sym"), F.when(F.col("id") < 2, 2).when(F.col("id") < 5, 3).when(F.col("id") < 6, 4).otherwise(8).cast("int").alias("len"))

    def run(b: pa.RecordBatch) -> dict:
        n = b.column("n")[0].as_py()
        code = [int(f"{c:0{k}b}"[::-1], 2) for c, k in zip(lossless.canonical(n), n, strict=True)]
        return {"sym": pa.array(range(len(n)), pa.int32()), "len": pa.array(n, pa.int32()), "code": pa.array(code, pa.int64())}

    one = lens.agg(F.transform(F.array_sort(F.collect_list(F.struct("sym", "len"))), lambda x: x["len"]).alias("n"))  # 16 rows
    return kernels.mapped(one, run, "sym int, len int, code long")


def _coded(spark: SparkSession, sf: str, longest: int) -> DataFrame:
    """lang, n, len: the code lengths of the letters of each language."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        return pdf.assign(len=lossless.code_lengths(pdf["n"].tolist(), longest))[["lang", "n", "len"]]

    return _histogram(spark, sf).groupBy("lang").applyInPandas(run, "lang string, n long, len int")


def huffman_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Code lengths for the letters of each language within the format's limit, and the bits they take."""
    return _coded(spark, sf, lossless.LONGEST).groupBy("lang").agg(F.sum(F.col("n") * F.col("len")).alias("bits"), F.max("len").alias("longest"), F.sum(F.expr("shiftleft(1L, 15 - len)")).alias("kraft"))


def huffman_bits(spark: SparkSession, sf: str) -> DataFrame:
    """The bits of a code without a limit, which no other code can undercut."""
    return _coded(spark, sf, 48).groupBy("lang").agg(F.sum(F.col("n") * F.col("len")).alias("bits"))


def prob_update_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions by slot, fitted probabilities, and whether sending them pays."""
    lv = kernels.levels(_whole(spark, sf), QUALITY).groupBy("k").agg(F.count_if(F.col("level") == 0).alias("n0"), F.count_if(F.col("level") != 0).alias("n1"))

    def run(b: pa.RecordBatch) -> dict:
        n0, n1 = b.column("n0").to_numpy(), b.column("n1").to_numpy()
        new, send = vp8.fit_probabilities(n0, n1, np.full(len(n0), 128), np.full(len(n0), 250))
        bits = lambda p: -(n0 * np.log2(p / 256) + n1 * np.log2(1 - p / 256))
        return {**{c: b.column(c) for c in ("k", "n0", "n1")}, "new_p": pa.array(new.astype(np.int32)), "saved": pa.array(np.round(bits(128) - bits(new), 4)), "send": pa.array(send)}

    return kernels.mapped(lv, run, "k int, n0 long, n1 long, new_p int, saved double, send boolean")


def alpha_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Planes (in four steps) coded without loss and read by the decoder."""

    def run(it):
        for pdf in it:
            out = []
            for i, p in zip(pdf["vec_id"], pdf["px"], strict=True):
                a = (np.asarray(p) >> 6 << 6).astype(np.uint8).reshape(8, 8)
                b = lossless.decode_alpha(lossless.encode_alpha(a), 8, 8)
                out.append((i, int(b.sum()), bool((a == b).all())))
            yield pd.DataFrame(out, columns=["vec_id", "total", "same"])

    return planes(spark, sf).mapInPandas(run, "vec_id long, total long, same boolean")


# --- metadata


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id and its turns in order, as the texts of a picture."""
    t = load(spark, sf, "conversations").where("text IS NOT NULL")
    return t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("key"), "text"))).alias("texts"))  # one conversation


def _packets(b: pa.RecordBatch) -> list[bytes]:
    of = lambda t: {"type": "tEXt", "key": t["key"], "value": t["text"], "raw": t["text"].encode()}
    return [containers.build_xmp({"texts": [of(t) for t in ts]}) for ts in b.column("texts").to_pylist()]


def xmp_build(spark: SparkSession, sf: str) -> DataFrame:
    """M2, M7, M8: the packet of each conversation."""

    def run(b: pa.RecordBatch) -> dict:
        p = _packets(b)
        return {"conv_id": b.column("conv_id"), "n": pa.array([len(x) for x in b.column("texts")], pa.int64()), "md5": pa.array([hashlib.md5(x).hexdigest() for x in p])}

    return kernels.mapped(_texts(spark, sf), run, "conv_id long, n long, md5 string")


def xmp_parse(spark: SparkSession, sf: str) -> DataFrame:
    """M3, M6: keys, values and raw texts out of the packets."""

    def run(b: pa.RecordBatch) -> dict:
        out = []
        for c, p in zip(b.column("conv_id").to_pylist(), _packets(b), strict=True):
            meta = containers.parse_xmp(p)
            out += [(c, i, t["key"], t["value"], hashlib.md5(raw).hexdigest()) for i, (t, (_, raw)) in enumerate(zip(meta["texts"], containers.restore_chunks(meta), strict=True))]
        conv, i, key, value, md5 = zip(*out, strict=True)
        return {"conv_id": pa.array(conv, pa.int64()), "i": pa.array(i, pa.int32()), "key": pa.array(key), "value": pa.array(value), "md5": pa.array(md5)}

    return kernels.mapped(_texts(spark, sf), run, "conv_id long, i int, key string, value string, md5 string")


# --- outcomes


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "fallback").when(F.col("event_type") == "view", "skipped").otherwise("ok")
    return e.select("event_id", "ts", "user_id", status.alias("status"), F.floor(F.col("value") * 100).cast("long").alias("src_bytes"), F.floor(F.col("value") * 37).cast("long").alias("dst_bytes"))


def outcome_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """A12, A13."""
    return outcomes.rollup(_outcomes(spark, sf), F.pmod("user_id", F.lit(10)).cast("int").alias("worker"))


def progress_window(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of each hour with totals so far and the least size of the last three hours."""
    h = _outcomes(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("hour"), "status").agg(F.count("*").alias("n"), F.min("src_bytes").alias("least"))
    w = Window.partitionBy("status").orderBy("hour")
    return h.select("hour", "status", "n", F.sum("n").over(w).alias("so_far"), F.min("least").over(w.rowsBetween(-2, 0)).alias("least_of_3"))


def verify_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The first failing check of each outcome, and what becomes of it."""
    e = load(spark, sf, "events").select("event_id", (F.col("event_id") % 11 != 0).alias("dims"), (F.col("user_id") % 13 != 0).alias("alpha"), (F.col("event_id") % 7 != 0).alias("meta"), (F.round(F.col("value") % 20, 2) + 30).alias("p"))
    first = outcomes.note(F.col("dims"), F.col("alpha"), F.col("meta"), F.col("p"))
    second = outcomes.note(F.lit(True), F.lit(True), F.col("event_id") % 3 != 0, F.col("p") + 2)
    e = e.withColumn("a", first).withColumn("b", second)
    kind = F.substring_index("a", " ", 1)
    return e.groupBy(kind.alias("note"), outcomes.accepted(F.col("a"), F.col("b")).alias("status")).agg(F.count("*").alias("n"))


def keep_smaller(spark: SparkSession, sf: str) -> DataFrame:
    """Of two attempts the smaller one that reaches the target, else the first."""
    e = load(spark, sf, "events").where("value IS NOT NULL").select("event_id", F.floor("value").cast("long").alias("a"), F.floor(F.col("value") * 0.9).cast("long").alias("b"), (F.col("event_id") % 4).cast("int").alias("p"))
    tries = e.select("event_id", F.lit(1).alias("attempt"), F.col("a").alias("size"), F.lit(True).alias("good")).union(e.select("event_id", F.lit(2), "b", F.col("p") > 0))
    return tries.groupBy("event_id").agg(F.min_by("attempt", F.struct(~F.col("good"), "size", "attempt")).alias("attempt"), F.min_by("size", F.struct(~F.col("good"), "size", "attempt")).alias("size"))


def rate_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Strengths for PSNRs over a target of 40, grouped by root."""
    e = load(spark, sf, "events").select((F.floor(F.col("value") * 10).cast("long") % 100 / 10.0 + 38).cast("double").alias("p"))
    return kernels.scaled(e.where("p > 40.15"), "p", lambda p: convert.root(p, 40)).groupBy(F.col("p").alias("root")).agg(F.count("*").alias("n"))


# --- whole conversions


def convert_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Every picture is converted; size, alpha and metadata out of what was written."""
    done = convert.convert(tiled(spark, sf).select("rel", "content"))

    def read(b: pa.RecordBatch) -> dict:
        out = []
        for data in b.column("bytes").to_pylist():
            found, meta = dict(containers.riff(data)), containers.webp_meta(data)
            w, h = (int.from_bytes(found["VP8 "][i : i + 2], "little") & 0x3FFF for i in (6, 8))
            alpha = int(lossless.decode_alpha(found["ALPH"], h, w).sum()) if "ALPH" in found else 255 * h * w
            out.append((w, h, "VP8X" in found, alpha, *next(((t["key"], t["value"]) for t in meta["texts"]), (None, None)), meta["phys_raw"] and int.from_bytes(meta["phys_raw"][:4], "big")))
        cols = zip(("w", "h", "extended", "alpha", "key", "value", "per_meter"), zip(*out, strict=True), (pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)
        return {"rel": b.column("rel"), "out_path": b.column("out_path"), **{n: pa.array(c, k) for n, c, k in cols}}

    written = done.where("bytes IS NOT NULL AND status IN ('ok', 'fallback')").select("rel", "out_path", "bytes")
    return kernels.mapped(written, read, "rel string, out_path string, w int, h int, extended boolean, alpha long, `key` string, value string, per_meter long")


def outcome_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """A10, A11, A12, K5 over a conversion at the usual gate: status, sizes and PSNR of each picture."""
    return convert.convert(tiled(spark, sf).select("rel", "content")).select("rel", "status", "note", F.round("psnr", 3).alias("psnr"), "src_bytes", "dst_bytes")


def rlambda_two_pass(spark: SparkSession, sf: str) -> DataFrame:
    """of every picture the smaller of two encodings at a target of 36 dB."""
    return convert.two_pass(tiled(spark, sf).select("rel", "content"), 36.0)


QUERIES = {
    f.__name__: f
    for f in (
        psnr_by_label, plane_histogram, run_lengths, fdct, fwht, iwht, idct, pad_planes, quantize_levels, zigzag_last, nz_context, y2_context, predict_argmin, mode_top3, predict_fours, rgb_to_y, rgb_to_uv, quality_to_q, quant_matrix,
        size_histogram, batch_assignment, batch_slices, raw_size_adam7, bucket_plan, byte_groups, byte_slices, size_gates, largest_group, skip_existing, delete_candidates, first_writer, path_collisions, corpus_union, meta_diff,
        crc_sample, md5_check, adler32, format_sniff, png_headers, png_chunks, png_decode, png_text, riff_chunks, rgba_psnr, quarantine, entropy_bits, prefix_code, canonical_codes, huffman_lengths, huffman_bits, prob_update_fit, alpha_roundtrip,
        xmp_build, xmp_parse, outcome_rollup, progress_window, verify_gate, keep_smaller, rate_scale, convert_corpus, outcome_sizes, rlambda_two_pass,
    )
}

"""Conversion of a corpus: decode, group by size, encode, verify, choose, report.

Statuses: ok, fallback (too large for the first encoder, or verified at plain settings after the first result
failed), fail (unreadable, or never verified), skipped (the output is there already). A bad file is a row of its
own status; it never disturbs the others of its batch. A file is read and decoded once, in the task that
encodes it, and written once, after verification. Files move once, as they are, to groups of about ``GROUP``
by a hash of rel; pixels never move. Inside a group pictures are encoded in batches of one size on the
macroblock grid; rare sizes share batches as ``plan_buckets`` has it, padded with zeros.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color, containers, formats, jpeg, lossless, png, vp8
from ..plans.batching import plan_buckets
from ..sources.files import format_of, header, out_path

MIN_PSNR, MAX_PIXELS, CAP, GROUP = 34.0, 24_000_000, 16, 64

OUTCOME = "rel string, out_path string, status string, note string, psnr double, src_bytes long, dst_bytes long, bytes binary"
_OUTCOME = [c.split()[0] for c in OUTCOME.split(", ")]


def read_any(data: bytes, tables: vp8.Tables | None = None) -> tuple[np.ndarray, dict]:
    """RGBA and metadata of a PNG, a baseline or progressive JPEG, a simple raster format, or a lossy WebP of the given tables."""
    kind = containers.sniff(data) or ("pnm" if data[:1] == b"P" and data[1:2] in b"123456" else "tga" if data[2:3] in (b"\2", b"\3") else None)
    if kind == "png":
        return png.decode(data), containers.png_meta(data)
    if kind == "webp":
        return decode_webp(data, tables), containers.webp_meta(data)
    if kind == "jpeg":
        return jpeg.decode(data), formats.jpeg_meta(data)
    if kind in formats.READERS:
        return formats.READERS[kind](data), {"texts": [], "phys_raw": None, "exif_raw": None, "icc_raw": None, "xmp_raw": None}
    raise ValueError(f"format {kind}")


def decode_webp(data: bytes, tables: vp8.Tables | None = None) -> np.ndarray:
    found = dict(containers.riff(data))
    rgb = vp8.decode_rgb(found["VP8 "], tables)
    out = np.full((*rgb.shape[:2], 4), 255, np.uint8)
    out[..., :3] = rgb
    if "ALPH" in found:
        out[..., 3] = lossless.decode_alpha(found["ALPH"], *rgb.shape[:2])
    return out


def wrap(frame: bytes, rgba: np.ndarray, meta: dict) -> bytes:
    """The container: alpha only if any pixel isn't opaque, the packet only if there are texts or a size."""
    alpha = lossless.encode_alpha(rgba[..., 3]) if (rgba[..., 3] != 255).any() else None
    packet = containers.build_xmp(meta) if meta["texts"] or meta.get("phys_raw") else meta.get("xmp_raw")
    return containers.webp(frame, alpha, meta.get("icc_raw"), meta.get("exif_raw"), packet)


def verify(rgba: np.ndarray, meta: dict, data: bytes, min_psnr: float = MIN_PSNR, tables: vp8.Tables | None = None) -> tuple[str | None, float]:
    """What is wrong first (size, alpha, metadata, PSNR), or None; and the PSNR over all channels."""
    try:
        back = decode_webp(data, tables)
    except (ValueError, KeyError, IndexError) as e:
        return f"unreadable: {e}", -1.0
    p = color.psnr(rgba, back)
    if back.shape != rgba.shape:
        return "size", p
    if (back[..., 3] != rgba[..., 3]).any():
        return "alpha", p
    if lost := containers.differences(meta, containers.webp_meta(data)):
        return "metadata: " + ", ".join(lost), p
    return (None if p >= min_psnr else f"PSNR {p:.2f}"), p


def _grouped(files: DataFrame, group: int) -> DataFrame:
    """files with the group each belongs to: evenly filled, whatever the sizes; files with one output share a group."""
    n = max(1, -(-files.select("rel").count() // group))
    return files.withColumn("group_", F.pmod(F.xxhash64("out_path"), F.lit(n)))


def _read(pdf: pd.DataFrame, tables: vp8.Tables | None) -> tuple[list[tuple], list[tuple]]:
    """(row, rgba, meta) of the files of a group that can be read, and the outcomes of the others."""
    good, bad = [], []
    for r in pdf.sort_values("rel").itertuples():
        data = bytes(r.content) if r.content is not None else b""
        try:
            good.append((r, *read_any(data, tables)))
        except Exception as e:  # noqa: BLE001  a broken file is a result
            bad.append((r.rel, r.out_path, "fail", str(e)[:200], None, len(data), None, None))
    return good, bad


def batched(sizes: list[tuple[int, int]], cap: int) -> list[list[int]]:
    """Places of pictures (rows and columns of macroblocks) in batches of at most cap of one size, or of rare sizes of one bucket."""
    count = Counter((16 * h, 16 * w) for h, w in sizes)
    bucket = plan_buckets([(*k, n) for k, n in sorted(count.items())], cap)
    held: dict[tuple[int, int], list[int]] = {}
    for i, (h, w) in enumerate(sizes):
        held.setdefault(bucket.get((16 * h, 16 * w), (16 * h, 16 * w)), []).append(i)
    return [own[k : k + cap] for _, own in sorted(held.items()) for k in range(0, len(own), cap)]


def _skipped(rel: str, to: str, why: str, content: bytes | None) -> tuple:
    return rel, to, "skipped", why, None, None if content is None else len(content), None, None


def _grid(rgba: np.ndarray) -> tuple[int, int]:
    return -(-rgba.shape[0] // 16), -(-rgba.shape[1] // 16)


def _encoder(quality: float, cap: int, min_psnr: float | None, strength: float, tables: vp8.Tables | None, max_pixels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Turns a group of files into their outcomes."""

    def encode(images: list[np.ndarray]) -> list[bytes]:
        try:
            return [f for f, _ in vp8.encode_rgb([x[..., :3] for x in images], quality, tables, strength=strength)]
        except MemoryError:
            if len(images) < 2:
                raise
            half = len(images) // 2
            return encode(images[:half]) + encode(images[half:])

    def settled(r, x: np.ndarray, m: dict, frame: bytes | None, checked: bool) -> tuple:
        """The outcome of a picture; frame: the first encoder's, None for pictures that are too large for it."""
        data, status, note, p = frame and wrap(frame, x, m), "ok", None, math.nan
        if data is not None and checked:
            note, p = verify(x, m, data, min_psnr, tables)
        if data is None or note:
            data = wrap(vp8.encode_rgb([x[..., :3]], quality if strength else min(100, quality + 5), tables)[0][0], x, m)
            status = "fallback"
            if checked:
                why, p = verify(x, m, data, min_psnr, tables)
                if why is not None and not why.startswith("PSNR"):
                    status, note = "fail", why
        return r.rel, r.out_path, status, note, None if math.isnan(p) else p, len(r.content), len(data), None if status == "fail" else data

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        late = pdf.sort_values("rel").duplicated("out_path").reindex(pdf.index)
        good, out = _read(pdf[~late], tables)
        out += [_skipped(r.rel, r.out_path, "another file has this output", r.content) for r in pdf[late].itertuples()]
        check = lambda r: min_psnr is not None and bool(r.checked)
        large, small = ([g for g in good if (g[1].shape[0] * g[1].shape[1] > max_pixels) == over] for over in (True, False))
        out += [settled(r, x, m, None, check(r)) for r, x, m in large]
        for at in batched([_grid(x) for _, x, _ in small], cap):
            for i, f in zip(at, encode([small[i][1] for i in at]), strict=True):
                r, x, m = small[i]
                out.append(settled(r, x, m, f, check(r)))
        return pd.DataFrame(out, columns=_OUTCOME)

    return run


def encoded(files: DataFrame, quality: float = 90, cap: int = CAP, min_psnr: float | None = MIN_PSNR, strength: float = 0.0, verify_share: int = 100, tables: vp8.Tables | None = None, max_pixels: int = MAX_PIXELS, group: int = GROUP) -> DataFrame:
    """Encodes files (rel, out_path, content) in batches, verifies a share of them by a hash of rel, falls back, and reports.

    Of files with one output the least rel is taken; the others are skipped.

    With strength above 0 (rate-distortion optimised levels) the fallback is the plain quantiser; without
    it a higher quality. A result whose only note is its PSNR is accepted from the fallback. Pictures of more
    than max_pixels go to the fallback at once. A batch that memory doesn't hold is halved until it does.
    """
    checked = F.crc32(F.col("rel").cast("binary")) % 100 < verify_share
    work = _grouped(files.select("rel", "out_path", "content", checked.alias("checked")), group)
    return work.groupBy("group_").applyInPandas(_encoder(quality, cap, min_psnr, strength, tables, max_pixels), OUTCOME)


def convert(files: DataFrame, existing: DataFrame | None = None, **options) -> DataFrame:
    """files: rel, content; existing: out_path. Files whose output is there are skipped; for the others see ``encoded``."""
    work = files.select("rel", out_path(F.col("rel")).alias("out_path"), "content")
    if existing is None:
        return encoded(work, **options)
    known = existing.select("out_path").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    there = work.join(known, "out_path", "left_semi").select("rel", "out_path", F.lit("skipped").alias("status"), F.lit("the output is there").alias("note"), none("double").alias("psnr"), F.octet_length("content").cast("long").alias("src_bytes"), none("long").alias("dst_bytes"), none("binary").alias("bytes"))
    return encoded(work.join(known, "out_path", "left_anti").select("rel", "out_path", "content"), **options).unionByName(there)


def write(outcomes: DataFrame, dst: str) -> None:
    """Results to dst, originals of failed files nowhere: they are listed by ``quarantine``."""
    outcomes.where("bytes IS NOT NULL").select("out_path", "bytes").write.format("imagecorpus").mode("append").option("path", dst).save()


def quarantine(outcomes: DataFrame, files: DataFrame, dst: str | None = None) -> DataFrame:
    """rel, note and content of the files that failed; rel keeps its folders, so no two collide. With dst they are copied there."""
    failed = outcomes.where("status = 'fail'").select("rel", "note").join(files.select("rel", "content"), "rel")
    if dst:
        failed.where("content IS NOT NULL").select(F.col("rel").alias("out_path"), F.col("content").alias("bytes")).write.format("imagecorpus").mode("append").option("path", dst).save()
    return failed


def two_pass(files: DataFrame, target: float, quality: float = 90, cap: int = CAP, tables: vp8.Tables | None = None, group: int = GROUP) -> DataFrame:
    """rel, strength, size and PSNR of the smaller of two encodings, the second with levels as coarse as the target allows. Files that can't be read have no row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        good, _ = _read(pdf, tables)
        rgb, out = [x[..., :3] for _, x, _ in good], []
        for at in batched([_grid(x) for x in rgb], cap):
            tries = {i: [(0.0, *t)] for i, t in zip(at, vp8.encode_rgb([rgb[i] for i in at], quality, tables), strict=True)}
            again = [i for i in at if tries[i][0][2] > target + 0.15]
            s = [scale(tries[i][0][2], target) for i in again]
            if again:
                for i, x, t in zip(again, s, vp8.encode_rgb([rgb[i] for i in again], quality, tables, strength=np.array(s) / 8), strict=True):
                    tries[i].append((x, *t))
            for i in at:
                x, data, p = min([t for t in tries[i] if t[2] >= target] or tries[i][:1], key=lambda t: len(t[1]))
                out.append((good[i][0].rel, x, len(tries[i][0][1]), len(data), p))
        return pd.DataFrame(out, columns=["rel", "strength", "plain_bytes", "bytes", "psnr"])

    work = files.select("rel", out_path(F.col("rel")).alias("out_path"), "content")
    return _grouped(work, group).groupBy("group_").applyInPandas(run, "rel string, strength double, plain_bytes long, bytes long, psnr double")


def root(p: float, target: float) -> float:
    """The root of the strength for a PSNR above target, in steps of 0.01."""
    return round(math.sqrt(min(8.0, math.exp((p - target) / 1.15))), 2)


def scale(p: float, target: float) -> float:
    return root(p, target) ** 2


def headers(files: DataFrame) -> DataFrame:
    """rel and the fields of the header and format of each file."""
    return files.select("rel", format_of(F.col("content")).alias("format"), header(F.col("content")).alias("h")).select("rel", "format", "h.*")

"""The pixel kernels over DataFrames: whole Arrow batches of planes go through numpy at one go, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color, predict, quant, transform

LEVELS = "vec_id long, block int, k int, c long, level long, back long"


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """f on every batch that holds rows; it gives a column for each field of the schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict(f(b))

    return df.mapInArrow(run, schema)


def matrix(x: pa.Array, width: int) -> np.ndarray:
    """Lists of one width as rows."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)


def coefficients(px: np.ndarray) -> np.ndarray:
    """(n, 4, 16): the transformed residuals from 128 of the four 4x4 blocks of planes (n, 64)."""
    d = (px - 128).reshape(-1, 2, 4, 2, 4).transpose(0, 1, 3, 2, 4)
    return transform.fdct(d).reshape(len(px), 4, 16)


def _spread(ids: pa.Array, *inner: int) -> dict:
    """vec_id, and an index for each inner axis, for arrays (n, *inner)."""
    at = np.indices((len(ids), *inner)).reshape(1 + len(inner), -1)
    return {"vec_id": ids.take(pa.array(at[0])), **{c: pa.array(x.astype(np.int32)) for c, x in zip(("block", "k"), at[1:], strict=False)}}


def fdct(planes: DataFrame) -> DataFrame:
    """vec_id, block, k, c of planes (vec_id, px)."""
    return mapped(planes, lambda b: {**_spread(b.column("vec_id"), 4, 16), "c": pa.array(coefficients(matrix(b.column("px"), 64)).ravel())}, "vec_id long, block int, k int, c long")


def block_dc(planes: DataFrame) -> DataFrame:
    """vec_id and its four DC values."""
    return mapped(planes, lambda b: {"vec_id": b.column("vec_id"), "dc": pa.array(list(coefficients(matrix(b.column("px"), 64))[:, :, 0]))}, "vec_id long, dc array<long>")


def fwht(dc: DataFrame, key: str, kind: str = "long") -> DataFrame:
    """key, k, c of rows (key, dc) with 16 DC values."""

    def run(b: pa.RecordBatch) -> dict:
        c = transform.fwht(matrix(b.column("dc"), 16).reshape(-1, 4, 4)).reshape(-1, 16)
        at = _spread(b.column(key), 16)
        return {key: at["vec_id"], "k": at["block"], "c": pa.array(c.ravel())}

    return mapped(dc.select(key, "dc"), run, f"{key} {kind}, k int, c long")


def levels(planes: DataFrame, quality: float) -> DataFrame:
    """vec_id, block, k, coefficient, level and what comes back, luma with its DC."""
    s = quant.matrices(quant.quality_index(quality))["y1"]

    def run(b: pa.RecordBatch) -> dict:
        c = coefficients(matrix(b.column("px"), 64))
        lv = quant.quantize(c, s)
        return {**_spread(b.column("vec_id"), 4, 16), "c": pa.array(c.ravel()), "level": pa.array(lv.ravel()), "back": pa.array(quant.dequantize(lv, s).ravel())}

    return mapped(planes, run, LEVELS)


def residuals(planes: DataFrame, quality: float) -> DataFrame:
    """vec_id, block, k, r: what the levels come back as, to be added to the prediction."""
    s = quant.matrices(quant.quality_index(quality))["y1"]

    def run(b: pa.RecordBatch) -> dict:
        back = quant.dequantize(quant.quantize(coefficients(matrix(b.column("px"), 64)), s), s)
        return {**_spread(b.column("vec_id"), 4, 16), "r": pa.array(transform.idct(back.reshape(-1, 4, 4, 4)).ravel())}

    return mapped(planes, run, "vec_id long, block int, k int, r long")


def iwht(dc: DataFrame, key: str, kind: str = "long") -> DataFrame:
    """key, k, dc: the DC values that come back from the transform of rows (key, dc) of 16."""

    def run(b: pa.RecordBatch) -> dict:
        c = transform.iwht(transform.fwht(matrix(b.column("dc"), 16).reshape(-1, 4, 4))).reshape(-1, 16)
        at = _spread(b.column(key), 16)
        return {key: at["vec_id"], "k": at["block"], "dc": pa.array(c.ravel())}

    return mapped(dc.select(key, "dc"), run, f"{key} {kind}, k int, dc long")


def padded(planes: DataFrame) -> DataFrame:
    """vec_id, and the pixels of an h x w part of a plane made even and brought to the macroblock grid, added up with their places."""

    def run(b: pa.RecordBatch) -> dict:
        total, weighted = [], []
        for px, h, w in zip(matrix(b.column("px"), 64), b.column("h").to_pylist(), b.column("w").to_pylist(), strict=True):
            a = color.to_grid(color.even(px.reshape(8, 8)[:h, :w]), 16)
            total.append(int(a.sum()))
            weighted.append(int((a * np.arange(1, a.size + 1).reshape(a.shape)).sum()))
        return {"vec_id": b.column("vec_id"), "total": pa.array(total), "weighted": pa.array(weighted)}

    return mapped(planes.select("vec_id", "px", "h", "w"), run, "vec_id long, total long, weighted long")


def last_places(planes: DataFrame, quality: float) -> DataFrame:
    """vec_id, block, the scan place of its last level (-1: none) and whether it has one."""
    s = quant.matrices(quant.quality_index(quality))["y1"]

    def run(b: pa.RecordBatch) -> dict:
        scan = quant.quantize(coefficients(matrix(b.column("px"), 64)), s)[..., quant.ZIGZAG] != 0
        last = np.where(scan.any(-1), 15 - scan[..., ::-1].argmax(-1), -1).ravel()
        return {**_spread(b.column("vec_id"), 4), "last": pa.array(last.astype(np.int32)), "nz": pa.array((last >= 0).astype(np.int32))}

    return mapped(planes, run, "vec_id long, block int, last int, nz int")


def mode_errors(planes: DataFrame) -> DataFrame:
    """vec_id and the errors of the four whole-block modes; l, u: the planes to the left and above, or null."""

    def side(x: pa.Array, cut: slice, instead: int) -> tuple[np.ndarray, np.ndarray]:
        out = np.full((len(x), 8), instead, np.int64)
        has = np.asarray(x.is_valid())
        out[has] = matrix(x.drop_null(), 64)[:, cut]
        return out, has

    def run(b: pa.RecordBatch) -> dict:
        left, has_left = side(b.column("l"), slice(7, 64, 8), predict.LEFT_OF_FRAME)
        top, has_top = side(b.column("u"), slice(56, 64), predict.ABOVE_FRAME)
        corner = np.where(has_top, predict.LEFT_OF_FRAME, predict.ABOVE_FRAME)
        own = matrix(b.column("px"), 64).reshape(-1, 1, 8, 8)
        sse = ((own - predict.whole(top, left, corner, has_top, has_left)) ** 2).sum((-1, -2))
        return {"vec_id": b.column("vec_id"), "sse": pa.array(list(sse))}

    return mapped(planes.select("vec_id", "px", "l", "u"), run, "vec_id long, sse array<long>")


def small_mode_errors(planes: DataFrame) -> DataFrame:
    """vec_id, block and the errors of the ten 4x4 modes, each plane a picture of its own."""

    def run(b: pa.RecordBatch) -> dict:
        px = matrix(b.column("px"), 64).reshape(-1, 8, 8)
        n = len(px)
        i, y, x = np.repeat(np.arange(n), 4), np.tile([0, 0, 4, 4], n), np.tile([0, 4, 0, 4], n)
        guess = predict.fours(predict.edges(predict.bordered(px), i, y, x, y, np.full(4 * n, 8)))
        own = predict.cut(px, i, y, x, 4, 4)[:, None]
        return {**_spread(b.column("vec_id"), 4), "sse": pa.array(list(((own - guess) ** 2).sum((-1, -2))))}

    return mapped(planes, run, "vec_id long, block int, sse array<long>")


def luma(rgb: DataFrame) -> DataFrame:
    """y of rows (r, g, b)."""
    return mapped(rgb.select("r", "g", "b"), lambda b: {"y": pa.array(color.luma(np.stack([c.to_numpy() for c in b.columns], 1)))}, "y long")


def chroma(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, u and v of rows (keys, r, g, b) that hold the sums of four pixels."""

    def run(b: pa.RecordBatch) -> dict:
        x = np.stack([b.column(c).to_numpy() for c in "rgb"], 1)
        return {**{k: b.column(k) for k in keys}, "u": pa.array(color.chroma(x, color.U)), "v": pa.array(color.chroma(x, color.V))}

    kinds = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys)
    return mapped(sums.select(*keys, *"rgb"), run, f"{kinds}, u long, v long")


def scaled(df: DataFrame, column: str, f: Callable[[float], float]) -> DataFrame:
    """df's column through f."""
    return mapped(df.select(F.col(column).cast("double").alias(column)), lambda b: {column: pa.array([None if x is None else f(x) for x in b.column(column).to_pylist()], pa.float64())}, f"{column} double")

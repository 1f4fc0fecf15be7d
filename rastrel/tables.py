"""The fixture tables and the relations derived from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixel(x: Column) -> Column:
    """A component in -1..1 as a value in 0..255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 1) * 127.5))).cast("long")


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, px: an 8x8 plane in raster order for each embedding."""
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", pixel).alias("px"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, pos, px."""
    return planes(spark, sf_dir).select("vec_id", "label", F.posexplode("px").alias("pos", "px"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel, w, h: picture sizes from the part table."""
    p = load(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("img/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey"), F.lit(".png")).alias("rel"), (F.col("p_size") * 16 + F.col("p_partkey") % 5 * 3).cast("int").alias("w"), (F.col("p_partkey") % 40 * 16 + 16 + F.col("p_partkey") % 3).cast("int").alias("h"))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, rel, size: the pages as files to convert; every third stands for a PNG."""
    ext = F.when(F.col("page_id") % 3 == 0, ".png").when(F.col("page_id") % 3 == 1, ".jpg").otherwise(".PNG")
    return load(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("a/"), (F.floor(F.col("page_id") / 2) % 7).cast("string"), F.lit("/p"), F.floor(F.col("page_id") / 2).cast("string"), ext).alias("rel"), F.octet_length("html").cast("long").alias("size"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel, vec_id, h, w, content: PNG files, one for each embedding, with all colour kinds, filters and both interlaces.

    The picture is the plane's upper left part: 1 + vec_id % 8 columns, 1 + vec_id / 8 % 8 rows.
    """
    from .functions import png

    @F.pandas_udf("binary")
    def draw(ids: pd.Series, px: pd.Series) -> pd.Series:
        out = []
        for i, p in zip(ids, px, strict=True):
            a = np.asarray(p).reshape(8, 8)[: 1 + i // 8 % 8, : 1 + i % 8, None]
            kind = (0, 2, 4, 6)[i % 4]
            s = {0: a, 2: np.repeat(a, 3, 2), 4: np.concatenate([a, 255 - a], 2), 6: np.concatenate([np.repeat(a, 3, 2), 255 - a], 2)}[kind]
            depth = 16 if i % 5 == 0 else 8
            text = [("tEXt", b"Title\0picture %d" % i), ("pHYs", bytes([0, 0, 11, 19, 0, 0, 11, 19, 1]))] if i % 3 == 0 else []
            out.append(png.encode(s * 257 if depth == 16 else s, depth, kind, i % 2, [0, 1, 2, 3, 4], text))
        return pd.Series(out)

    p = planes(spark, sf_dir).where("vec_id IS NOT NULL AND size(px) = 64")
    return p.select(F.format_string("c/%d/%d.png", F.col("vec_id") % 10, "vec_id").alias("rel"), "vec_id", draw("vec_id", "px").alias("content"))


ROWS, COLUMNS = 4, 6


def tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel, pic, content: PNG files of several macroblocks, odd sizes among them, each tiled from 24 planes in a row.

    Picture p holds the planes 24 p to 24 p + 23, four rows of six, black where one is missing; the lowest p % 3 rows and the
    last p % 5 columns are cut off. Colour kinds, interlacing, texts and physical sizes go by p as they do in ``pictures``.
    """
    from .functions import png

    n = ROWS * COLUMNS

    @F.pandas_udf("binary")
    def draw(pics: pd.Series, tiles: pd.Series) -> pd.Series:
        out = []
        for p, own in zip(pics, tiles, strict=True):
            grid = np.zeros((ROWS, COLUMNS, 8, 8), np.int64)
            for t in own:
                grid[t["at"] // COLUMNS, t["at"] % COLUMNS] = np.asarray(t["px"]).reshape(8, 8)
            a = grid.transpose(0, 2, 1, 3).reshape(8 * ROWS, 8 * COLUMNS)[: 8 * ROWS - p % 3, : 8 * COLUMNS - p % 5, None]
            kind = (0, 2, 4, 6)[p % 4]
            s = {0: a, 2: np.repeat(a, 3, 2), 4: np.concatenate([a, 255 - a], 2), 6: np.concatenate([np.repeat(a, 3, 2), 255 - a], 2)}[kind]
            text = [("tEXt", b"Title\0picture %d" % p), ("pHYs", bytes([0, 0, 11, 19, 0, 0, 11, 19, 1]))] if p % 3 == 0 else []
            out.append(png.encode(s, 8, kind, p % 2, [0, 1, 2, 3, 4], text))
        return pd.Series(out)

    p = planes(spark, sf_dir).where("vec_id IS NOT NULL AND size(px) = 64")
    own = p.groupBy(F.floor(F.col("vec_id") / n).alias("pic")).agg(F.collect_list(F.struct((F.col("vec_id") % n).cast("int").alias("at"), "px")).alias("tiles"))  # 24 planes
    return own.select(F.format_string("t/%d/%d.png", F.col("pic") % 10, "pic").alias("rel"), "pic", draw("pic", "tiles").alias("content"))

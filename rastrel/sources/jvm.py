"""Pictures in formats that the JVM decodes (JPEG, GIF, BMP, PNG), as RGBA."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import extension, relative

#: Channels by the mode of Spark's picture source.
CHANNELS = {0: 1, 16: 3, 24: 4}


def images(spark: SparkSession, src: str, extensions: tuple[str, ...] = (".jpg", ".jpeg", ".jfif", ".gif", ".bmp")) -> DataFrame:
    """rel, h, w, rgba; pictures that can't be read are left out (they show as failed where files are listed)."""
    raw = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(src)
    raw = raw.select(relative(F.col("image.origin"), src).alias("rel"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.mode").alias("mode"), F.col("image.data").alias("data"))

    @F.pandas_udf("binary")
    def rgba(h: pd.Series, w: pd.Series, mode: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for hh, ww, m, d in zip(h, w, mode, data, strict=True):
            n = CHANNELS[m]
            a = np.frombuffer(d, np.uint8).reshape(hh, ww, n)
            x = np.full((hh, ww, 4), 255, np.uint8)
            x[..., :3] = a[..., 2::-1] if n >= 3 else a
            if n == 4:
                x[..., 3] = a[..., 3]
            out.append(x.tobytes())
        return pd.Series(out)

    return raw.where(extension(F.col("rel")).isin(*extensions)).select("rel", "h", "w", rgba("h", "w", "mode", "data").alias("rgba"))

"""Relations over inputs, outputs and outcomes: joins, gates, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(inputs: DataFrame, existing: DataFrame) -> DataFrame:
    """Inputs without an output."""
    return inputs.join(existing, "out_path", "left_anti")


def finished(inputs: DataFrame, existing: DataFrame) -> DataFrame:
    """Inputs with an output: those that may be deleted."""
    return inputs.join(existing, "out_path", "left_semi")


def first_writer(df: DataFrame, key: str = "out_path", order: str = "rel") -> DataFrame:
    """One row for each output, of the least rel: a sum by key, without a window."""
    cols = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.min_by(F.struct(order, *cols), F.struct(order, *cols)).alias("r")).select(key, "r.*")


def sampled(rel: Column, percent: Column | int) -> Column:
    """A fixed share of files, by a checksum of their name."""
    return F.crc32(F.encode(rel, "UTF-8")) % 100 < percent


def psnr(sse: Column, n: Column) -> Column:
    """99 for no error."""
    return F.when(sse <= 0, F.lit(99.0)).otherwise(10 * F.log10(F.lit(65025.0) * n / sse))


def note(dims_ok: Column, alpha_ok: Column, meta_ok: Column, p: Column, least: float = 34.0) -> Column:
    """The first check that fails; null if none does, or if nothing was verified."""
    return F.when(~dims_ok, "size").when(~alpha_ok, "alpha").when(~meta_ok, "metadata").when(p < least, F.format_string("PSNR %.2f", p))


def accepted(first: Column, second: Column) -> Column:
    """ok, fallback or fail from the notes of both attempts."""
    return F.when(first.isNull(), "ok").when(second.isNull() | second.startswith("PSNR"), "fallback").otherwise("fail")


def rollup(df: DataFrame, *keys: str) -> DataFrame:
    """Counters of status, src_bytes and dst_bytes, whole and by keys."""
    one = lambda s: F.count_if(F.col("status") == s)
    src, dst = F.sum("src_bytes"), F.sum("dst_bytes")
    return df.groupBy(*keys).agg(F.count("*").alias("total"), one("ok").alias("done"), one("fallback").alias("fallbacks"), one("fail").alias("failed"), one("skipped").alias("skipped"), src.alias("src_bytes"), dst.alias("dst_bytes"), F.round(dst / src, 6).alias("ratio"), F.round(100 * (1 - dst / src), 4).alias("saved_percent"))


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, value and length of each run of equal values in a row."""
    w = Window.partitionBy(*keys).orderBy(order)
    own = Window.partitionBy(*keys, value).orderBy(order)
    return df.withColumn("island", F.row_number().over(w) - F.row_number().over(own)).groupBy(*keys, value, "island").agg(F.count("*").alias("run")).drop("island")

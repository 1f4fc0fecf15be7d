"""Sharding (operator 4): weighted rendezvous hashing of stable record keys.

A row goes to the shard s with the least -ln(u) / weight[s], where u is a hash of (key, s) in (0, 1):
shards get rows in proportion to their weights, and when a shard is added or removed, or a weight is
changed, only rows that enter or leave that shard move. The key alone decides, so equal texts with
different keys may part, and rows that share a key stay together.

``slot`` numbers the rows of a shard without gaps, by (bucket, doc_id, checksum, size): buckets of about
``rows_per_bucket`` rows are numbered on their own and shifted by the sizes of the buckets before, so no
task holds a whole shard. Rows without a key (null) all go to one shard; their buckets are dealt by text.
A null text has no bytes. Equal rows get slots next to one another. Very long texts count by their bytes. An
empty table gives an empty result. Other columns are ignored, and kept as they are by ``write``. A weight must
be a positive number; a shard that takes nothing is left out of the list instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _blocks as B

SHARDS, OVERHEAD, ROWS = 40, 16, 1000


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key, from 0; ties, which 53-bit hashes hardly give, go to the smaller number."""
    if not all(0 < w < math.inf for w in weights):
        raise ValueError("weights must be positive numbers")
    bid = lambda s, w: F.struct((-F.log((F.shiftrightunsigned(F.xxhash64(key, F.lit(s), F.lit("shard")), 11).cast("double") + 0.5) / float(1 << 53)) / w).alias("bid"), F.lit(s).alias("s"))
    return F.array_min(F.array(*(bid(s, w) for s, w in enumerate(weights))))["s"]


def assign(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, weights: list[float] | None = None, grown_weight: float = 1.0, rows_per_bucket: int = ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (the shard if one more were there) of every row."""
    B.ready(spark)
    weights = weights or [1.0] * shards
    docs = B.documents(docs)
    buckets = max(1, -(-docs.count() // (len(weights) * rows_per_bucket)))
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(b""))).alias("text_crc32"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, grown_weight]).alias("grown_shard"),
    )
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id", "text_crc32"))
    rows = B.table(spark, rows.withColumn("bucket", F.pmod(salt, F.lit(buckets)).cast("int")), "shards")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    numbered = rows.withColumn("n", F.row_number().over(inner)).join(base, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("n") - 1).cast("long").alias("slot"), "grown_shard")


def write(docs: DataFrame, path: str, key: str = "doc_id", weights: list[float] | None = None, name: str = "shard") -> None:
    """All columns of docs, in one folder for each shard; the folders' column is ``name``, which docs may not have."""
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs have a column {name} of their own")
    docs.withColumn(name, rendezvous(F.col(key).cast("long"), weights or [1.0] * SHARDS)).write.partitionBy(name).parquet(path)

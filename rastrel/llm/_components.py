"""Connected components of a distributed list of edges, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks as B


def look_up(rows: DataFrame, values: DataFrame, key: str, total: int, share: int = 1000) -> DataFrame:
    """rows joined with values, which has one row a key (0 or more) and, as n, how many of the (at most total) rows have it.

    A key with more than a share of all rows is looked up in a broadcast table, which therefore has fewer
    than ``share`` rows; all others meet by the key, of which no task gets more than that share.
    """
    names = [c for c in values.columns if c not in (key, "n")]
    hot, cold = (values.where(f"n * {share} {how} {total}").select(F.col(key).alias(f"{k}_"), F.struct(*names).alias(k)) for how, k in ((">", "hot"), ("<=", "cold")))
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_"), "left")
    # rows that are done are spread by their own hash, below all keys
    rest = F.when(F.col("hot").isNull(), F.col(key)).otherwise(-1 - F.shiftrightunsigned(F.xxhash64(*rows.columns), 1))
    rows = rows.join(cold, rest == F.col("cold_"), "left").withColumn("value_", F.coalesce("hot", "cold")).where("value_ IS NOT NULL")
    return rows.select(*(c for c in rows.columns if c not in ("hot", "hot_", "cold", "cold_", "value_")), "value_.*")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node on an edge (a, b); the label is the component's smallest node.

    Each round is a few joins and sums by node; it is written to the shared folder, so lineage stays
    short. Nodes with many edges are looked up by ``look_up``. Nothing is collected but two numbers a round.
    """
    spark = edges.sparkSession
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = B.table(spark, e, "stars")
    n, mark = e.count(), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")
        large = look_up(both.where("v > u"), least, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = look_up(large, least, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = B.table(spark, small.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        n, *now = e.agg(F.count("*"), F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def local(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of the component of each of n nodes."""
    lab = np.arange(n)
    while len(a):
        m = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], m)
        np.minimum.at(new, lab[b], m)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab

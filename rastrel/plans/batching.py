"""Planning: sizes, batches, padding buckets and groups bounded in bytes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import png
from ..shared import table

BATCH, TAIL, GAIN, MOST_BUCKETS = 64, 24, 0.15, 3
MAX_H, MAX_W = 1536, 1920
ROOM, SLACK = 1 << 30, 65536


def size_histogram(df: DataFrame) -> DataFrame:
    """mb_h, mb_w, n: pictures for each size on the macroblock grid."""
    cells = lambda c: F.floor((F.col(c) + 15) / 16).cast("int")
    return df.groupBy(cells("h").alias("mb_h"), cells("w").alias("mb_w")).agg(F.count("*").alias("n"))


def batches(df: DataFrame, keys: list[str], order: str = "rel", cap: int = BATCH, part: int = 4096) -> DataFrame:
    """Adds batch_id: pictures of one size in batches of at most cap, in order.

    A size may hold most of the pictures. Ranks are therefore taken in slices of about ``part`` rows: the
    rows are cut into ranges of the order, each range is numbered by itself, and its numbers are shifted by
    the count of the ranges before. Range bounds are sampled, so the numbered slices are written once, to the
    shared folder, and everything else is read from there. Give slim rows: all columns are written.
    """
    spark = df.sparkSession
    spread = df.repartitionByRange(max(1, -(-df.count() // part)), *keys, order).withColumn("slice_", F.spark_partition_id())
    spread = table(spark, spread.withColumn("in_", F.row_number().over(Window.partitionBy("slice_", *keys).orderBy(order))), "slices")
    counts = spread.groupBy("slice_", *keys).agg(F.count("*").alias("n_"))
    before = counts.withColumn("before_", F.coalesce(F.sum("n_").over(Window.partitionBy(*keys).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ["slice_", *keys]]
    out = spread.alias("s").join(before.alias("b"), reduce(Column.__and__, same))
    return out.select("s.*", F.floor((F.col("before_") + F.col("in_") - 1) / cap).cast("long").alias("batch_id")).drop("slice_", "in_")


def plan_buckets(histogram: list[tuple[int, int, int]], cap: int = BATCH, max_h: int = MAX_H, max_w: int = MAX_W) -> dict[tuple[int, int], tuple[int, int]]:
    """For rare sizes (h, w, count) the padded size they are batched at.

    Sizes in the tail (few pictures, multiples of 16, not too large, not the commonest size) are taken by
    orientation; a set of sizes costs its count times its greatest height and width. The costliest set is
    split in two along height or width where that saves most, while it saves a share of the whole cost.
    """
    if not histogram:
        return {}
    common = max(histogram, key=lambda x: (x[2], x[0], x[1]))
    tail = [x for x in histogram if x is not common and x[2] < max(TAIL, 3 * cap // 4) and x[0] % 16 == 0 and x[1] % 16 == 0 and x[0] <= max_h and x[1] <= max_w]
    cost = lambda s: sum(x[2] for x in s) * max(x[0] for x in s) * max(x[1] for x in s)
    out = {}
    for group in ([x for x in tail if x[0] > x[1]], [x for x in tail if x[0] <= x[1]]):
        sets = [group] if group else []
        while 0 < len(sets) < MOST_BUCKETS:
            now = sum(map(cost, sets))
            options = []
            for i, s in enumerate(sets):
                for axis in (0, 1):
                    for edge in sorted({x[axis] for x in s})[:-1]:
                        low, high = [x for x in s if x[axis] <= edge], [x for x in s if x[axis] > edge]
                        options.append((cost(low) + cost(high) - cost(s), i, axis, edge))
            best = min(options, default=(0,))
            if -best[0] < GAIN * now:
                break
            _, i, axis, edge = best
            s = sets.pop(i)
            sets += [[x for x in s if x[axis] <= edge], [x for x in s if x[axis] > edge]]
        for s in sets:
            out |= {(x[0], x[1]): (max(y[0] for y in s), max(y[1] for y in s)) for x in s}
    return out


def bucketed(df: DataFrame, cap: int = BATCH) -> DataFrame:
    """Adds bucket_h and bucket_w, null where a picture keeps its own size.

    The plan is made on the driver from the counts of the sizes that may be padded (multiples of 16 up to
    MAX_H x MAX_W: at most 11,520) and of the commonest size; the map that is joined back is no larger.
    """
    spark = df.sparkSession
    counts = df.where("h IS NOT NULL AND w IS NOT NULL").groupBy("h", "w").agg(F.count("*").alias("n"))
    common = counts.orderBy(F.col("n").desc(), F.col("h").desc(), F.col("w").desc()).limit(1)
    may = counts.where((F.col("h") % 16 == 0) & (F.col("w") % 16 == 0) & (F.col("h") <= MAX_H) & (F.col("w") <= MAX_W))
    plan = plan_buckets([(r.h, r.w, r.n) for r in may.union(common).distinct().collect()], cap)
    table = spark.createDataFrame([(*k, *v) for k, v in plan.items()], "h int, w int, bucket_h int, bucket_w int")
    return df.join(F.broadcast(table), ["h", "w"], "left")


def raw_size(w: Column, h: Column, depth: Column, color: Column, interlace: Column) -> Column:
    """Bytes of a PNG's filtered rows, over the passes that aren't empty."""
    n = F.element_at(F.create_map(*(F.lit(x) for kv in png.CHANNELS.items() for x in kv)), color)
    part = lambda size, first, step: F.greatest(F.lit(0), F.floor((size - first + step - 1) / step))

    def one(r: int, c: int, dr: int, dc: int) -> Column:
        rows, cols = part(h, r, dr), part(w, c, dc)
        return F.when((rows > 0) & (cols > 0), rows * (1 + F.floor((cols * n * depth + 7) / 8))).otherwise(0)

    seven = sum((one(*p) for p in png.PASSES), F.lit(0))
    return F.when(interlace == 1, seven).otherwise(one(0, 0, 1, 1)).cast("long")


def _ends(sizes: np.ndarray, room: int) -> np.ndarray:
    """What a greedy scan does in a slice, by the row (up to the first that can be it) where its first new group starts.

    Three rows: the bytes before it, the groups begun from there on, the bytes held at the slice's end. Before them
    all stands a column for a scan that arrives with nothing: its first new group's place, the bytes of the slice.
    """
    n = len(sizes)
    total = np.concatenate([[0.0], np.cumsum(sizes)])
    known = (~np.isnan(total)).sum() - 1  # from the first row of unknown size on no group begins
    over = np.searchsorted(total, total + room, "right")  # the first row that doesn't fit is the one before
    full = np.searchsorted(total, total, "right")  # a group takes rows of no bytes and one more, whatever its size
    after = np.maximum(over - 1, full)
    after[after >= known] = n
    begun, last = np.zeros(n + 1), np.full(n + 1, n)
    for j in range(n - 1, -1, -1):
        k = after[j]
        begun[j], last[j] = begun[k] + 1, last[k] if k < n else j
    e = after[0] + 2
    return np.concatenate([[[after[0]], [total[-1]], [n]], np.stack([total[:e], begun[:e], (total[-1] - total[last])[:e]])], 1)


def _through(ends: np.ndarray, room: int, held: float) -> tuple[int, float]:
    """The groups begun in a slice by a scan that arrives with held bytes, and the bytes it leaves with."""
    (first, whole, n), (total, begun, left) = ends[:, 0], ends[:, 1:]
    if held:
        first = max(np.searchsorted(total, room - held, "right") - 1, 0)
        if first >= (~np.isnan(total)).sum() - 1:
            first = n
    return (0, held + whole) if first >= n else (int(begun[int(first)]), left[int(first)])


def byte_groups(df: DataFrame, keys: list[str], order: str, size: str, room: int = ROOM, slack: int = SLACK, run: int = 1 << 14) -> DataFrame:
    """Adds group_id: rows of a key in order (no two alike), a new group whenever the next row would not fit into room.

    The cut is greedy, so it is a scan. Slices of ``run`` rows of a key tell where a scan would leave them, by
    where its first new group starts; put together in order, that gives the state each slice is scanned from.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    of = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    sizes = lambda pdf: pdf.sort_values(order)[size].to_numpy(float, na_value=np.nan) + slack

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[[*keys, "batch_id"]].head(1).assign(ends=[_ends(sizes(pdf), room).tobytes()])

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("batch_id")
        group, held, out = 0, 0.0, []
        for raw in pdf["ends"]:
            out.append((held, group))
            begun, held = _through(np.frombuffer(raw).reshape(3, -1), room, held)
            group += begun
        return pdf[[*keys, "batch_id"]].assign(held=[x[0] for x in out], group=[x[1] for x in out])

    def cut(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        group, held, out = int(state["group"].iloc[0]), float(state["held"].iloc[0]), []
        for s in sizes(pdf):
            if held and held + s > room:
                group, held = group + 1, 0
            held += s
            out.append(group)
        return pdf.drop(columns="batch_id").assign(group_id=out)

    ranked = batches(df, keys, order, run)
    at = [*keys, "batch_id"]
    ends = ranked.select(*dict.fromkeys([*at, order, size])).groupBy(*at).applyInPandas(tell, f"{of}, batch_id long, ends binary")
    states = ends.groupBy(*keys).applyInPandas(enter, f"{of}, batch_id long, held double, `group` long")
    return ranked.groupBy(*at).cogroup(states.groupBy(*at)).applyInPandas(cut, f"{kinds}, group_id long")

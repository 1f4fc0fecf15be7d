"""Incremental conversion and progress as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import convert
from ..sources.files import extension, relative

FILES = "path string, modificationTime timestamp, length long, content binary"


def incoming(spark: SparkSession, src: str, per_trigger: int = 1000) -> DataFrame:
    """rel and content of files as they arrive; what is in flight is bounded by per_trigger."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(src)
    return files.where(extension(F.col("path")) == ".png").select(relative(F.col("path"), src).alias("rel"), "content", "modificationTime")


def convert_stream(spark: SparkSession, src: str, outcomes: str, checkpoint: str, **options):
    """Converts new files; each trigger's outcomes go to its own folder, so a repeated trigger overwrites itself.

    The checkpoint remembers files that were taken; outputs of earlier runs are left out by an anti-join.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(outcomes)
        begun = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        before = spark.read.schema(f"{convert.OUTCOME}, epoch long").parquet(outcomes).where(f"bytes IS NOT NULL AND epoch <> {epoch}").select("out_path") if begun else None
        convert.convert(df.select("rel", "content"), before, **options).write.mode("overwrite").parquet(f"{outcomes}/epoch={epoch}")

    return incoming(spark, src).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and values of outcomes in tumbling windows of event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def grouped(df: DataFrame, cap: int = 64, eager: int = 24, wait_ms: int = 2500) -> DataFrame:
    """Batches of files of one size, as they fill up: (mb_h, mb_w, rels).

    df: rel, mb_h, mb_w. A group is given out at cap, at the end of a trigger if it holds eager or more,
    or when nothing came for wait_ms.
    """

    def flush(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        if not state.hasTimedOut:
            for pdf in batches:
                held += pdf["rel"].tolist()
        out = [held[i : i + cap] for i in range(0, len(held) // cap * cap, cap)]
        held = held[len(held) // cap * cap :]
        if held and (state.hasTimedOut or len(held) >= eager):
            out.append(held)
            held = []
        if held:
            state.update((held,))
            state.setTimeoutDuration(wait_ms)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({"mb_h": [key[0]] * len(out), "mb_w": [key[1]] * len(out), "rels": out})

    return df.groupBy("mb_h", "mb_w").applyInPandasWithState(flush, "mb_h int, mb_w int, rels array<string>", "held array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)

"""Tables in the folder that the driver and all executors see.

They cut a lineage and survive lost executors. The folder is spark.checkpoint.dir. Only where that is unset and
driver and executors are one process does a temporary folder take its place, which ends with the process.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[str] = []


@lru_cache(1)
def _own() -> str:
    path = tempfile.mkdtemp(prefix="rastrel-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path nothing has used, in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        base = _own()
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is run in here leaves no shuffle files: its result is written, and nothing reads them again."""
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if old is None else spark.conf.set(CLEANUP, old)


def table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back."""
    path = new_path(spark, name)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(spark: SparkSession, df: DataFrame, name: str, key: str, n: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Like ``table``, with the rows of a key together in one of n buckets: joins by the key don't move them again.

    Yields the table, which the catalog knows only in here, and the same files as plain Parquet, for later.
    """
    path, made = new_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(made)
    try:
        yield spark.table(made), spark.read.schema(df.schema).parquet(path)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {made}")


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made[:] = [x for x in _made if x != path]


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, at its end, the tables made in here but for the paths that are put into the list."""
    before, keep = set(_made), []
    try:
        yield keep
    finally:
        for path in [p for p in _made if p not in before and p not in keep]:
            remove(spark, path)

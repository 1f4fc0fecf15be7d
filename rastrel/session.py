"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(app: str = "rastrel", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **conf}.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Settings that can change at run time, for a session made elsewhere."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)

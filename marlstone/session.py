"""A session with the settings that the engine's results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "marlstone", **more: str) -> SparkSession:
    """The running session, or a new one; either with SETTINGS. `more`: further settings, dots as `__`."""
    spark = SparkSession.builder.appName(app).getOrCreate()
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        spark.conf.set(key, value)
    return spark


def ready(spark: SparkSession, references=None) -> bool:
    """Warm-up: true once a job ran and, if given, the reference table could be counted."""
    return spark.range(1).count() == 1 and (references is None or references.count() >= 0)

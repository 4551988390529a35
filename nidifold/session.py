"""A session with the settings that the engine's plans count on. Any other session works too."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Partitions are merged, joins with hot keys split, and small sides broadcast by what is measured at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "nidifold", **more: str) -> SparkSession:
    """``more``: further settings, with ``__`` for the dots in their names."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

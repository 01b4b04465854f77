"""Spark session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "factloom", **conf: str) -> SparkSession:
    """A session with the settings the library counts on: UTC, adaptive execution, skew joins.

    Sizes of clusters and shuffles are left to the caller; ``conf`` adds or replaces settings, dots
    written as double underscores.
    """
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

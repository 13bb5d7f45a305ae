"""Session settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "marlgrid", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; everything else is the cluster's to set."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()

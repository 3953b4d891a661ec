"""A session with the settings that the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lexiprobe", master: str | None = None, **settings: str) -> SparkSession:
    """Adaptive execution on, UTC, Arrow on; anything else is left to the cluster."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

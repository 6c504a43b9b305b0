"""A session with the settings that the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "sparkweave", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution deals with skew and small partitions; UTC keeps timestamps comparable."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()

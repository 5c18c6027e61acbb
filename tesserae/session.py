"""A Spark session set up for the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tesserae", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; shuffle partitions are left to the cluster unless given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()

"""A session with the settings that the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "heddle", **more: str) -> SparkSession:
    """The running session, or a new one: UTC, adaptive plans with skew handling, Arrow."""
    build = SparkSession.builder.appName(name)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **more,
    }.items():
        build = build.config(key, value)
    return build.getOrCreate()

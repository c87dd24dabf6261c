"""A session with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "threadmill", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, UTC, Arrow on; ``conf`` wins over these."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

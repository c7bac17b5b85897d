"""The session the engine expects: UTC, adaptive execution, and nothing that a cluster's own settings should decide."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessera", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for key, value in (fixed | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

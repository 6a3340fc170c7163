"""Session with the settings the engine's semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC timestamps, adaptive plans, and JSON objects in which the last duplicate key wins."""
    b = SparkSession.builder.appName("sparkledger")
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.variant.allowDuplicateKeys": "true"}
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()

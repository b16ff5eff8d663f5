"""Session settings: adaptive plans, UTC, and shuffle sizes that follow the input."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "recollect", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.filterPushdown": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

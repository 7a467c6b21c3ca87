"""Session settings that the library relies on; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Partition values stay strings (a label 2024 isn't a number); ids differing in case are different columns.
SETTINGS = {
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(app: str = "vecscore", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

"""Spark session settings that the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "gazette", master: str | None = None) -> SparkSession:
    """A session in UTC with ANSI SQL and adaptive execution; existing settings of a cluster win."""
    builder = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_REMOTE"):
        builder = builder.master(master or os.environ.get("SPARK_MASTER", "local[*]"))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )

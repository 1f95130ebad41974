"""Loading of the named Parquet tables below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as Spark's reader gives it; the folder may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

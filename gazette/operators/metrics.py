"""Counters of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fallback_rate(df: DataFrame, failed: Column, keys: list[str] | None = None) -> DataFrame:
    """total, failed, pct (whole per cent, 0 if there are none) and headline: ok, degraded from a tenth on, or all_failed."""
    one = df.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failed"))
    pct = F.coalesce(F.floor(F.try_divide(F.col("failed") * 100, F.col("total"))), F.lit(0)).cast("long")
    headline = F.when((F.col("total") > 0) & (F.col("failed") == F.col("total")), "all_failed").when(F.col("pct") >= 10, "degraded").otherwise("ok")
    return one.withColumn("pct", pct).withColumn("headline", headline)


def group_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of each row value by the given column values."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def drop_counts(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """How many rows each filter would drop, in one pass before they are applied."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in reasons.items()])


def observed(df: DataFrame, name: str, reasons: dict[str, Column]):
    """df and its Observation: rows and counts of reasons, gathered while df is written, without a pass of their own."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in reasons.items()]), seen


def first_errors(df: DataFrame, error: str, order: str, n: int = 5) -> DataFrame:
    """The first few error texts, cut to 150 characters."""
    return df.where(F.col(error).isNotNull()).orderBy(order).limit(n).select(F.substring(error, 1, 150).alias("error"))


def key_report(owners: DataFrame) -> DataFrame:
    """line: each different key with its sorted owners, keys padded to the longest; owners: category, key."""
    keys = owners.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("owners"))
    width = keys.agg(F.max(F.length("key"))).scalar()
    return keys.select("key", F.concat(F.rpad("key", width, F.lit(" ")), F.lit("  "), "owners").alias("line"))

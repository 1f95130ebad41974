"""Rankings: round-robin over sources, best of each group, best over all."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.staging import stage


def _joined(df: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """df with the facts of its keys; a null is a key like any other."""
    facts = facts.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return df.join(facts, same).drop(*[f"_of_{k}" for k in keys])


def round_robin(df: DataFrame, keys: list[str], source: str, published: str, seq: str, cap: int = 20) -> DataFrame:
    """The newest of each source, sources by their newest item, then the second newest of each, up to cap rows within keys.

    No source can give more than cap rows: Spark keeps that many of each partition before it shuffles.
    """
    newest = Window.partitionBy(*keys, source).orderBy(F.col(published).desc(), F.col(seq))
    ranked = df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= cap)
    # A source's newest row and smallest seq come from an aggregate, as a window would need all its rows in one task.
    facts = df.groupBy(*keys, source).agg(F.max(published).alias("_newest"), F.min(seq).alias("_first"))
    ranked = _joined(ranked, facts, [*keys, source])
    turn = Window.partitionBy(*keys).orderBy("_rank", F.col("_newest").desc(), "_first")
    return ranked.withColumn("position", F.row_number().over(turn)).where(F.col("position") <= cap).drop("_rank", "_newest", "_first")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Every row's place in the order within keys, from 1, for groups of any size: ranges of (keys, order) are numbered each for
    itself, and begin where the counts of those before them end. The order must be total."""
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id())
    ranged = stage(ranged, "numbered-ranges")
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"))  # a row for each range and key
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    return _joined(own, starts, [*keys, "_range"]).withColumn(name, F.col("_start") + F.col("_own")).drop("_start", "_own", "_range")


def top_of_each(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark keeps n of each partition before it shuffles."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def top_overall(df: DataFrame, keys: list[str], order: list[Column], each: int, n: int) -> DataFrame:
    """The first n over all of the first few of each group, numbered."""
    best = top_of_each(df, keys, order, each, "_each").drop("_each").orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # over n rows


def chunks(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """chunk (from 0) and id within it (from 1) of rows in order (total) within keys."""
    return numbered(df, keys, [F.col(c) for c in order], "_place").withColumn("_n", F.col("_place") - 1).drop("_place").withColumns({"chunk": F.floor(F.col("_n") / size).cast("long"), "id": (F.col("_n") % size + 1).cast("long")}).drop("_n")

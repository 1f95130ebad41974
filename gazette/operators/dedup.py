"""Deduplication of articles: exact by normalised title, near by title words, and by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.text import normalize_title, tokens
from gazette.operators.similar import first_kept, set_classes, similar_pairs
from gazette.staging import stage

NEAR = 0.5


def exact_longest(df: DataFrame, keys: list[str], title: str = "title", summary: str = "summary", seq: str = "seq") -> DataFrame:
    """One row for each normalised title within keys: the longest summary's, the first of equal ones, at the place (pos) of the first.

    Blank titles are equal to each other.
    """
    own = df.withColumn("_key", normalize_title(F.coalesce(F.col(title), F.lit(""))))
    best = F.max_by(F.struct(*df.columns), F.struct(F.length(F.coalesce(F.col(summary), F.lit(""))), -F.col(seq)))
    # An aggregate, not a window: each task keeps one row of a title before anything is shuffled.
    return own.groupBy(*keys, "_key").agg(best.alias("row"), F.min(seq).alias("pos")).select("row.*", "pos")


def _digest(words: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.size(words).cast("string"), words), 256)


def near_greedy(df: DataFrame, group: list[str], title: str = "title", summary: str = "summary", pos: str = "pos", threshold: float = NEAR, words: Column | None = None, length: Column | None = None) -> DataFrame:
    """In the order of pos (unique), each row joins the first kept row of its group with a Jaccard similarity of threshold or more, or is kept.

    A longer summary takes a kept row's place, but not its words and position (kept_pos). Rows with equal words follow the
    first of them, so only different word sets are paired; no group is ever collected. Rows without words, or with a null in group, are kept.
    """
    words = tokens(F.col(title)) if words is None else words
    length = F.length(F.coalesce(F.col(summary), F.lit(""))) if length is None else length
    words = F.array_sort(words)
    own = stage(df.withColumns({"_words": words, "_key": _digest(words), "_length": length}), "greedy-rows")
    classes = stage(set_classes(own, group, pos, "_words"), "greedy-sets")
    moved = first_kept(similar_pairs(classes, group, threshold), group)
    # Only digests of the words and positions are shuffled from here on, whole rows when the last of each group is known.
    openers = classes.select(*group, "rep", _digest(F.col("words")).alias("_key")).join(moved.withColumnRenamed("b", "rep"), [*group, "rep"], "left").select(*group, "_key", F.coalesce("a", "rep").alias("_opener"))
    placed = own.select(*group, pos, "_key", "_length").join(openers, [*group, "_key"], "left").withColumn("kept_pos", F.coalesce("_opener", F.col(pos)))
    last = placed.groupBy(*group, "kept_pos").agg(F.max_by(pos, F.struct("_length", -F.col(pos))).alias("_last"))
    last = last.select(*[F.col(c).alias(f"_of_{c}") for c in group], "kept_pos", "_last")
    same = F.col(pos) == F.col("_last")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return own.join(last, same).select(*group, *[c for c in df.columns if c not in group], "kept_pos")


def month_first(df: DataFrame, keys: list[str], order: list[str], title: str = "title") -> DataFrame:
    """The first row of each normalised title within keys (month and category)."""
    own = df.withColumn("_key", normalize_title(F.coalesce(F.col(title), F.lit(""))))
    return own.groupBy(*keys, "_key").agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row")).select("row.*")

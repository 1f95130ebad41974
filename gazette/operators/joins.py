"""The joins of a daily run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unseen(today: DataFrame, history: DataFrame, key: str, days: int, today_date: Column, date: str = "date") -> DataFrame:
    """Rows of today whose key was not in history on one of the days before; a blank key never matches.

    history is pruned to the days, and joined as its size then tells: broadcast if small, else by a shuffle of keys.
    """
    recent = history.where((F.col(date) < today_date) & (F.col(date) >= F.date_sub(today_date, days))).where(F.length(key) > 0).select(key).distinct()
    return today.join(recent, key, "left_anti")


def with_answers(df: DataFrame, answers: DataFrame, id: str = "id", pos: str = "pos") -> DataFrame:
    """df with the last answer to each id; rows without one have nulls."""
    rest = [c for c in answers.columns if c not in (id, pos)]
    last = answers.groupBy(id).agg(F.max_by(F.struct(*rest), pos).alias("_last")).select(id, "_last.*")
    return df.join(last, id, "left")


def looked_up(picks: DataFrame, candidates: DataFrame, n: int, id: str = "id", rank: str = "rank", pos: str = "pos") -> DataFrame:
    """Candidates in the order of the picks' ranks, the first n; ids that name none are left out, repeated ones count once."""
    first = picks.groupBy(id).agg(F.min_by(F.struct(*[c for c in picks.columns if c != id]), pos).alias("_first")).select(id, "_first.*")
    return first.join(candidates, id).orderBy(F.col(rank).asc_nulls_last(), pos).limit(n)


def insert_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and those rows of new whose key it lacks; existing rows are never changed."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def reroute(owners: DataFrame, usable: DataFrame, category: str = "category", key: str = "key") -> DataFrame:
    """Each category's own key if it is usable, else the first usable one in order of category_seq."""
    good = owners.join(usable, key, "left_semi")
    spare = good.agg(F.min_by(key, "category_seq")).scalar()
    own = good.select(category, F.col(key).alias("own"))
    return owners.join(own, category, "left").select(category, F.coalesce("own", spare).alias(key))

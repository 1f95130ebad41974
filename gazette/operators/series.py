"""Price and index series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.functions.numeric import direction, pct_change, signed_pct, sparkline

# Rows that each horizon looks back, rows a candidate needs, picks of each horizon, days of a history.
OFFSETS = {"daily": 1, "weekly": 5, "monthly": 20}
LEAST, PICKS, DAYS = 6, 2, 7


def candidates(prices: DataFrame, keys: list[str], date: str = "date", close: str = "close", volume: str = "volume") -> DataFrame:
    """keys, price, a change in per cent for each horizon (at the oldest row if there are not so many), volume_ratio.

    Only the newest 21 rows of a series are brought together, whatever its length, and its oldest within them.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    recent = prices.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= max(OFFSETS.values()) + 1)
    one = recent.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_n", F.col(close).alias("c"), F.col(volume).alias("v")))).alias("h")).where(F.size("h") >= LEAST)
    changes = {f"{name}_change_pct": pct_change(F.col("h")[0]["c"], F.element_at("h", F.least(F.lit(off), F.size("h") - 1) + 1)["c"]) for name, off in OFFSETS.items()}
    before = F.slice(F.col("h.v"), 2, 5)
    mean = F.aggregate(before, F.lit(0.0), lambda a, x: a + x) / F.size(before)
    return one.select(*keys, F.col("h")[0]["c"].alias("price"), *[c.alias(k) for k, c in changes.items()], F.when(mean != 0, F.col("h")[0]["v"] / mean).alias("volume_ratio"))


def picks(entries: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """horizon, rank and entry of the best PICKS changes of each market (keys) and horizon; ties in order of seq."""
    long = entries.select("*", F.expr("stack(3, " + ", ".join(f"'{h}', {h}_change_pct" for h in OFFSETS) + ") AS (horizon, change_pct)")).where("change_pct is not null")
    best = Window.partitionBy(*keys, "horizon").orderBy(F.col("change_pct").desc(), F.col(seq))
    return long.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= PICKS)


def day_over_day(values: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Each row with pct, its change on the row before in per cent: 0 after a zero, null for the first."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(date))
    return values.withColumn("pct", F.when(before == 0, 0.0).otherwise((F.col(value) - before) / before * 100))


def latest_history(values: DataFrame, keys: list[str], date: str, value: str, days: int = DAYS) -> DataFrame:
    """keys, history (the latest values, oldest first) of series with two values or more."""
    last = values.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(date).desc()))).where(F.col("_n") <= days)
    one = last.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(date, value))).alias("_h")).where(F.size("_h") >= 2)
    return one.select(*keys, F.col(f"_h.{value}").alias("history"))


def indicators(values: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """keys, value and pct as shown, dir, sparkline_svg."""
    h = latest_history(values, keys, date, value)
    last, before = F.element_at("history", -1), F.element_at("history", -2)
    h = h.withColumns({"_pct": F.when(before == 0, 0.0).otherwise((last - before) / before * 100), "_last": last})
    return h.select(*keys, F.format_number("_last", 2).alias("value"), signed_pct(F.col("_pct")).alias("pct"), direction(F.col("_pct")).alias("dir"), sparkline(F.col("history"), direction(F.col("_pct"))).alias("sparkline_svg"))

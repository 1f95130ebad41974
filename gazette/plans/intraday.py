"""The intraday refresh of indicators: indices and exchange rates, each group for itself, the last good ones kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.operators import series
from gazette.sinks.files import write_if_any
from gazette.sinks.render import indicators_json


def market_indicators(histories: dict[str, DataFrame]) -> DataFrame:
    """group, seq, key, name and the shown fields; histories: group -> table of seq, key, name, date, value. A group without rows is left out."""
    out = None
    for group, h in histories.items():
        one = series.indicators(h.na.drop(subset=["value"]), ["seq", "key", "name"], "date", "value").withColumn("group", F.lit(group))
        one = one.select("group", "seq", "key", "name", "value", "pct", "dir", "sparkline_svg")
        out = one if out is None else out.unionByName(one)
    return out


def refresh(histories: dict[str, DataFrame], as_of: Column, folder: str) -> bool:
    """Writes indicators.json; False, and the old file stays, if there is nothing to write."""
    return write_if_any(indicators_json(market_indicators(histories), as_of), folder)

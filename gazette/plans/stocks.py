"""Stock picks from a watch-list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.operators import series
from gazette.plans.model import with_reasons
from gazette.sources.market import within_budget


def market_picks(prices: DataFrame, watched: DataFrame, began=None, budget: float = 90.0) -> DataFrame:
    """market, horizon, rank, symbol, name, price, change_pct, volume_ratio, reason.

    prices: symbol, date, close, volume; watched: market, seq, symbol, name (a few dozen rows). began: column of prices that
    tells when a symbol's download began; what began after the budget is left out, what was had before is kept.
    """
    own = prices if began is None else within_budget(prices, F.col(began), budget)
    listed = own.join(F.broadcast(watched), "symbol")
    entries = series.candidates(listed.na.drop(subset=["close", "volume"]), ["market", "seq", "symbol", "name"])
    best = series.picks(entries, ["market"], "seq")
    return with_reasons(best).select("market", "horizon", "rank", "symbol", "name", "price", "change_pct", "volume_ratio", "reason")

"""Price histories, indices and exchange rates: scans of their services' pages, and the tables in them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.numeric import comma_number
from gazette.sources import fetch as fetching

#: Pages of a series at most, newest first; seconds for one page, and what a live run gives the scan of all series (no scan has it by default).
PAGES, TIMEOUT, BUDGET = 3, 10.0, 90.0
Fetch = Callable[[str], bytes]
_ROW = r"(?s)<tr[^>]*>.*?</tr>"
_CELL = r"(?s)<td[^>]*>\s*(?:<[^>]+>\s*)*([^<]*?)\s*(?:<[^>]+>\s*)*</td>"


def _get(url: str) -> bytes:
    return fetching.fetch(url, TIMEOUT)


def scan(series: DataFrame, url: str, pages: int = PAGES, fetch: Fetch = _get, encoding: str = "utf-8", budget: float | None = None, at_once: int | None = 1) -> DataFrame:
    """symbol, page, html, error of the pages of each series (column symbol), page by page until one has no row of cells; url holds {symbol} and {page}.

    A series of which a page fails has no pages but a row that says why, and the others theirs. Without a budget (seconds) all series are
    scanned, however long that takes; with one, those that would begin after it have a row that says so. Each of the at_once
    tasks has a clock of its own; at_once None: as many tasks as series has partitions, for files of one's own.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        began = time.monotonic()
        for f in frames:
            rows = []
            for symbol in f["symbol"]:
                if budget is not None and time.monotonic() - began > budget:
                    rows.append((symbol, None, None, "the budget was used up"))
                    continue
                own = []
                try:
                    for page in range(1, pages + 1):
                        html = fetch(url.format(symbol=symbol, page=page)).decode(encoding, errors="replace")
                        if not re.search(r"<td[^>]*>[^<]*[0-9]", html):
                            break
                        own.append((symbol, page, html, None))
                except Exception as why:  # whatever goes wrong with a series is told, and the others go on
                    own = [(symbol, None, None, f"{type(why).__name__}: {why}")]
                rows += own
            yield pd.DataFrame(rows, columns=["symbol", "page", "html", "error"]).astype({"page": "Int32"})

    own = series.select("symbol")
    return (own if at_once is None else own.repartition(at_once)).mapInPandas(run, "symbol string, page int, html string, error string")


def _cells(pages: DataFrame, html: str) -> DataFrame:
    rows = pages.select("symbol", F.explode(F.regexp_extract_all(html, F.lit(_ROW), F.lit(0))).alias("tr"))
    cells = rows.select("symbol", F.regexp_extract_all("tr", F.lit(_CELL), F.lit(1)).alias("c"))
    return cells.withColumn("date", F.expr("try_to_date(replace(trim(get(c, 0)), '.', '-'), 'yyyy-MM-dd')"))


def price_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """symbol, date, close, volume from tables of daily prices: columns symbol, page and html of each page; rows without numbers are left out."""
    cells = _cells(pages, html)
    out = cells.select("symbol", "date", comma_number(F.expr("get(c, 1)")).alias("close"), comma_number(F.expr("get(c, size(c) - 1)")).alias("volume"))
    return out.na.drop().dropDuplicates(["symbol", "date"])


def index_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """symbol, date, value from tables of an index's last days."""
    return _cells(pages, html).select("symbol", "date", comma_number(F.expr("get(c, 1)")).alias("value")).na.drop().dropDuplicates(["symbol", "date"])


def rates(answers: DataFrame, json: str = "json") -> DataFrame:
    """currency, seq, rate (newest first) from JSON answers with a result list of closePrice texts; a broken answer gives no rows."""
    parsed = F.from_json(json, "result array<struct<localTradedAt:string,closePrice:string>>")
    one = answers.select("currency", F.posexplode(parsed["result"]).alias("seq", "r"))
    return one.select("currency", F.col("seq").cast("long"), F.col("r.localTradedAt").alias("date"), comma_number(F.col("r.closePrice")).alias("rate")).where("rate is not null")


def chart_rows(answers: DataFrame, json: str = "json") -> DataFrame:
    """symbol, date, close, volume from JSON answers on many symbols at once, arrays by field as chart services send them; a broken or half answer gives no rows."""
    shape = "chart struct<result:array<struct<meta:struct<symbol:string>,timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>,volume:array<double>>>>>>>"
    one = answers.select(F.explode(F.from_json(json, shape)["chart"]["result"]).alias("r"))
    quote = F.col("r.indicators.quote")[0]
    each = one.select(F.col("r.meta.symbol").alias("symbol"), F.explode(F.arrays_zip(F.col("r.timestamp").alias("t"), quote["close"].alias("close"), quote["volume"].alias("volume"))).alias("x"))
    return each.select("symbol", F.to_date(F.timestamp_seconds("x.t")).alias("date"), "x.close", "x.volume").na.drop().dropDuplicates(["symbol", "date"])


def within_budget(histories: DataFrame, seconds: Column, budget: float = BUDGET) -> DataFrame:
    """Series whose download began before the budget was used up; seconds: when each began. What was had by then is kept."""
    return histories.where(seconds <= budget)

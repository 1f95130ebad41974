"""Article pages of links, each failing alone."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from gazette.sources import fetch as fetching

#: Seconds for a page, and for all pages of a task; pages at a time.
TIMEOUT, BUDGET, AT_ONCE = 5.0, 300.0, 8


def _get(url: str) -> bytes:
    return fetching.fetch(url, TIMEOUT)


def fetched(links: DataFrame, fetch: Callable[[str], bytes] = _get, budget: float | None = None, at_once: int = AT_ONCE, encoding: str = "utf-8") -> DataFrame:
    """link, html, error of the different links (column link): the page, or why it could not be had. With a budget (seconds), each task begins no page after it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        began = time.monotonic()
        for f in frames:
            rows = []
            for link in f["link"]:
                if budget is not None and time.monotonic() - began > budget:
                    rows.append((link, None, "the budget was used up"))
                    continue
                try:
                    rows.append((link, fetch(link).decode(encoding, errors="replace"), None))
                except Exception as why:  # a page that cannot be had leaves its article as it is
                    rows.append((link, None, f"{type(why).__name__}: {why}"))
            yield pd.DataFrame(rows, columns=["link", "html", "error"])

    return links.where("link <> ''").select("link").distinct().repartition(at_once, "link").mapInPandas(run, "link string, html string, error string")

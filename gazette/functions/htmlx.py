"""The body text of article pages. HTML needs a parser, so this runs by Arrow batches on the rows that need it."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.functions.text import ENDS

# Elements that hold no article text; what a body must have, and at most keeps.
DROPPED = frozenset("script style noscript nav header footer aside form iframe figure figcaption".split())
LEAST_CHARS, LEAST_PROSE, MOST_CHARS = 400, 0.75, 1500
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS = re.compile(ENDS)


def _flat(parts: list[str], glue: str = "") -> str:
    return re.sub(r"\s+", " ", glue.join(parts)).strip()


def prose(text: str) -> float:
    """text.prose_score() of one text."""
    return 100 * sum(1 for _ in _ENDS.finditer(text)) / max(len(text), 100)


class _Page(HTMLParser):
    """Collects the text of each container and of each paragraph in one pass.

    An open paragraph belongs to all open containers. Elements left open are closed with those around them.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []  # [tag, container or None, paragraph or None]
        self.dropping = 0
        self.containers: list[tuple[list[str], list[list[str]]]] = []
        self.paragraphs: list[list[str]] = []

    @staticmethod
    def _is_container(tag: str, attrs: dict[str, str]) -> bool:
        if tag == "article":
            return True
        if tag != "div":
            return False
        name, kind = attrs.get("id") or "", attrs.get("class") or ""
        return any(x in name or x in kind for x in ("article", "content")) or "news_body" in kind

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        if tag == "p":  # a paragraph ends where the next one begins
            self._close("p", within={"article", "div", "td", "li"})
        container = paragraph = None
        if tag in DROPPED:
            self.dropping += 1
        elif not self.dropping:
            if self._is_container(tag, dict(attrs)):
                container = ([], [])
                self.containers.append(container)
            if tag == "p":
                paragraph = []
                self.paragraphs.append(paragraph)
                for x in self.open:
                    if x[1]:
                        x[1][1].append(paragraph)
        self.open.append([tag, container, paragraph])

    def _close(self, tag: str, within: frozenset | set = frozenset()) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.dropping -= sum(x[0] in DROPPED for x in self.open[k:])
                del self.open[k:]
                return
            if self.open[k][0] in within:
                return

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        if self.dropping:
            return
        for _, container, paragraph in self.open:
            if container:
                container[0].append(data)
            if paragraph is not None:
                paragraph.append(data)


def body_of(page: str | None) -> str | None:
    """The shortest container that is long and prosy enough, else all paragraphs if they are long enough; null otherwise, and for pages that the parser cannot read."""
    if not page:
        return None
    tree = _Page()
    try:
        tree.feed(page)
        tree.close()
    except Exception:  # broken mark-up, for one "<![foo["; it must not take the other pages with it
        return None
    fit = []
    for texts, paragraphs in tree.containers:
        text = _flat(["".join(p) for p in paragraphs], " ")
        text = text if len(text) >= LEAST_CHARS else _flat(texts)
        if len(text) >= LEAST_CHARS and prose(text) >= LEAST_PROSE:
            fit.append(text)
    if fit:
        return min(fit, key=len)[:MOST_CHARS]
    rest = _flat(["".join(p) for p in tree.paragraphs], " ")
    return rest[:MOST_CHARS] if len(rest) >= LEAST_CHARS else None


@F.pandas_udf(T.StringType())
def _bodies(pages: pd.Series) -> pd.Series:
    return pages.map(body_of)


def body(page: Column) -> Column:
    return _bodies(page)

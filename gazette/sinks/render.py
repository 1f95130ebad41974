"""Pages, feeds, snapshots and messages: each is a DataFrame of path and content, made of escaped columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.functions import dates, pagekey, text, urls
from gazette.sources.registry import CATEGORIES

_HEAD = (
    '<!doctype html><html lang="ko"><head><meta charset="utf-8"><title>{t}</title><meta property="og:title" content="{t}"><meta property="og:description" content="{x}">'
    '<meta property="og:url" content="{u}"><link rel="stylesheet" href="/style.css"><script src="/site.js" defer></script></head><body>'
)
#: Articles of a category and on AI in the home page's previews.
PREVIEW, AI_PREVIEW = 5, 3
HORIZONS = {"daily": "일간", "weekly": "주간", "monthly": "월간"}
STYLE = "body{font-family:sans-serif;margin:auto;max-width:60em}.up{color:#ef4444}.down{color:#3b82f6}.flat{color:#8890a3}.badge{font-size:.8em}[hidden]{display:none}\n"
SCRIPT = """document.querySelectorAll("[data-tab]").forEach(b => b.addEventListener("click", () => {
  for (const p of b.closest("[data-tabs]").querySelectorAll("[data-panel]")) p.hidden = p.dataset.panel !== b.dataset.tab;
}));
"""


def _fill(pattern: str, **values: Column) -> Column:
    """A template with {name} places as one concatenation."""
    parts, rest = [], pattern
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


def _ordered(rows: Column, order: list[str], glue: str = "") -> Column:
    """Rendered pieces of a group in order."""
    return F.array_join(F.sort_array(F.collect_list(F.struct(*order, rows.alias("piece"))))["piece"], glue)


def with_detail_paths(articles: DataFrame, salt: str, date: str) -> DataFrame:
    """detail_path and detail_rel of articles with a detailed summary, empty for the others."""
    seen = F.length(F.trim(F.coalesce("detail_summary", F.lit("")))) > 0
    name = F.concat(F.lit("a-"), pagekey.page_token(salt, F.lit(date), F.coalesce("link", F.lit(""))), F.lit(".html"))
    rel = F.concat(F.lit(date.replace("-", "/") + "/"), name)
    return articles.withColumns({"detail_rel": F.when(seen, rel).otherwise(""), "detail_path": F.when(seen, F.concat(F.lit("/"), rel)).otherwise("")})


def detail_pages(articles: DataFrame, base: str) -> DataFrame:
    """A page for each article that has a detail path."""
    e = text.escape_html
    body = F.array_join(F.transform(text.paragraphs(F.col("detail_summary")), lambda p: F.concat(F.lit("<p>"), e(p), F.lit("</p>"))), "\n")
    original = F.when(F.length(F.coalesce("original_title", F.lit(""))) > 0, F.concat(F.lit("<details><p>"), e(F.col("original_title")), F.lit("</p></details>"))).otherwise("")
    page = _fill(
        _HEAD + '<article><h1>{t}</h1><span class="news-date">{d}</span><div class="article-body">{b}</div>{o}<a href="{l}" rel="noopener">원문 보기 ({s})</a></article></body></html>',
        t=e(F.col("title")), x=e(text.trim_at_boundary(F.col("summary"), 160)), u=urls.joined(F.lit(base), F.col("detail_rel")), d=dates.local_minute(F.col("published")), b=body, o=original, l=e(F.col("link")), s=e(F.col("source")),
    )
    return articles.where("detail_rel <> ''").select(F.col("detail_rel").alias("path"), page.alias("content"))


def _item(limit: int | None = None) -> Column:
    e = text.escape_html
    summary = F.col("summary") if limit is None else text.trim_at_boundary(F.col("summary"), limit)
    label = F.when(F.coalesce("ai_subtype_label", F.lit("")) != "", F.concat(F.lit('<span class="subtype">'), e(F.col("ai_subtype_label")), F.lit("</span>"))).otherwise("")
    return _fill(
        '<article class="news"><h3><a href="{l}">{t}</a>{b}{a}</h3><p>{s}</p><span>{n} · {d}</span></article>',
        l=e(F.col("link")), t=e(F.col("title")), b=text.badge(F.col("is_important")), a=label, s=e(summary), n=e(F.col("source")), d=dates.local_minute(F.col("published")),
    )


def menu(pages: DataFrame, categories: DataFrame) -> DataFrame:
    """menu: links to the home page and the categories in order; pages: category, path."""
    link = _fill('<a href="/{p}">{i} {n}</a>', p=text.escape_html(F.col("path")), i=F.col("icon"), n=text.escape_html(F.col("category_name")))
    one = pages.select("category", "path").join(F.broadcast(categories), "category").groupBy().agg(_ordered(link, ["category_seq"]).alias("links"))
    return one.select(F.concat(F.lit('<nav><a href="/index.html">🏠</a>'), F.coalesce("links", F.lit("")), F.lit("</nav>")).alias("menu"))


def tabs(rows: DataFrame, tab: str, label: str, order: list[str], piece: Column) -> DataFrame:
    """box: the pieces of each tab in a panel of its own, tabs in order; the first is open. No row if there are none."""
    panels = rows.groupBy(tab, label).agg(_ordered(piece, order).alias("pieces"), F.min(F.struct(*order)).alias("_at"))
    button = _fill('<button data-tab="{t}">{l}</button>', t=F.col(tab), l=text.escape_html(F.col(label)))
    panel = _fill('<div data-panel="{t}">{p}</div>', t=F.col(tab), p=F.col("pieces"))
    one = panels.groupBy().agg(_ordered(button, ["_at"]).alias("buttons"), F.sort_array(F.collect_list(F.struct("_at", panel.alias("piece"))))["piece"].alias("panels"))
    hidden = F.transform("panels", lambda p, i: F.when(i > 0, F.replace(p, F.lit("<div data-panel"), F.lit("<div hidden data-panel"))).otherwise(p))
    return one.where("buttons <> ''").select(F.concat(F.lit('<div data-tabs="">'), "buttons", F.array_join(hidden, ""), F.lit("</div>")).alias("box"))


def indicator_box(indicators: DataFrame) -> DataFrame:
    """box: indices and exchange rates in two tabs; indicators as intraday.market_indicators() gives them. No row if there are none."""
    e = text.escape_html
    item = _fill('<div data-key="{k}"><span>{n}</span> <strong>{v}</strong> <em class="{d}">{p}</em>{s}</div>', k=e(F.col("key")), n=e(F.col("name")), v=F.col("value"), d=F.col("dir"), p=F.col("pct"), s=F.coalesce("sparkline_svg", F.lit("")))
    named = indicators.withColumns({"_label": F.when(F.col("group") == "main", "주요 지표").otherwise("환율"), "_place": F.when(F.col("group") == "main", 0).otherwise(1)})
    return tabs(named, "group", "_label", ["_place", "seq"], item)


def economy_dashboard(picks: DataFrame) -> DataFrame:
    """box: the picks of each horizon in a tab, domestic before overseas ones; picks: market, horizon, rank, symbol, name, price, change_pct, reason."""
    e = text.escape_html
    change = F.coalesce(F.format_string("%+.2f%%", F.col("change_pct")), F.lit(""))
    item = _fill('<div><strong>{n} ({s})</strong> {p} <em class="{d}">{c}</em><p>{r}</p></div>', n=e(F.col("name")), s=e(F.col("symbol")), p=F.format_number("price", 2), d=F.when(F.col("change_pct") > 0, "up").otherwise("down"), c=change, r=e(F.col("reason")))
    labels, places = F.create_map(*[F.lit(x) for kv in HORIZONS.items() for x in kv]), F.create_map(*[F.lit(x) for i, h in enumerate(HORIZONS) for x in (h, i)])
    named = picks.withColumns({"_label": F.element_at(labels, F.col("horizon")), "_place": F.element_at(places, F.col("horizon"))})
    box = tabs(named, "horizon", "_label", ["_place", "market", "rank"], item)
    return box.select(F.concat(F.lit("<section><p>⚠️ 투자 자문이 아닌 정보입니다.</p>"), "box", F.lit("</section>")).alias("box"))


def category_pieces(articles: DataFrame, salt: str, date: str, base: str) -> DataFrame:
    """category, path, part, region, n, inner (between the page's head and its end), content: the pieces of each category's page, which follow each other by part, region and n.

    Regions are in order; IT has its articles on AI first, in a section of their own. A page is never one row: see files.write_pieces().
    """
    on_ai = (F.col("category") == "it") & F.coalesce("is_ai", F.lit(False))
    own = articles.select("category", "region", F.when(on_ai, 1).otherwise(3).alias("part"), "is_important", "published", "article_seq", _item().alias("item")).where("item is not null")
    order = Window.partitionBy("category", "part").orderBy("region", F.col("is_important").desc(), F.col("published").desc(), "article_seq")
    first = F.when(F.col("part") == 1, "<section><h2>🤖 AI</h2>").otherwise("")
    items = own.withColumn("n", F.row_number().over(order)).select("category", "part", "region", "n", F.concat(F.when(F.col("n") > 1, "\n").otherwise(first), "item").alias("content"))
    pages = articles.groupBy("category").agg(F.max(on_ai & _item().isNotNull()).alias("_ai"))
    path = F.concat(F.lit(date.replace("-", "/") + "/"), pagekey.obfuscated(F.concat("category", F.lit(".html")), salt, F.lit(date)))
    pages = pages.withColumn("path", path)
    head = _fill(_HEAD, t=text.escape_html(F.col("category")), x=F.concat(F.lit(f"{date} · "), text.escape_html(F.col("category"))), u=urls.joined(F.lit(base), F.col("path")))
    ends = F.array(*[F.struct(F.lit(k).alias("part"), c.alias("content")) for k, c in ((0, head), (2, F.when(F.col("_ai"), "</section>").otherwise("")), (4, F.lit("</body></html>")))])
    ends = pages.select("category", F.inline(ends)).select("category", "part", F.lit(None).cast("string").alias("region"), F.lit(0).alias("n"), "content")
    return items.unionByName(ends).join(F.broadcast(pages.select("category", "path")), "category").select("category", "path", "part", "region", "n", F.col("part").between(1, 3).alias("inner"), "content")


def category_pages(articles: DataFrame, salt: str, date: str, base: str) -> DataFrame:
    """category, path, content: category_pieces() put together, for pages that a row can hold."""
    return category_pieces(articles, salt, date, base).groupBy("category", "path").agg(_ordered(F.col("content"), ["part", "region", "n"]).alias("content"))


def previews(articles: DataFrame, each: int = PREVIEW, of_ai: int = AI_PREVIEW) -> DataFrame:
    """The first few articles of each category by importance and date, with place: IT without those on AI, which have a preview of their own (category ai)."""
    on_ai = (F.col("category") == "it") & F.coalesce("is_ai", F.lit(False))
    shown = articles.withColumn("category", F.when(on_ai, "ai").otherwise(F.col("category")))
    order = Window.partitionBy("category").orderBy(F.col("is_important").desc(), F.col("published").desc(), "article_seq")
    best = shown.withColumn("place", F.row_number().over(order))
    return best.where(F.col("place") <= F.when(F.col("category") == "ai", of_ai).otherwise(each))


def home_page(articles: DataFrame, cards: DataFrame, date: str, base: str, each: int = PREVIEW, boxes: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """path, content: the menu (of menu()) and indicators (of indicator_box()) if given, the best cards, the first few of each category, and those on AI."""
    seq = F.create_map(*[F.lit(x) for i, c in enumerate([*(c[0] for c in CATEGORIES), "ai"]) for x in (c, i)])
    best = previews(articles, each).withColumn("_c", F.element_at(seq, F.col("category")))
    shown = best.groupBy().agg(_ordered(_item(120), ["_c", "place"], "\n").alias("previews"))  # a few of each category
    card = _fill("<li><b>{h}</b> {b} <i>{c}</i></li>", h=text.escape_html(F.col("card_headline")), b=text.escape_html(F.col("card_blurb")), c=text.escape_html(F.col("category_name")))
    top = cards.groupBy().agg(_ordered(card, ["region", "rank"], "\n")).scalar()
    head = F.concat(*[F.coalesce(x.scalar(), F.lit("")) if x is not None else F.lit("") for x in (links, boxes)])
    page = _fill(_HEAD + "{m}<ol>{c}</ol>{p}</body></html>", t=F.lit(f"오늘의 기사 {date}"), x=F.lit(f"{date}의 기사를 한눈에"), u=F.lit(base), m=head, c=F.coalesce(top, F.lit("")), p=F.coalesce("previews", F.lit("")))
    return shown.select(F.lit("index.html").alias("path"), page.alias("content"))


def feed_xml(articles: DataFrame, base: str, each: int = 3) -> DataFrame:
    """path, content: an RSS 2.0 feed of the newest few of each category, newest first."""
    order = Window.partitionBy("category").orderBy(F.col("is_important").desc(), F.col("published").desc(), "article_seq")
    best = articles.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each)
    e = text.escape_html
    item = _fill(
        "<item><title>{t}</title><link>{l}</link><description>{s}</description><category>{c}</category><pubDate>{d}</pubDate></item>",
        t=e(F.col("title")), l=e(F.col("link")), s=e(F.col("summary")), c=e(F.col("category")), d=dates.rfc822(F.col("published")),
    )
    one = best.withColumn("_age", -F.unix_micros("published")).groupBy().agg(_ordered(item, ["_age", "article_seq"], "\n").alias("items"))
    page = _fill('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>오늘의 기사</title><link>{u}</link>{i}</channel></rss>', u=F.lit(base), i=F.coalesce("items", F.lit("")))
    return one.select(F.lit("feed.xml").alias("path"), page.alias("content"))


def snapshot_pieces(articles: DataFrame, picks: DataFrame, date: str) -> DataFrame:
    """path, part, category, region, place, n, content: the pieces of the day's snapshot_json(), which follow each other by part, category, region, place and n. Articles stand on lines of their own."""
    art = F.struct("title", "link", F.date_format("published", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("published"), "summary", "source", "category", "is_important")
    named = F.when(F.col("category").isNull() | F.col("region").isNull(), F.raise_error(F.lit("an article needs a category and a region")).cast("string")).otherwise(F.col("category"))
    own = articles.select(named.alias("category"), "region", "article_seq", art.alias("a"))
    numbered = own.withColumn("n", F.row_number().over(Window.partitionBy("category", "region").orderBy("article_seq", "a")))
    piece = lambda part, place, n, content: [F.lit(part).alias("part"), "category", "region", F.lit(place).alias("place"), n, content.alias("content")]
    items = numbered.select(*piece(1, 1, "n", F.concat(F.when(F.col("n") > 1, ",\n").otherwise("\n"), F.to_json("a"))))
    # A row for each region of each category: what opens and closes its list.
    lists = own.select("category", "region").distinct()
    lists = lists.withColumns({"_first": F.row_number().over(Window.partitionBy("category").orderBy("region")) == 1, "_any": F.col("category") == F.min("category").over(Window.partitionBy())})
    name = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")  # noqa: E731  a JSON string
    begin = F.when(~F.col("_first"), ",").otherwise(F.concat(F.when(F.col("_any"), "").otherwise("},"), name("category"), F.lit(":{")))
    none = F.lit(0).alias("n")
    opened, closed = lists.select(*piece(1, 0, none, F.concat(begin, name("region"), F.lit(":[")))), lists.select(*piece(1, 2, none, F.lit("]")))
    horizons = picks.groupBy("market", "horizon").agg(F.sort_array(F.collect_list(F.struct("rank", F.struct("symbol", "name", "price", "reason").alias("p"))))["p"].alias("l"))
    markets = horizons.groupBy("market").agg(F.map_from_entries(F.collect_list(F.struct("horizon", "l"))).alias("h")).groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("market", "h"))))).scalar()
    whole = lists.groupBy().agg(F.count(F.lit(1)).alias("lists")).withColumns({"category": F.lit(None).cast("string"), "region": F.lit(None).cast("string")})
    head = whole.select(*piece(0, 0, none, F.lit('{"date":"' + date + '","categories":{')))
    tail = whole.select(*piece(2, 0, none, F.concat(F.when(F.col("lists") > 0, "}").otherwise(""), F.lit('},"stock_picks":'), F.coalesce(markets, F.lit("{}")), F.lit("}"))))
    pieces = head.unionByName(opened).unionByName(items).unionByName(closed).unionByName(tail)
    return pieces.withColumn("path", F.lit(date.replace("-", "/") + ".json"))


#: What pieces of a page or snapshot are ordered by.
PAGE_ORDER, SNAPSHOT_ORDER = ["part", "region", "n"], ["part", "category", "region", "place", "n"]


def snapshot_json(articles: DataFrame, picks: DataFrame, date: str) -> DataFrame:
    """path, content: the day's articles by category and region, and picks by market and horizon, in a file named by the day, so that a second run replaces it; for days that a row can hold."""
    return snapshot_pieces(articles, picks, date).groupBy("path").agg(_ordered(F.col("content"), SNAPSHOT_ORDER).alias("content"))


def archive_index(index: DataFrame) -> DataFrame:
    """path, content: the index (date, categories array of name and path) as JSON, newest day first."""
    one = index.groupBy().agg(F.to_json(F.sort_array(F.collect_list(F.struct("date", "categories")), asc=False)).alias("content"))
    return one.select(F.lit("archive_data.json").alias("path"), "content")


def archive_page(index: DataFrame, salt: str) -> DataFrame:
    """path, content: the list of days, under a name that cannot be guessed."""
    links = F.array_join(F.transform("categories", lambda c: F.concat(F.lit('<a href="/'), text.escape_html(c["path"]), F.lit('">'), text.escape_html(c["name"]), F.lit("</a>"))), " ")
    day = index.withColumn("_age", -F.datediff(F.col("date").cast("date"), F.lit("1970-01-01").cast("date")))
    one = day.groupBy().agg(_ordered(F.concat(F.lit("<li>"), F.col("date").cast("string"), F.lit(" "), links, F.lit("</li>")), ["_age"], "\n").alias("items"))
    page = _fill("<!doctype html><ul>{i}</ul>", i=F.coalesce("items", F.lit("")))
    return one.select(pagekey.obfuscated(F.lit("archive.html"), salt, F.lit("archive")).alias("path"), page.alias("content"))


def indicators_json(indicators: DataFrame, as_of: Column) -> DataFrame:
    """path, content: main and fx lists of indicators (group, seq and their fields); no row if there are none, which leaves the old file."""
    item = F.struct("key", "name", "value", "pct", "dir", "sparkline_svg")
    one = indicators.groupBy().agg(*[F.sort_array(F.collect_list(F.when(F.col("group") == g, F.struct("seq", item.alias("i")))))["i"].alias(g) for g in ("main", "fx")], F.count(F.lit(1)).alias("n"))
    body = F.to_json(F.struct("main", "fx", F.date_format(dates.local(as_of), "yyyy-MM-dd HH:mm").alias("as_of")))
    return one.where("n > 0").select(F.lit("indicators.json").alias("path"), body.alias("content"))


def lead_message(cards: DataFrame, pages: DataFrame, categories: DataFrame, base: str, date: str) -> DataFrame:
    """message: the day's best ten by region, then links to the categories in order."""
    e = text.escape_message
    link = lambda u, t: F.concat(F.lit('<a href="'), e(u), F.lit('">'), t, F.lit("</a>"))
    detail = F.when(F.coalesce("detail_rel", F.lit("")) != "", F.concat(F.lit(" · "), link(urls.joined(F.lit(base), F.col("detail_rel")), F.lit("한국어 상세 요약")))).otherwise("")
    line = _fill("{r}. <b>{h}</b>\n{c} · {s} · {l}{d}", r=F.col("rank").cast("string"), h=e(F.col("card_headline")), c=e(F.col("category_name")), s=e(F.col("source")), l=link(F.col("link"), F.lit("원문 보기")), d=detail)
    label = F.when(F.col("region") == "domestic", "국내").otherwise("해외")
    blocks = cards.groupBy("region").agg(_ordered(line, ["rank"], "\n").alias("lines"))
    blocks = blocks.groupBy().agg(_ordered(_fill("🔥 <b>오늘의 {r} Top 10</b>\n{l}\n", r=label, l=F.col("lines")), ["region"], "\n").alias("blocks"))
    nav = pages.join(F.broadcast(categories), "category").groupBy().agg(_ordered(link(urls.joined(F.lit(base), F.col("path")), F.concat("icon", F.lit(" "), e(F.col("category_name")))), ["category_seq"], " · ")).scalar()
    tail = f'\n\n🏠 <a href="{base.rstrip("/")}/index.html">홈</a>'
    whole = _fill("<b>📰 오늘의 기사 ({d})</b>\n\n{b}\n📂 <b>분야별 바로가기</b>\n{n}{t}", d=F.lit(date), b=F.coalesce("blocks", F.lit("")), n=F.coalesce(nav, F.lit("")), t=F.lit(tail))
    return blocks.select(whole.alias("message"))


def card_grid(cards: DataFrame, width: int = 18, lines: int = 2) -> DataFrame:
    """Cards with their place in a grid of two columns and their lines."""
    i = F.col("rank") - 1
    return cards.withColumns({"col": (i % 2).cast("int"), "row": F.floor(i / 2).cast("int"), "lines": text.wrap(F.col("card_headline"), width, lines)})


def run_summary(counts: DataFrame) -> DataFrame:
    """content: counts (name, value) as a Markdown table."""
    row = F.concat(F.lit("| "), "name", F.lit(" | "), F.col("value").cast("string"), F.lit(" |"))
    one = counts.groupBy().agg(_ordered(row, ["name"], "\n").alias("rows"))
    return one.select(F.concat(F.lit("| counter | value |\n|---|---|\n"), "rows").alias("content"))


def static_files(spark) -> DataFrame:
    """path, content of what does not depend on the day."""
    return spark.createDataFrame([("robots.txt", "User-agent: *\nDisallow: /\n"), ("style.css", STYLE), ("site.js", SCRIPT)], "path string, content string")

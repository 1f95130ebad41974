"""Registered queries on what services answer: pages of indices, rates and charts, feeds, a model's answers, and what is made of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gazette.functions import dates, numeric, text
from gazette.operators import ranking, series
from gazette.plans.catalog import _ARTICLES, _ENTRIES, _PRICES, _any_of, _articles, _blurb, _events, _prices, _snapshot_files, query
from gazette.sources import registry
from gazette.staging import new_path
from gazette.tables import load

# --- prices, indices and rates

#: The last value of each day and type of event, in cents.
_DAILY = "d AS (SELECT event_type, ts::DATE AS day, round(arg_max(value, (ts, event_id)) * 100)::BIGINT / 100.0 AS value FROM events GROUP BY 1, 2)"


def _daily(spark, d):
    last = _events(spark, d).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return last.withColumn("value", F.round(F.col("value") * 100).cast("long") / 100)


@query(f"WITH {_DAILY} SELECT event_type AS symbol, day::VARCHAR AS date, value::DOUBLE AS value FROM d")
def index_pages(spark, d):
    """The days of an index as pages of ten rows, read back from their tables; a first page without rows beside them."""
    from gazette.sources import market

    row = F.concat(F.lit('<tr><td class="date">'), F.date_format("day", "yyyy.MM.dd"), F.lit('</td><td class="number_1">'), F.format_number("value", 2), F.lit("</td><td>-</td></tr>"))
    n = F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("day").desc())) - 1  # a row a day
    pages = _daily(spark, d).select(F.col("event_type").alias("symbol"), F.floor(n / 10).alias("page"), n.alias("n"), row.alias("r")).groupBy("symbol", "page")
    html = pages.agg(F.concat(F.lit("<table><tr><th>day</th></tr>"), F.array_join(F.sort_array(F.collect_list(F.struct("n", "r")))["r"], "\n"), F.lit("</table>")).alias("html"))
    empty = html.select("symbol", F.lit(-1).cast("long").alias("page"), F.lit("<table><tr><td>&nbsp;</td></tr></table>").alias("html")).distinct()
    return market.index_rows(html.unionByName(empty)).select("symbol", F.col("date").cast("string").alias("date"), "value")


@query(f"WITH {_DAILY} SELECT event_type AS currency, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) - 1 AS seq, day::VARCHAR AS date, value::DOUBLE AS rate FROM d WHERE extract(day FROM day) <> 13")
def exchange_rates(spark, d):
    """Rates of a currency as a service's JSON, newest first; a rate that is no number is left out, and an answer that broke off gives none."""
    from gazette.sources import market

    one = _daily(spark, d).where("dayofmonth(day) <> 13")
    item = F.struct(F.col("day").cast("string").alias("localTradedAt"), F.format_number("value", 2).alias("closePrice"))
    lists = one.groupBy(F.col("event_type").alias("currency")).agg(F.sort_array(F.collect_list(item), asc=False).alias("l"))
    odd = F.array(F.struct(F.lit("").alias("localTradedAt"), F.lit("n/a").alias("closePrice")))
    answers = lists.select("currency", F.to_json(F.struct(F.concat("l", odd).alias("result"))).alias("json"))
    broken = lists.select(F.concat("currency", F.lit("-broken")).alias("currency"), F.lit('{"result": [{"localTradedAt": "2024-01-01", "closePr').alias("json"))
    return market.rates(answers.unionByName(broken))


@query(f"WITH {_PRICES} SELECT symbol, date::VARCHAR AS date, close, volume FROM p WHERE extract(day FROM date) % 7 <> 0")
def chart_prices(spark, d):
    """Answers of a chart service on many symbols at once, in arrays by field; days without a price are null in them, and left out."""
    from gazette.sources import market

    p = _prices(spark, d).withColumn("close", F.when(F.dayofmonth("date") % 7 != 0, F.col("close")))
    each = p.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", "close", "volume"))).alias("x"))
    quote = F.struct(F.transform("x", lambda x: x["close"]).alias("close"), F.transform("x", lambda x: x["volume"].cast("long")).alias("volume"))
    one = F.struct(F.struct("symbol").alias("meta"), F.transform("x", lambda x: F.unix_seconds(x["date"].cast("timestamp"))).alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    some = each.select(F.substring("symbol", 1, 7).alias("part"), one.alias("r")).groupBy("part").agg(F.collect_list("r").alias("result"))
    answers = some.select(F.to_json(F.struct(F.struct("result").alias("chart")), {"ignoreNullFields": "false"}).alias("json"))
    return market.chart_rows(answers).select("symbol", F.col("date").cast("string").alias("date"), "close", F.col("volume").cast("double").alias("volume"))


# --- feeds


@query("""SELECT n_regionkey AS source_seq, n_nationkey AS feed_seq, count(c_custkey) AS entries, count(c_custkey) > 0 AS alive
          FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9800 GROUP BY 1, 2""")
def feed_liveness(spark, d):
    """Nations as feeds, their richest customers as entries: which feeds gave any."""
    from gazette.sources import rss

    n = load(spark, d, "nation").select(F.col("n_regionkey").alias("source_seq"), F.col("n_nationkey").alias("feed_seq"))
    entries = load(spark, d, "customer").where("c_acctbal > 9800").join(n, F.col("c_nationkey") == F.col("feed_seq")).select("source_seq", "feed_seq")
    return rss.liveness(entries, n).select("source_seq", "feed_seq", F.col("entries").cast("long"), "alive")


@query("""WITH e AS (SELECT *, event_id % 4 AS way, event_id // 4 % 3 AS feed, event_id // 12 AS place FROM events),
          t AS (SELECT *, 'S&P ' || event_id::VARCHAR || ' up' AS title, CASE WHEN way = 3 THEN '' ELSE 'https://site.example/e?id=' || event_id::VARCHAR END AS link FROM e)
          SELECT event_id, (['politics', 'economy', 'it'])[feed + 1] AS category, title, link, CASE WHEN way = 1 THEN title ELSE 'It rose to ' || event_id::VARCHAR END AS summary,
                 CASE way WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) ELSE (CASE feed WHEN 0 THEN TIMESTAMP '2026-08-14 09:30:00' ELSE TIMESTAMP '2026-08-14 12:00:00' END) - to_minutes(place) END AS published,
                 way >= 2 AS approximate FROM t""")
def feed_articles(spark, d):
    """Entries of three feeds as articles: titles with their source behind them, summaries in HTML that begin with the title, links that are none, and dates missing or broken."""
    from gazette.sources import rss

    feeds = spark.createDataFrame([(0, k, c, "domestic", "ko", "s", "Source") for k, c in enumerate(("politics", "economy", "it"))], "source_seq int, feed_seq int, category string, region string, language string, source_id string, source string")
    n = F.col("event_id")
    way, title = n % 4, F.concat(F.lit("S&amp;P "), n.cast("string"), F.lit(" up"))
    entries = _events(spark, d).select(
        "event_id", F.lit(0).alias("source_seq"), F.expr("cast(event_id div 4 % 3 AS int)").alias("feed_seq"), F.expr("cast(event_id div 12 AS int)").alias("entry_seq"), F.concat(title, F.lit(" - Source")).alias("title"),
        F.when(way == 3, "javascript:x").otherwise(F.concat(F.lit(" https://site.example/e?id="), n.cast("string"))).alias("link"),
        F.when(way == 1, F.concat(F.lit("<p>"), title, F.lit("</p>"))).otherwise(F.concat(F.lit("<b>"), title, F.lit("</b> &ndash; It rose to "), n.cast("string"))).alias("description"),
        F.when(way == 0, dates.rfc822(F.col("ts").cast("timestamp"))).when(way == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(way == 2, "soon").alias("date"),
        F.when(F.expr("event_id div 4 % 3") == 0, "Fri, 14 Aug 2026 09:30:00 GMT").alias("feed_date"),
    )
    out = rss.articles(entries.drop("event_id"), feeds, F.lit("2026-08-14 12:00:00").cast("timestamp"))
    id = F.when(F.col("link") == "", F.regexp_extract("title", "([0-9]+)", 1)).otherwise(F.regexp_extract("link", "([0-9]+)$", 1)).cast("long")
    return out.select(id.alias("event_id"), "category", "title", "link", "summary", F.col("published").cast("timestamp_ntz").alias("published"), F.col("date_is_approximate").alias("approximate"))


# --- a model's answers, given as a table or by a function


@query(f"""WITH {_ARTICLES}, t AS (SELECT doc_id, (['release', 'pricing', 'policy', 'industry_shift', 'other'])[doc_id // 8 % 5 + 1] AS ai_subtype FROM labels WHERE quality = 1)
           SELECT region, t.doc_id IS NOT NULL AS is_ai, CASE ai_subtype WHEN 'release' THEN '신규 모델 출시' WHEN 'pricing' THEN '가격 정책 변경' WHEN 'policy' THEN '정책/약관 변경' WHEN 'industry_shift' THEN '산업 동향' ELSE ai_subtype END AS label, count(*) AS n
           FROM a LEFT JOIN t ON t.doc_id = article_seq WHERE category = 'it' GROUP BY ALL""")
def ai_tags_answered(spark, d):
    """Tags of IT articles from a model's answers, of which each article's last one counts; no keyword is looked at."""
    from gazette.plans import model

    kinds = F.array(*[F.lit(k) for k in ("release", "pricing", "policy", "industry_shift", "other")])
    good = load(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("article_seq"))
    said = good.select("article_seq", F.element_at(kinds, F.expr("cast(article_seq div 8 % 5 + 1 AS int)")).alias("ai_subtype"), F.lit(1).alias("pos"))
    before = good.select("article_seq", F.lit("withdrawn").alias("ai_subtype"), F.lit(0).alias("pos"))
    tagged = model.with_ai_tags(_articles(spark, d).where("category = 'it'"), before.unionByName(said))
    return tagged.groupBy("region", "is_ai", F.col("ai_subtype_label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_ENTRIES}, m AS (SELECT *, CASE WHEN symbol < 'Brand#3' THEN 'domestic' ELSE 'overseas' END AS market FROM e),
           u AS (SELECT market, symbol, volume_ratio, 'daily' AS horizon, daily AS change_pct FROM m UNION ALL SELECT market, symbol, volume_ratio, 'weekly', weekly FROM m UNION ALL SELECT market, symbol, volume_ratio, 'monthly', monthly FROM m),
           r AS (SELECT *, row_number() OVER (PARTITION BY market, horizon ORDER BY change_pct DESC, symbol) AS rank FROM u WHERE change_pct IS NOT NULL QUALIFY rank <= 2)
           SELECT market, horizon, rank::INT AS rank, symbol, CASE WHEN rank = 1 AND horizon <> 'weekly' THEN 'said of ' || symbol ELSE '최근 등락률 ' || printf('%+.1f%%', change_pct)
                  || CASE WHEN volume_ratio IS NULL THEN '' ELSE ', 거래량 평균 대비 ' || (floor(volume_ratio * 100 + 0.5) / 100)::VARCHAR || '배' END || ' 흐름을 보이고 있습니다.' END AS reason FROM r""")
def stock_reasons_answered(spark, d):
    """Reasons of picks from a model's answers; where there is none, or a blank one, a sentence on the movement."""
    from gazette.plans import model

    e = series.candidates(_prices(spark, d), ["symbol"]).withColumn("market", F.when(F.col("symbol") < "Brand#3", "domestic").otherwise("overseas"))
    picks = series.picks(e, ["market"], "symbol").withColumn("id", F.concat_ws("-", "market", "horizon", "rank"))
    answers = picks.where("rank = 1").select("id", F.lit(0).alias("pos"), F.when(F.col("horizon") == "weekly", "  ").otherwise(F.concat(F.lit("said of "), "symbol")).alias("reason"))
    return model.with_reasons(picks, answers).select("market", "horizon", "rank", "symbol", "reason")


def _choice(rules: str, prompt: str) -> str:
    """In place of a model: the candidates 12 to 1, best first, every second one without a headline, and one that isn't there."""
    import json

    ids = sorted((int(line.partition(".")[0]) for line in prompt.split("\n")), reverse=True)
    chosen = [{"id": i, "rank": 13 - i, "card_headline": f"card {i}" if i % 2 else "", "card_blurb": "blurb &amp; more"} for i in ids if i <= 12]
    return json.dumps([{"id": 999, "rank": 0, "card_headline": "none", "card_blurb": "none"}, *chosen])


@query(f"""WITH {_ARTICLES}, i AS (SELECT *, {_any_of([w for x in text.IMPORTANT.values() for w in x], "lower(title || ' ' || summary)")} AS is_important FROM a),
           o AS (SELECT * FROM (VALUES ('politics', 0), ('economy', 1), ('society', 2), ('life', 3), ('culture', 4), ('it', 5), ('science', 6), ('world', 7)) AS v(category, category_seq)),
           c AS (SELECT i.*, row_number() OVER (PARTITION BY category ORDER BY is_important DESC, published DESC, article_seq) AS e FROM i WHERE region = 'domestic' QUALIFY e <= 6),
           n AS (SELECT c.*, row_number() OVER (ORDER BY category_seq, e) AS id FROM c JOIN o USING (category))
           SELECT row_number() OVER (ORDER BY id DESC) AS rank, category, CASE WHEN id % 2 = 1 THEN 'card ' || id::VARCHAR ELSE '' END AS headline, 'blurb & more' AS card_blurb,
                  CASE WHEN article_seq % 1000 = 999 THEN '' ELSE 'https://site.example/a?id=' || article_seq::VARCHAR END AS link FROM n WHERE id <= 12 QUALIFY rank <= 10""")
def cards_answered(spark, d):
    """The ten cards of a region by a model's choice among the candidates: its ranks, headlines and blurbs; an unknown number is left out."""
    from gazette.plans import model

    own = _articles(spark, d).withColumns({"is_important": text.is_important(F.col("title"), F.col("summary")), "detail_path": F.lit(""), "detail_rel": F.lit("")})
    names = "politics economy society life culture it science world".split()
    categories = spark.createDataFrame([(c, k, c) for k, c in enumerate(names)], "category string, category_seq int, category_name string")
    cards = model.top_cards(own, categories, "domestic", _choice)
    headline = F.when(F.col("card_headline").startswith("card "), F.col("card_headline")).otherwise("")  # else the title's, which top10_cards compares
    return cards.select(F.col("rank").cast("long").alias("rank"), "category", headline.alias("headline"), "card_blurb", "link")


# --- archive and pages


@query("""WITH e AS (SELECT event_id, event_type, ts::DATE AS day FROM events QUALIFY row_number() OVER (PARTITION BY ts::DATE, event_type ORDER BY ts DESC, event_id) <= 20), m AS (SELECT max(day) - 3 AS cut FROM e)
          SELECT strftime(day, '%Y-%m') AS year_month, event_type AS category, count(*) AS article_count, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, max('event ' || event_id::VARCHAR) AS last_title
          FROM e, m WHERE day < cut AND strftime(day, '%Y-%m') = (SELECT strftime(max(day), '%Y-%m') FROM e) GROUP BY 1, 2""")
def archived_month(spark, d):
    """A month of the archive, read from its own partition after snapshot files were moved there, with its counts."""
    from gazette.plans import archive
    from gazette.sinks import files
    from gazette.sources import snapshots

    folder = new_path(spark, "month-tree")
    files.write_pages(_snapshot_files(spark, d), folder)
    last = _events(spark, d).agg(F.max(F.to_date("ts"))).first()[0]
    archive.compact(spark, snapshots.read(spark, folder), f"{folder}-archive", F.lit(last), keep=3)
    month = archive.month_summary(spark, f"{folder}-archive", last.strftime("%Y-%m"))
    ends = month.groupBy("year_month", "category").agg(F.min("date").cast("string").alias("first_day"), F.max("date").cast("string").alias("last_day"), F.max("title").alias("last_title"))
    return archive.month_counts(month).join(ends, ["year_month", "category"])


@query("""SELECT o_orderkey AS id, (row_number() OVER w - 1) % 2 AS col, (row_number() OVER w - 1) // 2 AS row, floor((o_orderkey % 256) + (255 - o_orderkey % 256) * 0.85::DOUBLE)::INT AS red FROM orders
          WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) QUALIFY row_number() OVER w <= 10""")
def card_places(spark, d):
    """The ten dearest orders of each priority as cards: their places in the grid, and a channel of their colour."""
    from gazette.sinks import render

    best = ranking.top_of_each(load(spark, d, "orders"), ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10).withColumn("card_headline", F.col("o_clerk") if "o_clerk" in load(spark, d, "orders").columns else F.col("o_orderpriority"))
    placed = render.card_grid(best)
    return placed.select(F.col("o_orderkey").alias("id"), F.col("col").cast("long").alias("col"), F.col("row").cast("long").alias("row"), numeric.pastel(F.col("o_orderkey") % 256).alias("red"))


@query("""WITH c AS (SELECT o_orderpriority AS name, count(*) AS value FROM orders GROUP BY 1)
          SELECT '| counter | value |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || name || ' | ' || value::VARCHAR || ' |', chr(10) ORDER BY name) AS content FROM c""")
def run_report(spark, d):
    """Counters of a run as the table that is shown for it."""
    from gazette.sinks import render

    return render.run_summary(load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("value")))


@query("""SELECT substr('E' || o_orderkey::VARCHAR || ': ' || o_orderpriority || repeat('x', 200), 1, 150) AS error FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 5""")
def first_failures(spark, d):
    """The first five error texts of a run, cut to what is shown."""
    from gazette.operators import metrics

    said = F.concat(F.lit("E"), F.col("o_orderkey").cast("string"), F.lit(": "), "o_orderpriority", F.repeat(F.lit("x"), F.lit(200)))
    own = load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", said).alias("error"))
    return metrics.first_errors(own, "error", "o_orderkey")


def _esc(sql: str) -> str:
    """DuckDB: text.escape_html()."""
    for char, entity in (("'&'", "&amp;"), ("'<'", "&lt;"), ("'>'", "&gt;"), ("'\"'", "&#34;"), ("chr(39)", "&#39;")):
        sql = f"replace({sql}, {char}, '{entity}')"
    return sql


def _token(sql: str) -> str:
    """DuckDB: pagekey.page_token() of the parts joined by |, behind the salt."""
    return (
        f"list_aggregate(list_transform(range(0, 10), lambda i: substr('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', (('0x' || substr(sha256('salt|' || {sql}), (i * 2 + 1)::INT, 2))::INT % 62 + 1)::INT, 1)), 'string_agg', '')"
    )


def _head(title: str, description: str, url: str) -> str:
    """DuckDB: the head of every page."""
    return (
        f"'<!doctype html><html lang=\"ko\"><head><meta charset=\"utf-8\"><title>' || {title} || '</title><meta property=\"og:title\" content=\"' || {title} || '\"><meta property=\"og:description\" content=\"' || {description}"
        f" || '\"><meta property=\"og:url\" content=\"' || {url} || '\"><link rel=\"stylesheet\" href=\"/style.css\"><script src=\"/site.js\" defer></script></head><body>'"
    )


_LINK_OF = "CASE WHEN article_seq % 1000 = 999 THEN '' ELSE 'https://site.example/a?id=' || article_seq::VARCHAR END"
_MINUTE = "strftime(published + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M')"


@query(f"""WITH {_ARTICLES}, o AS (SELECT *, {_LINK_OF} AS link FROM a WHERE region = 'overseas' AND trim(summary, chr(32)) <> '' AND article_seq % 1000 <> 999),
           p AS (SELECT *, '2026/08/14/a-' || {_token("'2026-08-14|' || link")} || '.html' AS path,
                        coalesce(list_aggregate(list_transform(list_filter(list_transform(string_split(summary, chr(10)), lambda x: trim(x, chr(32))), lambda x: x <> ''), lambda x: '<p>' || {_esc('x')} || '</p>'), 'string_agg', chr(10)), '') AS body FROM o)
           SELECT article_seq, path, md5({_head(_esc('title'), _esc(_blurb('summary', 160)), "'https://site.example/' || path")} || '<article><h1>' || {_esc('title')} || '</h1><span class="news-date">' || {_MINUTE} || '</span><div class="article-body">' || body
                  || '</div><a href="' || {_esc('link')} || '" rel="noopener">원문 보기 (' || {_esc('source')} || ')</a></article></body></html>') AS content_md5 FROM p""")
def detail_page_contents(spark, d):
    """The page of each overseas article: its whole text in paragraphs, date, source and head, under a name that cannot be guessed."""
    from gazette.sinks import render

    a = _articles(spark, d).withColumns({"detail_summary": F.when(F.col("region") == "overseas", F.col("summary")), "original_title": F.lit(None).cast("string")})
    named = render.with_detail_paths(a, "salt", "2026-08-14")
    pages = render.detail_pages(named, "https://site.example").select("path", F.md5("content").alias("content_md5"))
    # Articles without a link would share one path.
    return named.where("detail_rel <> ''").where("link <> ''").select("article_seq", F.col("detail_rel").alias("path")).join(pages, "path")


@query(f"""WITH {_ARTICLES}, i AS (SELECT *, {_LINK_OF} AS link, {_any_of([w for x in text.IMPORTANT.values() for w in x], "lower(title || ' ' || summary)")} AS important FROM a),
           r AS (SELECT *, '<article class="news"><h3><a href="' || {_esc('link')} || '">' || {_esc('title')} || '</a>' || CASE WHEN important THEN '{text.BADGE}' ELSE '' END || '</h3><p>' || {_esc('summary')} || '</p><span>' || {_esc('source')} || ' · ' || {_MINUTE} || '</span></article>' AS item FROM i),
           c AS (SELECT category, '2026/08/14/' || category || '-' || {_token("'2026-08-14|' || category || '.html'")} || '.html' AS path, string_agg(item, chr(10) ORDER BY region, important DESC, published DESC, article_seq) AS items FROM r GROUP BY category)
           SELECT category, path, md5({_head('category', "'2026-08-14 · ' || category", "'https://site.example/' || path")} || items || '</body></html>') AS content_md5, length(items) AS chars FROM c""")
def category_page_contents(spark, d):
    """The page of each category with all its articles in order, important ones marked."""
    from gazette.sinks import files, render

    a = _articles(spark, d).withColumns({"is_important": text.is_important(F.col("title"), F.col("summary")), "is_ai": F.lit(False), "ai_subtype_label": F.lit(None).cast("string")})
    pieces = render.category_pieces(a, "salt", "2026-08-14", "https://site.example")
    names = pieces.where("part = 0").select("category", "path")
    return files.digests(pieces, render.PAGE_ORDER).join(F.broadcast(names), "path").select("category", "path", "content_md5", "chars")


_PLACES = ", ".join(f"('{c[0]}', {i})" for i, c in enumerate(registry.CATEGORIES))


@query(f"""WITH {_ARTICLES}, i AS (SELECT *, {_LINK_OF} AS link, {_any_of([w for x in text.IMPORTANT.values() for w in x], "lower(title || ' ' || summary)")} AS important FROM a),
           b AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY important DESC, published DESC, article_seq) AS place FROM i QUALIFY place <= 5),
           r AS (SELECT o.seq, place, '<article class="news"><h3><a href="' || {_esc('link')} || '">' || {_esc('title')} || '</a>' || CASE WHEN important THEN '{text.BADGE}' ELSE '' END || '</h3><p>' || {_esc(_blurb('summary', 120))} || '</p><span>' || {_esc('source')} || ' · ' || {_MINUTE} || '</span></article>' AS item
                 FROM b LEFT JOIN (VALUES {_PLACES}) o(category, seq) USING (category)),
           k AS (SELECT region, row_number() OVER (PARTITION BY region ORDER BY article_seq) AS rank, '<li><b>' || {_esc(_blurb('title', 40))} || '</b> ' || {_esc('source')} || ' <i>' || category || '</i></li>' AS card FROM a QUALIFY rank <= 10)
           SELECT 'index.html' AS path, md5({_head("'오늘의 기사 2026-08-14'", "'2026-08-14의 기사를 한눈에'", "'https://site.example'")} || '<ol>' || (SELECT string_agg(card, chr(10) ORDER BY region, rank) FROM k) || '</ol>'
                  || (SELECT string_agg(item, chr(10) ORDER BY seq NULLS FIRST, place) FROM r) || '</body></html>') AS content_md5""")
def home_page_contents(spark, d):
    """The home page: cards by region and rank, and the first five articles of each category in the registry's order."""
    from gazette.sinks import render

    a = _articles(spark, d).withColumns({"is_important": text.is_important(F.col("title"), F.col("summary")), "is_ai": F.lit(False), "ai_subtype_label": F.lit(None).cast("string")})
    first = ranking.top_of_each(a.select("region", "article_seq", "title", "source", "category"), ["region"], [F.col("article_seq")], 10)
    cards = first.select("region", "rank", text.trim_at_boundary(F.col("title"), 40).alias("card_headline"), F.col("source").alias("card_blurb"), F.col("category").alias("category_name"))
    return render.home_page(a, cards, "2026-08-14", "https://site.example").select("path", F.md5("content").alias("content_md5"))


@query(f"""WITH {_ARTICLES}, i AS (SELECT *, {_any_of([w for x in text.IMPORTANT.values() for w in x], "lower(title || ' ' || summary)")} AS important FROM a)
           SELECT '2026-08-14' AS date, category, row_number() OVER (PARTITION BY category ORDER BY region, article_seq) - 1 AS seq, title, {_LINK_OF} AS link, strftime(published, '%Y-%m-%dT%H:%M:%SZ') AS published, md5(summary) AS summary_md5, source, important FROM i""")
def snapshot_roundtrip(spark, d):
    """The day's snapshot written as one file, by category and region, and read back by its day: every article in its place with its fields."""
    import datetime as dt

    from gazette.sinks import files, render
    from gazette.sources import snapshots

    a = _articles(spark, d).withColumn("is_important", text.is_important(F.col("title"), F.col("summary")))
    e = series.candidates(_prices(spark, d), ["symbol"]).withColumn("market", F.when(F.col("symbol") < "Brand#3", "domestic").otherwise("overseas"))
    picks = series.picks(e, ["market"], "symbol").withColumns({"name": F.col("symbol"), "reason": F.lit("moved")})
    folder = new_path(spark, "snapshot")
    files.write_pieces(render.snapshot_pieces(a, picks, "2026-08-14"), folder, render.SNAPSHOT_ORDER)
    day = dt.date(2026, 8, 14)
    back = snapshots.articles(snapshots.read_days(spark, folder, day, day))
    return back.select(F.col("date").cast("string").alias("date"), "category", "seq", "title", "link", "published", F.md5("summary").alias("summary_md5"), "source", F.col("is_important").alias("important"))


@query(f"""{_ENTRIES}, m AS (SELECT *, CASE WHEN symbol < 'Brand#3' THEN 'domestic' ELSE 'overseas' END AS market FROM e),
           u AS (SELECT market, symbol, price, 'daily' AS horizon, daily AS change_pct FROM m UNION ALL SELECT market, symbol, price, 'weekly', weekly FROM m UNION ALL SELECT market, symbol, price, 'monthly', monthly FROM m),
           r AS (SELECT *, row_number() OVER (PARTITION BY market, horizon ORDER BY change_pct DESC, symbol) AS rank FROM u WHERE change_pct IS NOT NULL QUALIFY rank <= 2)
           SELECT '2026-08' AS year_month, market, horizon, symbol, floor(price * 10000 + 0.5) / 10000 AS price_at_pick FROM r""")
def archived_picks(spark, d):
    """The day's picks in its snapshot file, moved into the archive, and their history read from the month that holds them."""
    import datetime as dt

    from gazette.plans import archive
    from gazette.sinks import files, render
    from gazette.sources import snapshots

    e = series.candidates(_prices(spark, d), ["symbol"]).withColumn("market", F.when(F.col("symbol") < "Brand#3", "domestic").otherwise("overseas"))
    picks = series.picks(e, ["market"], "symbol").withColumns({"name": F.col("symbol"), "reason": F.lit("moved")})
    articles = _articles(spark, d).withColumn("is_important", F.lit(False))
    folder = new_path(spark, "picks-tree")
    files.write_pieces(render.snapshot_pieces(articles, picks, "2026-08-14"), folder, render.SNAPSHOT_ORDER)
    archive.compact(spark, snapshots.read(spark, folder), f"{folder}-archive", F.lit(dt.date(2026, 12, 31)))
    table = spark.read.parquet(f"{folder}-archive/picks").withColumn("year_month", F.date_format(F.to_date("year_month", "yyyy-MM"), "yyyy-MM"))
    names = [r[0] for r in picks.select("symbol").distinct().orderBy("symbol").collect()]  # twelve at most
    out = None
    for symbol in names:
        for market in ("domestic", "overseas"):
            one = archive.stock_history(table, symbol, market, "2026-08-01")
            out = one if out is None else out.unionByName(one)
    return out.select("year_month", "market", "horizon", "symbol", numeric.round_half_up(F.col("price_at_pick"), 4).alias("price_at_pick"))

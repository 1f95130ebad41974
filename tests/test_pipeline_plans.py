import datetime as dt
import hashlib
import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gazette.plans import archive, daily, intraday, model
from gazette.sinks import files, render
from gazette.sources import market, pages, registry, rss, snapshots
from gazette.streaming import refresh

NOW = dt.datetime(2026, 8, 14, 0, 0)


def feed(items):
    rows = "".join(f"<item><title>{t}</title><link>{link}</link><description>{d}</description>{'<pubDate>' + p + '</pubDate>' if p else ''}</item>" for t, link, d, p in items)
    return f"<?xml version='1.0' encoding='utf-8'?><rss version='2.0'><channel><title>x</title><lastBuildDate>Fri, 14 Aug 2026 00:00:00 GMT</lastBuildDate>{rows}</channel></rss>"


@pytest.fixture
def feeds(spark, tmp_path):
    date = "Thu, 13 Aug 2026 2{}:00:00 +0000"
    many = [(f"Story number {i} alpha{i} beta{i}", f"https://a.kr/v?no={i}", f"summary {i}", date.format(i % 4)) for i in range(30)]
    (tmp_path / "a.xml").write_text(feed(many), encoding="utf-8")
    (tmp_path / "b.xml").write_text(feed([("8월 14일 인사", "https://b.kr/1", "x", date.format(0)), ("Old news", "https://b.kr/2", "x", "Mon, 03 Aug 2026 00:00:00 +0000"), ("Seen &amp; known", "https://b.kr/3?utm_source=q", "x", date.format(1)), ("Fresh &amp; new", "https://b.kr/4", "&lt;b&gt;Fresh &amp;amp; new&lt;/b&gt; - more", "")]), encoding="utf-8")
    (tmp_path / "bad.xml").write_text("<rss><channel><item>", encoding="utf-8")
    sources = [
        ("a", "A", "ko", "domestic", 15, [("politics", f"{tmp_path}/a.xml")]),
        ("b", "B", "en", "domestic", 10, [("politics", f"{tmp_path}/b.xml")]),
        ("bad", "C", "en", "overseas", 10, [("it", f"{tmp_path}/bad.xml"), ("world", f"{tmp_path}/none.xml")]),
    ]
    return registry.feeds(spark, sources)


def test_feeds_to_edition(spark, feeds):
    entries = rss.read_feeds(spark, feeds)
    assert entries.count() == 15 + 4
    alive = {(r["source_id"], r["category"]): r["alive"] for r in rss.liveness(entries, feeds).collect()}
    assert alive == {("a", "politics"): True, ("b", "politics"): True, ("bad", "it"): False, ("bad", "world"): False}
    arts = rss.articles(entries, feeds, F.lit(NOW))
    history = spark.createDataFrame([("https://b.kr/3", dt.date(2026, 8, 12))], "canonical_link string, date date")
    got = daily.edition(arts, history, None, F.lit(NOW)).collect()
    by = {r["title"]: r for r in got}
    assert "Old news" not in by and "8월 14일 인사" not in by and "Seen & known" not in by
    fresh = by["Fresh & new"]
    assert fresh["date_is_approximate"] and fresh["summary"] == "more" and fresh["llm_failed"]
    assert len(got) == 16


def test_registry():
    rows = registry.feed_rows()
    assert len(rows) == 74 and len({r[2] for r in rows}) == 30 and len({r[3] for r in rows}) == 27
    assert len(registry.CATEGORIES) == 8 and all(len(x) == 20 for x in registry.WATCHED.values())


def _articles(spark, n, region="domestic"):
    rows = [(i, "politics", region, f"title{i}", f"https://x/{i}", NOW - dt.timedelta(minutes=i), f"summary{i}", "S") for i in range(n)]
    return spark.createDataFrame(rows, "article_seq long, category string, region string, title string, link string, published timestamp, summary string, source string")


def test_model_answers_and_isolation(spark):
    def call(rules, prompt):
        assert "Category: politics." in rules and "detail_600" not in rules
        lines = prompt.split("\n")
        assert all(f"[S/ko] title" in line and " — summary" in line for line in lines)
        ids = [int(line.split(".")[0]) for line in lines]
        if "title0 " in prompt:
            raise OSError("down")
        return json.dumps([{"id": i, "paraphrased_title": f"new {i}", "summary_250": "s &amp; t", "is_important": True, "exclude": i == 2} for i in ids])

    got = {r["article_seq"]: r for r in model.summarized(_articles(spark, 16), call).collect()}
    assert all(got[i]["llm_failed"] and got[i]["title"] == f"title{i}" for i in range(8))
    assert not got[8]["llm_failed"] and got[8]["title"] == "new 1" and got[8]["summary"] == "s & t" and got[8]["original_title"] == "title8"
    assert 9 not in got and len(got) == 15
    again = model.with_retry(_articles(spark, 16), model.summarized(_articles(spark, 16), call), lambda r, p: call(r, p.replace("title0 ", "title00 ")))
    assert again.where("llm_failed").count() == 0


def test_model_without_budget(spark, monkeypatch):
    monkeypatch.setattr(model, "BUDGET", -1.0)
    calls = spark.createDataFrame([("r", str(i)) for i in range(3)], "rules string, prompt string")
    assert [r["raw"] for r in model.ask(calls, lambda r, p: "[{}]", at_once=1).collect()] == ["[{}]"] * 3


def test_model_budget(spark):
    calls = spark.createDataFrame([("k", "", f"p{i}") for i in range(3)], "k string, rules string, prompt string")
    clock = model.new_clock(spark)
    got = [r["raw"] for r in model.ask(calls, lambda r, p: "[1]", budget=-1.0, at_once=1, clock=clock).collect()]
    assert got.count("[1]") == 1  # the first always passes
    assert [r["raw"] for r in model.ask(calls, lambda r, p: "[1]", budget=-1.0, at_once=1, clock=clock).collect()] == [None] * 3  # one clock for the run
    assert [r["raw"] for r in model.ask(calls, None).collect()] == [None] * 3


@pytest.mark.parametrize(
    "errors, waits, answered",
    [
        ([], [], True),
        ([model.Refused(429, "3")], [3], True),
        ([model.Refused(429, "9999")], [30], True),
        ([model.Refused(429, "Wed, 21 Oct 2026 07:28:00 GMT"), model.Refused(429)], [5, 15], True),
        ([model.Refused(429), model.Refused(429), model.Refused(429)], [5, 15], False),
        ([model.Refused(503), OSError("down")], [1, 2], True),
        ([OSError()] * 3, [1, 2], False),
        ([model.Refused(400)], [], False),
        ([model.Refused(404)], [], False),
    ],
)
def test_model_attempts(errors, waits, answered):
    left, waited = list(errors), []

    def call(rules, prompt):
        if left:
            raise left.pop(0)
        return "ok"

    assert model.answer_to(call, "", "", 2, waited.append) == ("ok" if answered else None) and waited == waits


def test_model_asks_again_for_json(spark):
    one = spark.createDataFrame([("", "p")], "rules string, prompt string")
    answers = {"p": "I cannot [yet] say.", "p\n\nJSON only, without explanation.": '[{"id": 1}]'}
    assert model.ask(one, lambda r, p: answers[p]).first()["raw"] == '[{"id": 1}]'
    assert model.ask(one, lambda r, p: '[{"id": 1}, {"id": 2').first()["raw"] == '[{"id": 1}, {"id": 2'  # can be salvaged


def test_probe(spark):
    def probe(key):
        if key == "slow":
            raise TimeoutError
        if key == "busy":
            raise model.Refused(429)
        return 401 if key == "bad" else 200

    keys = spark.createDataFrame([(k,) for k in ("good", "good", "bad", "slow", "busy", "", None)], "key string")
    got = {r["key"]: (r["status"], r["usable"]) for r in model.probed(keys, probe).collect()}
    assert got == {"good": (200, True), "bad": (401, False), "slow": (None, True), "busy": (429, True)}


def test_cards(spark):
    arts = model.with_ai_tags(model.summarized(_articles(spark, 12))).withColumns({"detail_path": F.lit(""), "detail_rel": F.lit("")})
    cats = registry.categories(spark)
    cards = model.top_cards(arts, cats, "domestic").orderBy("rank").collect()
    assert [c["rank"] for c in cards] == list(range(1, 7))  # six of a category at most
    said = '[{"id": 0, "rank": 1}, {"id": 3, "rank": "2", "card_headline": "H"}, {"id": 2, "rank": 1}, {"id": 99, "rank": 3}]'
    chosen = model.top_cards(arts, cats, "domestic", lambda r, p: said).orderBy("rank").collect()
    assert [c["card_headline"] for c in chosen] == ["title1", "H"]


def test_keys(spark):
    df = spark.createDataFrame([(200,), (400,), (401,), (403,), (404,), (429,), (503,), (None,)], "s int")
    assert [r[0] for r in df.select(model.usable_status(F.col("s"))).collect()] == [True, False, False, False, False, True, True, True]
    assert [r[0] for r in spark.range(12).select(model.concurrency(F.col("id"))).collect()] == [3, 3, 4, 6, 8, 10, 12, 14, 16, 16, 16, 16]


def _snapshot(date, links, shape="map"):
    arts = [{"title": t, "summary": "s" * 100, "source": "S", "link": u} for t, u in links]
    return {"date": date, "categories": {"politics": {"domestic": arts} if shape == "map" else arts}, "stock_picks": {"domestic": {"daily": [{"symbol": "X", "name": "x", "price": 1.5, "reason": "r"}]}}}


def _write(root, date, snap):
    p = root / (date.replace("-", "/") + ".json")
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(snap), encoding="utf-8")


def test_recent_links(spark, tmp_path):
    _write(tmp_path, "2026-08-13", _snapshot("2026-08-13", [("a", "https://x/1?utm_source=q")]))
    _write(tmp_path, "2026-08-12", _snapshot("2026-08-12", [("b", "https://x/2")], "list"))
    _write(tmp_path, "2026-08-01", _snapshot("2026-08-01", [("c", "https://x/3")]))
    (tmp_path / "2026" / "08" / "11.json").write_text("{broken")
    (tmp_path / "2026" / "08" / "notes.json").write_text("{}")
    s = snapshots.read(spark, str(tmp_path))
    links = {r["canonical_link"] for r in snapshots.recent_links(s, F.lit(dt.date(2026, 8, 14))).collect()}
    assert links == {"https://x/1", "https://x/2"}


def test_look_back_opens_only_the_days_asked_for(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

    for k in range(1, 29):
        _write(tmp_path, f"2026-08-{k:02d}", _snapshot(f"2026-08-{k:02d}", [(f"t{k}", f"https://x/{k}")]))
    (tmp_path / "2026" / "08" / "11.json").write_text("{broken")
    folder = f"file://{tmp_path}"
    got = snapshots.links_before(spark, folder, dt.date(2026, 8, 14)).collect()
    assert {r["canonical_link"] for r in got} == {f"https://x/{k}" for k in (7, 8, 9, 10, 12, 13)}  # the broken one is left out
    reader = snapshots.DayReader({"path": folder})
    day = lambda k: dt.date(2026, 8, k)
    rest = list(reader.pushFilters([IsNotNull(("date",)), GreaterThanOrEqual(("date",), day(7)), LessThan(("date",), day(14)), EqualTo(("value",), "x")]))
    assert [type(f).__name__ for f in rest] == ["IsNotNull", "EqualTo"]
    opened, local = [], snapshots.pyarrow.fs.LocalFileSystem()

    class Counting:
        def open_input_stream(self, path):
            opened.append(path)
            return local.open_input_stream(path)

    monkeypatch.setattr(snapshots, "pyarrow", SimpleNamespace(fs=SimpleNamespace(FileSystem=SimpleNamespace(from_uri=lambda uri: (Counting(), str(tmp_path))))))
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) == 7 == len(opened)
    some = snapshots.DayReader({"path": folder})
    assert not list(some.pushFilters([In(("date",), (day(3), day(5), dt.date(2020, 1, 1)))])) and len(some.days()) == 3
    with pytest.raises(ValueError):
        snapshots.DayReader({"path": folder}).partitions()


def test_archive_reads_only_the_months_of_new_days(spark, tmp_path, monkeypatch):
    raw, arc = tmp_path / "raw", str(tmp_path / "arc")
    _write(raw, "2026-03-05", _snapshot("2026-03-05", [("A", "u1")]))
    archive.compact(spark, snapshots.read(spark, str(raw)), arc, F.lit(dt.date(2026, 8, 1)))
    plans, merge = [], archive.new_headlines
    monkeypatch.setattr(archive, "new_headlines", lambda *a: plans.append(merge(*a)) or plans[-1])
    _write(raw, "2026-04-05", _snapshot("2026-04-05", [("A", "u1")]))
    new = snapshots.read(spark, str(raw)).where("date >= '2026-04-01'")
    archive.compact(spark, new, arc, F.lit(dt.date(2026, 8, 1)))
    plan = plans[0]._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert plan.count("PartitionFilters: [isnotnull(year_month") >= 2 and "2026-03" not in plan
    assert spark.read.parquet(f"{arc}/headlines").count() == 2


def test_retirement_deletes_only_what_is_archived(spark, tmp_path, monkeypatch):
    raw, arc = tmp_path / "raw", str(tmp_path / "arc")
    _write(raw, "2026-04-05", _snapshot("2026-04-05", [("A", "u1")]))
    _write(raw, "2026-04-06", _snapshot("2026-04-06", [("a!", "u1")]))  # no headline of its own is left of this day
    _write(raw, "2026-07-30", _snapshot("2026-07-30", [("B", "u2")]))
    today = F.lit(dt.date(2026, 8, 1))
    with monkeypatch.context() as m:
        m.setattr(archive, "included", lambda spark, a: spark.createDataFrame([], "year_month string, date date"))
        with pytest.raises(RuntimeError):
            archive.retire(spark, str(raw), arc, today)
    assert len(list(raw.rglob("*.json"))) == 3
    assert archive.retire(spark, str(raw), arc, today) == ["2026-04-05", "2026-04-06"]
    assert [p.name for p in raw.rglob("*.json")] == ["30.json"] and archive.retire(spark, str(raw), arc, today) == []
    assert spark.read.parquet(f"{arc}/headlines").count() == 1 and archive.included(spark, arc).count() == 2


def test_pages_are_written_all_or_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/site"
    assert files.write_pages(spark.createDataFrame([("old/a.html", "1"), ("b.html", "1")], "path string, content string"), folder) == 2
    rows = spark.range(40).select(F.concat(F.lit("n/"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") == 37, F.raise_error(F.lit("no such page"))).otherwise("x").alias("content"))
    with pytest.raises(Exception, match="no such page"):
        files.write_pages(rows.repartition(4), folder)
    there = lambda: sorted(str(p.relative_to(tmp_path / "site")) for p in (tmp_path / "site").rglob("*") if p.is_file())
    assert there() == ["b.html", "old/a.html"]
    # Two attempts of one task, of which one counts, and a third that broke off.
    import pyarrow as pa

    writer = files.PagesWriter({"path": folder, "job": "j"})
    batch = lambda x: iter([pa.RecordBatch.from_arrays([pa.array(["c.html"]), pa.array([x])], ["path", "content"])])
    first, second = writer.write(batch("first")), writer.write(batch("second"))
    assert first.folder != second.folder
    writer.commit([second, None])
    assert (tmp_path / "site" / "c.html").read_text() == "second" and there() == [".count-j", "b.html", "c.html", "old/a.html"]
    assert files.write_pages(spark.createDataFrame([], "path string, content string"), folder) == 0


def test_archive(spark, tmp_path):
    raw, arc = tmp_path / "raw", str(tmp_path / "arc")
    _write(raw, "2026-04-05", _snapshot("2026-04-05", [("A", "u1"), ("dup", "u2")]))
    _write(raw, "2026-04-20", _snapshot("2026-04-20", [("B", "u3"), ("Dup!", "u4")], "list"))
    _write(raw, "2026-07-22", _snapshot("2026-07-22", [("recent", "u5")]))
    today = F.lit(dt.date(2026, 8, 1))
    for _ in range(2):  # the second run changes nothing
        days = archive.compact(spark, snapshots.read(spark, str(raw)), arc, today)
        assert days == ["2026-04-05", "2026-04-20"]
        heads = spark.read.parquet(f"{arc}/headlines")
        assert {r["title"] for r in heads.collect()} == {"A", "dup", "B"} and heads.first()["gist"] == "s" * 80
        assert archive.month_counts(heads).first()["article_count"] == 3
        picks = spark.read.parquet(f"{arc}/picks").withColumn("year_month", F.date_format(F.to_date("year_month", "yyyy-MM"), "yyyy-MM"))
        assert picks.count() == 2
    got = archive.stock_history(picks, "X", "domestic", "2026-04-10").collect()
    assert [r["date"] for r in got] == ["2026-04-20"]
    files.drop_files(heads, [f"{raw}/2026/04/05.json"])
    assert not os.path.exists(raw / "2026" / "04" / "05.json") and os.path.exists(raw / "2026" / "07" / "22.json")


def test_render(spark, tmp_path):
    arts = model.with_ai_tags(model.summarized(_articles(spark, 7))).withColumn("title", F.concat(F.lit("<t> & "), "title")).withColumn("detail_summary", F.when(F.col("article_seq") < 2, "one\n\ntwo"))
    arts = render.with_detail_paths(arts, "salt", "2026-08-14")
    details = render.detail_pages(arts, "https://site").collect()
    assert len(details) == 2 and "<p>one</p>\n<p>two</p>" in details[0]["content"] and "&lt;t&gt; &amp;" in details[0]["content"]
    cats = registry.categories(spark)
    cards = model.top_cards(arts, cats, "domestic")
    pages = render.category_pages(arts, "salt", "2026-08-14", "https://site")
    home = render.home_page(arts, cards, "2026-08-14", "https://site").first()
    assert home["content"].count("<article") == 5 and home["content"].count("<li>") == 6
    feed_row = render.feed_xml(arts, "https://site").first()["content"]
    assert feed_row.count("<item>") == 3 and "&lt;t&gt;" in feed_row
    message = render.lead_message(cards, pages, cats, "https://site", "2026-08-14").first()["message"]
    assert "국내 Top 10" in message and "&lt;t&gt; &amp;" in message and "🏛️ 정치" in message
    picks = spark.createDataFrame([("domestic", "daily", 1, "X", "x", 1.0, "r")], "market string, horizon string, rank int, symbol string, name string, price double, reason string")
    snap = render.snapshot_json(arts, picks, "2026-08-14")
    assert files.write_pages(snap, f"file://{tmp_path}/raw") == 1
    back = snapshots.read(spark, f"{tmp_path}/raw")
    assert snapshots.articles(back).count() == 7 and snapshots.picks(back).first()["price_at_pick"] == 1.0
    index = spark.createDataFrame([("2026-08-13", [("정치", "a.html")]), ("2026-08-14", [])], "date string, categories array<struct<name:string,path:string>>")
    assert [x["date"] for x in json.loads(render.archive_index(index).first()["content"])] == ["2026-08-14", "2026-08-13"]
    assert render.archive_page(index, "salt").first()["content"].index("08-14") < render.archive_page(index, "salt").first()["content"].index("08-13")
    assert [(c["col"], c["row"]) for c in render.card_grid(cards).orderBy("rank").collect()][:3] == [(0, 0), (1, 0), (0, 1)]
    assert "| a | 1 |" in render.run_summary(spark.createDataFrame([("a", 1)], "name string, value long")).first()["content"]


def test_intraday_keeps_last_good(spark, tmp_path):
    h = spark.createDataFrame([(0, "k", "K", i, float(100 + i)) for i in range(9)], "seq int, key string, name string, date int, value double")
    folder = f"file://{tmp_path}"
    assert intraday.refresh({"main": h, "fx": h.where("false")}, F.lit(NOW), folder)
    first = (tmp_path / "indicators.json").read_text()
    assert json.loads(first)["main"][0]["dir"] == "up" and json.loads(first)["as_of"] == "2026-08-14 09:00"
    assert not intraday.refresh({"main": h.where("false")}, F.lit(NOW), folder)
    assert (tmp_path / "indicators.json").read_text() == first


def test_market_scan(spark, monkeypatch):
    """Pages until an empty one; a series of which a page fails is left out."""

    def page(rows):
        return ("<table>" + "".join(f"<tr><td>{d}</td><td>{c}</td><td>x</td><td>{v}</td></tr>" for d, c, v in rows) + "<tr><td>&nbsp;</td></tr></table>").encode("euc-kr")

    def fetch(url):
        symbol, number = url.split("?")[1].split(",")
        if symbol == "down" and number == "2":
            raise OSError("down")
        if symbol == "short" and number == "2":
            return b"<table><tr><td>&nbsp;</td></tr></table>"
        return page([(f"2026.08.{10 - int(number):02d}", f"1,{number}00", "5,000")])

    series = spark.createDataFrame([("long",), ("short",), ("down",)], "symbol string")
    pages = market.scan(series, "https://x/day?{symbol},{page}", fetch=fetch, encoding="euc-kr")
    assert sorted((r["symbol"], r["page"] or 0, r["error"]) for r in pages.collect()) == [("down", 0, "OSError: down"), ("long", 1, None), ("long", 2, None), ("long", 3, None), ("short", 1, None)]
    prices = {(r["symbol"], str(r["date"])): (r["close"], r["volume"]) for r in market.price_rows(pages).collect()}
    assert prices[("long", "2026-08-07")] == (1300.0, 5000.0) and len(prices) == 4
    assert market.index_rows(pages).where("symbol = 'short'").first()["value"] == 1100.0
    assert market.scan(series, "https://x/day?{symbol},{page}", fetch=fetch, encoding="euc-kr", budget=-1).where("error = 'the budget was used up' AND html IS NULL").count() == 3
    monkeypatch.setattr(market, "BUDGET", -1.0)  # no scan has it unless it is given
    assert market.scan(series, "https://x/day?{symbol},{page}", fetch=fetch, encoding="euc-kr").where("html IS NOT NULL").count() == 4


def test_pages_fail_alone(spark):
    def fetch(url):
        if url.endswith("2"):
            raise OSError("down")
        return f"<p>{url}</p>".encode()

    links = spark.createDataFrame([(f"https://x/{i}",) for i in (1, 2, 3, 3)] + [("",), (None,)], "link string")
    assert {(r["link"], r["html"], r["error"]) for r in pages.fetched(links, fetch).collect()} == {("https://x/2", None, "OSError: down")} | {(f"https://x/{i}", f"<p>https://x/{i}</p>", None) for i in (1, 3)}
    assert {r["error"] for r in pages.fetched(links, fetch, budget=-1).collect()} == {"the budget was used up"}


def test_chart_rows(spark):
    one = {"meta": {"symbol": "AAPL"}, "timestamp": [1786600800, 1786687200], "indicators": {"quote": [{"close": [1.5, None], "volume": [10, 20]}]}}
    df = spark.createDataFrame([(json.dumps({"chart": {"result": [one]}}),), ("{",), ('{"chart": {"result": null}}',)], "json string")
    assert [(r["symbol"], r["close"], r["volume"]) for r in market.chart_rows(df).collect()] == [("AAPL", 1.5, 10.0)]


def test_market_sources(spark):
    html = "<table><tr><th>d</th></tr><tr><td><span>2026.08.13</span></td><td><span>1,200</span></td><td>0</td><td>3,000</td></tr><tr><td>&nbsp;</td><td></td></tr></table>"
    rows = market.price_rows(spark.createDataFrame([("X", html)], "symbol string, html string")).collect()
    assert [(r["close"], r["volume"]) for r in rows] == [(1200.0, 3000.0)]
    fx = spark.createDataFrame([("USD", '{"result":[{"localTradedAt":"2026-08-13","closePrice":"1,390.5"}]}'), ("EUR", "oops")], "currency string, json string")
    assert [(r["currency"], r["rate"]) for r in market.rates(fx).collect()] == [("USD", 1390.5)]


def test_streams(spark, sf, tmp_path):
    src = str(tmp_path / "src")
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(src)
    batch = spark.read.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = refresh.write_last_good(refresh.latest_values(stream, ["event_type"]), str(tmp_path / "out"), str(tmp_path / "cp"), "complete")
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    last = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]).drop("batch")
    want = refresh.latest_values(batch, ["event_type"])
    assert last.exceptAll(want).isEmpty() and want.exceptAll(last).isEmpty()
    q = refresh.write_last_good(refresh.once(stream, ["user_id"], ttl="365 days"), str(tmp_path / "o2"), str(tmp_path / "c2"), "append")
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o2")).count() == batch.select("user_id").distinct().count()
    assert refresh.drop_late(stream).isStreaming


def test_stock_picks_and_budget(spark):
    from gazette.plans.stocks import market_picks

    day = dt.date(2026, 8, 1)
    rows = [(s, day + dt.timedelta(i), 100.0 + k * i, 10.0, 30.0 * k) for k, s in enumerate(("AAPL", "MSFT", "V", "KO")) for i in range(8)]
    prices = spark.createDataFrame(rows, "symbol string, date date, close double, volume double, began double")
    got = market_picks(prices, registry.watched(spark), "began", 60.0).where("horizon = 'daily'").orderBy("rank").collect()
    assert [(r["symbol"], r["name"]) for r in got] == [("V", "Visa"), ("MSFT", "Microsoft")] and "거래량 평균 대비 1.0배" in got[0]["reason"]


def test_small_things(spark, tmp_path):
    from gazette.config import logger, settings
    from gazette.functions.pagekey import ensure_salt
    from gazette.operators import metrics

    assert settings({"GAZETTE_RETENTION_DAYS": "x", "GAZETTE_MODEL_BUDGET": "5"}).model_budget == 5.0
    assert settings({"GAZETTE_RETENTION_DAYS": "x"}).retention_days == 90
    assert len(logger("a").handlers) == len(logger("a").handlers) == 1
    salt = ensure_salt(f"file://{tmp_path}/s")
    assert len(salt) == 32 and ensure_salt(f"file://{tmp_path}/s") == salt
    files.write_pages(render.static_files(spark), f"file://{tmp_path}/site")
    assert (tmp_path / "site" / "robots.txt").read_text().startswith("User-agent")
    index = spark.createDataFrame([("2026-08-13", [("정치", "a.html")]), ("2026-08-14", [])], archive.INDEX)
    files.write_pages(render.archive_index(index), f"file://{tmp_path}/site")
    back = archive.read_index(spark, f"file://{tmp_path}/site/archive_data.json")
    assert archive.without_days(back, spark.createDataFrame([("2026-08-13",)], "date string")).first()["date"] == "2026-08-14"
    assert archive.read_index(spark, f"file://{tmp_path}/none.json").count() == 0
    assert archive.month_summary(spark, f"file://{tmp_path}/none", "2026-08").count() == 0
    errors = spark.createDataFrame([(i, "e" * 200 if i % 2 else None) for i in range(20)], "n int, e string")
    got = metrics.first_errors(errors, "e", "n").collect()
    assert len(got) == 5 and all(len(r["error"]) == 150 for r in got)


def test_previews_and_boxes(spark):
    rows = [(i, "it" if i < 9 else "world", "domestic", f"title{i}", f"https://x/{i}", NOW - dt.timedelta(minutes=i), f"summary{i}", "S", i % 2 == 0, False, None) for i in range(20)]
    arts = spark.createDataFrame(rows, "article_seq long, category string, region string, title string, link string, published timestamp, summary string, source string, is_ai boolean, is_important boolean, ai_subtype_label string")
    got = {}
    for r in render.previews(arts).collect():
        got.setdefault(r["category"], []).append(r["article_seq"])
    assert {k: sorted(v) for k, v in got.items()} == {"ai": [0, 2, 4], "it": [1, 3, 5, 7], "world": [9, 10, 11, 12, 13]}
    pages = {r["category"]: r for r in render.category_pages(arts, "s", "2026-08-14", "https://b").collect()}
    it = pages["it"]["content"]
    assert it.index("title8") < it.index("</section>") < it.index("title1<") and "<section>" not in pages["world"]["content"] and "og:description" in it
    nav = render.menu(spark.createDataFrame([("world", "w.html"), ("it", "i.html")], "category string, path string"), registry.categories(spark)).first()["menu"]
    assert nav.index("i.html") < nav.index("w.html")
    ind = spark.createDataFrame([("fx", 0, "USD", "달러", "1,300", "+0.10%", "up", ""), ("main", 1, "B", "b", "2", "-1.00%", "down", ""), ("main", 0, "A", "a<", "1", "+1.00%", "up", "<svg/>")], "group string, seq int, key string, name string, value string, pct string, dir string, sparkline_svg string")
    box = render.indicator_box(ind).first()["box"]
    assert box.index("a&lt;") < box.index(">b<") < box.index("달러") and box.count("hidden") == 1 and "<svg/>" in box
    assert render.indicator_box(ind.where("false")).count() == 0
    picks = spark.createDataFrame([("overseas", "daily", 1, "X", "x", 10.5, 1.25, "r"), ("domestic", "daily", 1, "Y", "y", 1000.0, None, "q"), ("domestic", "weekly", 1, "Z", "z", 1.0, -2.0, "p")], "market string, horizon string, rank int, symbol string, name string, price double, change_pct double, reason string")
    dash = render.economy_dashboard(picks).first()["box"]
    assert dash.index("y (Y)") < dash.index("x (X)") < dash.index("z (Z)") and "+1.25%" in dash and "일간" in dash
    home = render.home_page(arts, spark.createDataFrame([], "region string, rank int, card_headline string, card_blurb string, category_name string"), "2026-08-14", "https://b", boxes=render.indicator_box(ind), links=render.menu(spark.createDataFrame([("it", "i.html")], "category string, path string"), registry.categories(spark)))
    page = home.first()["content"]
    assert "i.html" in page and "달러" in page and page.index("title9<") < page.index("title0<")


def test_similar_pairs_against_loop(spark):
    import random

    from gazette.operators import similar

    rng = random.Random(2)
    rows = [(i, f"g{i % 2}", [f"w{int(abs(rng.gauss(0, 8)))}" for _ in range(rng.randint(0, 9))]) for i in range(160)]
    classes = similar.set_classes(spark.createDataFrame(rows, "id long, g string, w array<string>"), ["g"], "id", "w")
    first = {}
    for i, g, w in rows:
        if w:
            first.setdefault((g, frozenset(w)), i)
    for t in (0.3, 0.5, 0.8, 1.0):
        want = {(a, b) for (g, x), a in first.items() for (h, y), b in first.items() if g == h and a < b and len(x & y) >= t * len(x | y)}
        pairs = similar.similar_pairs(classes, ["g"], t)
        assert {(r["a"], r["b"]) for r in pairs.collect()} == want
        kept, joined = [], {}
        for b in sorted(first.values()):
            a = next((a for a in kept if (a, b) in want), None)
            kept.append(b) if a is None else joined.update({b: a})
        assert {r["b"]: r["a"] for r in similar.first_kept(pairs, ["g"]).collect()} == joined


def test_numbered(spark):
    from gazette.operators import ranking

    df = spark.createDataFrame([(i, "a" if i % 10 else None, (i * 37) % 100) for i in range(100)], "i long, k string, o long").repartition(5)
    got = {r["i"]: r["place"] for r in ranking.numbered(df, ["k"], [F.col("o").desc(), F.col("i")]).collect()}
    for k in (True, False):
        own = sorted((-((i * 37) % 100), i) for i in range(100) if (i % 10 == 0) == k)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))


def test_entry_survives_what_is_missing():
    """Without a library of the corpus operators the other queries are still there."""
    import subprocess
    import sys

    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'balanced_top20' in q and 'op1_licenses' not in q and set(e.oracle_sql()) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], check=True, cwd=root)


def test_polls_give_each_entry_once_also_when_run_again(tmp_path, monkeypatch):
    from gazette.sources import feed_stream

    file = tmp_path / "a.xml"
    show = lambda ids: file.write_text(feed([(f"t{i}", f"https://x/{i}", "", "") for i in ids]))
    feeds_ = [{"source_seq": 0, "feed_seq": 0, "url": f"file://{file}", "limit": 9}, {"source_seq": 0, "feed_seq": 1, "url": f"file://{tmp_path}/none.xml", "limit": 9}]
    reader = feed_stream.FeedStreamReader({"feeds": json.dumps(feeds_), "kept": f"file://{tmp_path}/kept"})
    links = lambda start, end: sorted(row[4] for p in reader.partitions({"poll": start}, {"poll": end}) for row in reader.read(p))
    assert reader.initialOffset() == {"poll": 0} and reader.latestOffset() == {"poll": 1}
    show([1, 2])
    assert links(0, 1) == ["https://x/1", "https://x/2"]
    show([2, 3])
    assert links(0, 1) == ["https://x/1", "https://x/2"]  # the batch is run again: what it found counts, not what the feed has now
    assert reader.latestOffset() == {"poll": 2} and reader.latestOffset() == {"poll": 3}  # a poll that no batch got
    assert links(1, 3) == ["https://x/3"] and links(3, 3) == []
    file.unlink()
    assert links(3, 4) == []  # it cannot be had
    show([1, 4])
    assert links(4, 5) == ["https://x/4"]  # what was known before is not new
    monkeypatch.setattr(feed_stream, "KEEP", 1)
    reader.commit({"poll": 5})
    assert links(5, 6) == ["https://x/1"] or links(5, 6) == []  # of older polls nothing is known any more


def test_broken_saved_feed_is_told_apart(spark, tmp_path):
    (tmp_path / "kind=good").mkdir()
    (tmp_path / "kind=bad").mkdir()
    (tmp_path / "kind=none").mkdir()
    (tmp_path / "kind=good" / "f.xml").write_text(feed([("a &amp; b", " https://x/1 ", "&lt;p&gt;d&lt;/p&gt;", "Thu, 13 Aug 2026 20:00:00 +0000"), ("c", "https://x/2", "", "")]))
    (tmp_path / "kind=bad" / "f.xml").write_text("<rss><channel><item><title>x</item></channel></rss>")
    (tmp_path / "kind=none" / "f.xml").write_text(feed([]))
    rows = rss.read_saved(spark, str(tmp_path), 1).collect()
    assert {(r["kind"], r["entry_seq"], r["title"], r["link"], r["description"], r["feed_date"]) for r in rows if not r["broken"]} == {("good", 0, "a & b", "https://x/1", "<p>d</p>", "Fri, 14 Aug 2026 00:00:00 GMT")}
    assert [r["kind"] for r in rows if r["broken"]] == ["bad"]


def test_memory_over_runs_of_a_stream(spark, tmp_path):
    """Keys with nulls, ties, and keys that come again within and after the days, whichever run saw them last."""
    from gazette.streaming import memory

    t0 = dt.datetime(2026, 8, 1)
    rounds = [[(1, "a", 0), (2, "a", 0), (3, None, 1), (4, "b", 2)], [(5, "a", 6.5), (6, None, 9), (7, "b", 8.9)], [(8, "a", 13.6), (9, "b", 16.5), (10, "c", 17)]]
    for renew, want in ((True, {1, 3, 4, 6, 8, 9, 10}), (False, {1, 3, 4, 6, 8, 9, 10})):
        base = tmp_path / str(renew)
        for rows in rounds:
            spark.createDataFrame([(i, k, t0 + dt.timedelta(days=d)) for i, k, d in rows], "event_id long, k string, ts timestamp").write.mode("append").parquet(f"{base}/in")
            events = spark.readStream.schema("event_id long, k string, ts timestamp").parquet(f"{base}/in")
            memory.run_to_end(memory.unseen(events, ["k"], renew=renew), f"{base}/out", f"{base}/state")
        got = {r["event_id"] for r in spark.read.parquet(f"{base}/out").collect()}
        assert got == (want if not renew else want - ({7} & want)), (renew, got)


def test_stream_memory_calls_grow_with_parts_not_with_keys(spark):
    """One call holds many keys, forgets what is over, and goes on from what it held."""
    from gazette.streaming import memory

    class State:
        def __init__(self):
            self.get, self.exists, self.hasTimedOut, self.watermark, self.timeout = None, False, False, 0, None

        def update(self, value):
            self.get, self.exists = value, True

        def remove(self):
            self.get, self.exists = None, False

        def setTimeoutTimestamp(self, at):
            self.timeout = at

        def getCurrentWatermarkMs(self):
            return self.watermark

    import pandas as pd

    state, step = State(), memory._seen(1000, True, ["id"])
    frame = lambda rows: iter([pd.DataFrame(rows, columns=["own_key", "own_at", "own_id"]).assign(id=lambda f: f["own_id"])])
    seen = lambda rows: [i for f in step((0,), frame(rows), state) for i in f["id"].tolist()]
    assert seen([(f"k{k}", 5000 + k, k) for k in range(50)]) == list(range(50))
    assert seen([("k0", 5900, 50), ("k1", 6002, 51), ("k0", 6890, 52)]) == [51]
    state.watermark = 8
    assert seen([("k2", 8000, 53)]) == [53] and sorted(state.get[0].split("\n")) == ["k0", "k1", "k2"]
    state.watermark, state.hasTimedOut = 20, True
    assert list(step((0,), iter([]), state)) == [] and not state.exists


def test_requests_reach_a_worker_in_small_batches(spark):
    from gazette.plans import model

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    requests = spark.range(1000).select("id", F.lit("r").alias("rules"), F.lit("p").alias("prompt"))
    assert model.ask(requests, lambda r, p: "[{}]", at_once=1).where("raw = '[{}]'").count() == 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256


def test_large_snapshots_are_read_in_pieces(spark, tmp_path, monkeypatch):
    """No row holds a large file; every article keeps its place, and a broken file gives nothing."""
    import io

    one = {"date": "d", "categories": {'a"é': {"domestic": [{"t": 'é한국 \\ " ] }', "n": k * 1.5} for k in range(9)], "overseas": [{"t": "z"}]}, "b": [{"t": 1}], "c": [], "e": {}}, "stock_picks": {"m": {}}, "z": 12345678901}
    text = json.dumps(one, indent=1, ensure_ascii=False).encode()
    with monkeypatch.context() as m:
        m.setattr(snapshots, "READ", 7)
        m.setattr(snapshots, "PIECE", 40)
        found, rows = {}, list(snapshots._pieces(io.BytesIO(text[7:]), text[:7]))
        for value, begin in rows:
            for category, articles in json.loads(value)["categories"].items():
                assert len(found.setdefault(category, [])) == begin
                found[category] += articles
        assert found == {'a"é': one["categories"]['a"é']["domestic"] + [{"t": "z"}], "b": [{"t": 1}]} and json.loads(rows[-1][0])["stock_picks"] == {"m": {}}
        for k in range(8, len(text) - 1, 5):
            with pytest.raises(ValueError):
                list(snapshots._pieces(io.BytesIO(text[7:k]), text[:7]))
    big = [(f"t{k}", f"https://x/{k}" + "y" * 1000) for k in range(6000)]
    _write(tmp_path, "2026-08-13", _snapshot("2026-08-13", big))
    s = snapshots.read(spark, str(tmp_path))
    got = snapshots.articles(s).select("seq", "title").collect()
    assert s.count() > 5 and sorted((r["seq"], r["title"]) for r in got) == [(k, f"t{k}") for k in range(6000)]


def test_files_are_written_in_pieces(spark, tmp_path):
    pieces = spark.createDataFrame([(f"p{p}", k, f"{p}-{k};", k > 0) for p in range(3) for k in range(40)], "path string, n int, content string, inner boolean").repartition(5)
    want = {f"p{p}": "".join(f"{p}-{k};" for k in range(40)) for p in range(3)}
    assert files.write_pieces(pieces, f"file://{tmp_path}/out", ["n"]) == 3
    assert {p: (tmp_path / "out" / p).read_text() for p in want} == want
    got = {r["path"]: (r["content_md5"], r["chars"]) for r in files.digests(pieces, ["n"]).collect()}
    assert got == {p: (hashlib.md5(x.encode()).hexdigest(), len(x) - 4) for p, x in want.items()}

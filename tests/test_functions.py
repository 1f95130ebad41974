import html as htmllib

import pytest
from pyspark.sql import functions as F

from gazette.functions import dates, htmlx, jsonx, numeric, pagekey, text, urls


def one(spark, column, **values):
    names = list(values) or ["x"]
    row = tuple(values.values()) or ("",)
    kinds = {str: "string", int: "long", float: "double", list: "array<double>", type(None): "string", bool: "boolean"}
    df = spark.createDataFrame([row], ", ".join(f"{n} {kinds[type(v)]}" for n, v in zip(names, row)))
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("https://z.kr/view?no=1", "https://z.kr/view?no=2", False),
        ("https://s.kr/n?news_id=1&utm_source=x", "https://s.kr/n?news_id=1", True),
        ("https://s.kr/n/?fbclid=1#top", "https://s.kr/n", True),
        ("https://o.kr/a?CNTN_CD=1&ref=x", "https://o.kr/a?CNTN_CD=2&ref=x", False),
        ("http://o.kr/a", "https://o.kr/a", False),
        ("https://z.kr/v?no=%EA%B0%80", "https://z.kr/v?no=가", True),
        ("https://z.kr/v?q=a%20b", "https://z.kr/v?q=a+b", True),
        ("https://z.kr/v?%75tm_source=x&no=1", "https://z.kr/v?no=1", True),
        ("https://z.kr/v?a=%zz", "https://z.kr/v?a=%25zz", True),
        ("https://z.kr/v?a=b%26c", "https://z.kr/v?a=b&c", False),
    ],
)
def test_canonical_links(spark, a, b, same):
    assert (one(spark, urls.canonical(F.col("a")), a=a) == one(spark, urls.canonical(F.col("a")), a=b)) is same


def test_links(spark):
    assert one(spark, urls.canonical(F.col("a")), a=" https://X.kr/p//?b=&a=1&UTM_Medium=q ") == "https://X.kr/p?b=&a=1"
    assert one(spark, urls.guarded(F.col("a")), a="javascript:alert(1)") == ""
    assert one(spark, urls.joined(F.lit("https://x/"), F.col("a")), a="/b") == "https://x/b"
    assert one(spark, urls.base_path(F.col("a")), a="https://x.io/site/") == "/site"


def test_trim_at_boundary(spark):
    long = "첫 문장이 여기 있습니다. " + "이어지는 말이 길게 이어지고 또 이어지다가 " * 4
    for limit in (30, 60):
        got = one(spark, text.trim_at_boundary(F.col("a"), limit), a=long)
        assert len(got) <= limit + 1 and (got.endswith("…") or got.endswith("다."))
    assert "&" not in one(spark, text.trim_at_boundary(F.col("a"), 22), a="abcdefghijklmnopqr &quot;abc&quot; def")
    assert one(spark, text.trim_at_boundary(F.col("a"), 22), a="short") == "short"
    assert one(spark, text.trim_at_boundary(F.col("a"), 22), a="") == ""


def test_titles(spark):
    norm = lambda t: one(spark, text.normalize_title(F.col("a")), a=t)
    assert norm(" Hello, World! ") == norm("hello_world") == "helloworld"
    assert norm("속보: 한글 제목…") == "속보한글제목"
    assert one(spark, text.tokens(F.col("a")), a="a bb BB bb 한글 한") == ["bb", "BB", "한글"]
    assert one(spark, text.strip_suffix(F.col("a")), a="Title - v.daum.net") == "Title"
    assert one(spark, text.strip_title_prefix(F.col("s"), F.col("t")), s="Big news – and more", t="Big news") == "and more"
    assert one(spark, text.strip_title_prefix(F.col("s"), F.col("t")), s="Other", t="Big news") == "Other"
    assert one(spark, text.is_bulletin(F.col("a")), a="8월 14일 인사") is True
    assert one(spark, text.is_bulletin(F.col("a")), a="8월 14일 인사 발표") is False


def test_html_text(spark):
    assert one(spark, text.clean_html(F.col("a")), a="<p>S&amp;P&nbsp;500 &#8212; up</p>") == htmllib.unescape("S&amp;P&nbsp;500 &#8212; up")
    assert one(spark, text.clean_html(F.col("a")), a='<a href="x">t</a>&nbsp;&nbsp;<font color="1">v.daum.net</font>') == ""
    assert one(spark, text.escape_message(F.col("a")), a="S&P <b>") == "S&amp;P &lt;b&gt;"
    assert one(spark, text.escape_html(F.col("a")), a="\"'") == "&#34;&#39;"


def test_keywords(spark):
    assert one(spark, text.is_important(F.col("a"), F.lit("")), a="New SOFTWARE out") is True  # "war" within a word counts
    assert one(spark, text.is_important(F.col("a"), F.lit("")), a="a calm day") is False
    assert one(spark, text.is_ai_related(F.col("a"), F.lit("")), a="said") is True  # so does "ai"
    assert one(spark, text.ai_label(F.col("a")), a="pricing") == "가격 정책 변경"
    assert one(spark, text.ai_label(F.col("a")), a="other") == "other"


def test_prose(spark):
    heads = "대통령 순방 일정 발표\n코스피 상승 마감\n날씨 맑아 " * 3
    body = "정부가 새 정책을 발표했다. 시장은 크게 반응했다. 전문가는 신중했다. 결과는 지켜봐야 한다. " * 3
    assert one(spark, text.prose_score(F.col("a")), a=heads) < 0.75 <= one(spark, text.prose_score(F.col("a")), a=body)
    need = lambda s: one(spark, text.needs_body(F.col("a")), a=s)
    assert need("short") and need("x" * 400 + "…") and need("x" * 400 + "...") and not need("x" * 400)


def test_dates(spark):
    p = lambda s: str(one(spark, dates.parse_date(F.col("a")).cast("string"), a=s))
    assert p("Fri, 14 Aug 2026 06:00:00 +0900") == "2026-08-13 21:00:00"
    assert p("14 Aug 2026 06:00:00 GMT") == "2026-08-14 06:00:00"
    assert p("Fri, 14 Aug 2026 06:00:00") == "2026-08-14 06:00:00"
    assert p("2026-08-14T06:00:00+09:00") == "2026-08-13 21:00:00"
    assert p("soon") == "None"
    chosen = one(spark, dates.choose_date(F.lit(None).cast("timestamp"), F.col("a"), F.lit("2026-08-14 06:00:00").cast("timestamp"), F.lit(5)), a="garbage")
    assert chosen["is_approximate"] and str(chosen["published"]) == "2026-08-14 05:55:00"
    page = '<meta content="2026-08-14T09:00:00+09:00" property="article:published_time">'
    assert one(spark, dates.page_published(F.col("a")).cast("string"), a=page) == "2026-08-14 00:00:00"
    assert one(spark, dates.local_day(F.lit("2026-08-13 21:00:00").cast("timestamp")), a="") == "2026년 08월 14일 (금)"


def test_numbers(spark):
    assert one(spark, numeric.retry_after(F.col("a")), a="3") == 3
    assert one(spark, numeric.retry_after(F.col("a")), a="9999") == 30
    assert one(spark, numeric.retry_after(F.col("a")), a="Fri, 14 Aug") is None
    svg = one(spark, numeric.sparkline(F.col("v"), F.lit("up")), v=[110.0, 108.0, 106.0, 104.0, 102.0, 100.0, 101.0])
    assert "#ef4444" in svg and svg.count(",") == 7
    assert one(spark, numeric.sparkline(F.col("v"), F.lit("up")), v=[1.0]) == ""
    assert one(spark, numeric.sparkline_points(F.col("v")), v=[5.0, 5.0]) == "0.0,25.0 84.0,25.0"
    assert one(spark, numeric.comma_number(F.col("a")), a="1,234.5") == 1234.5
    assert one(spark, numeric.movement_sentence(F.col("a"), F.lit(1.5)), a=2.0) == "최근 등락률 +2.0%, 거래량 평균 대비 1.5배 흐름을 보이고 있습니다."


def test_page_token(spark):
    assert one(spark, pagekey.page_token("salt", F.lit("2026-08-12"), F.lit("world.html")), a="") == "vgG8tULN4U"
    assert one(spark, pagekey.obfuscated(F.lit("world.html"), "salt", F.lit("2026-08-12")), a="") == "world-vgG8tULN4U.html"


@pytest.mark.parametrize(
    "raw,n",
    [
        ('[{"id":1},{"id":2}]', 2),
        ('Here: [{"id":1}] thanks', 1),
        ('[{"id":1,"t":"a } \\" {"},{"id":2},{"id":3,"t":"cut', 2),
        ('[{"id":1},{"id":2', 1),
        ('[{"id":1,"x":{"y":[1]}},{"id":2,"x":{"y"', 1),
        ("no json", None),
        ("", None),
        (None, None),
    ],
)
def test_model_items(spark, raw, n):
    got = one(spark, jsonx.items(F.col("a")), a=raw)
    assert (len(got) if got is not None else None) == n


def test_flattened(spark):
    kind = "struct<link:string>"
    assert len(one(spark, jsonx.flattened(F.col("a"), kind), a='[{"link":"x"}]')) == 1
    assert len(one(spark, jsonx.flattened(F.col("a"), kind), a='{"domestic":[{"link":"x"}],"overseas":[{"link":"y"},{"link":"z"}]}')) == 3


def test_body():
    prose = "정부가 새 정책을 발표했다. 시장은 크게 반응했다. " * 20
    page = f"<html><body><nav>menu. menu.</nav><div class='content'><div id='article'><script>x()</script><p>{prose}</p></div><div>더 읽기 목록</div></div></body></html>"
    got = htmlx.body_of(page)
    assert got.startswith("정부가") and "menu" not in got and "x()" not in got and len(got) <= 1500
    assert htmlx.body_of("<p>short</p>") is None
    assert htmlx.body_of(f"<p>{prose}<p>{prose}") is not None  # no container: all paragraphs
    assert htmlx.body_of(None) is None
    assert htmlx.body_of("<![foo[ bar ]]>") is None and htmlx.body_of("<![ [") is None
    assert htmlx.body_of("<div class='content'>" + "제목만 나열 " * 100 + "</div>") is None


def test_broken_pages_take_no_others_with_them(spark):
    prose = "정부가 새 정책을 발표했다. 시장은 크게 반응했다. " * 20
    got = spark.createDataFrame([(1, "<![foo[ bar ]]>"), (2, f"<article><p>{prose}</p></article>"), (3, None)], "i long, h string").select("i", htmlx.body(F.col("h")).alias("b")).collect()
    assert {r["i"]: r["b"] is not None for r in got} == {1: False, 2: True, 3: False}


def test_first_sentence(spark):
    for t, first, rest in (("One. Two", "One.", " Two"), (" \nHead line\nBody.", "Head line", "\nBody."), ("no end", "no end", ""), ("", "", ""), (None, "", ""), ("?!", "?", "!")):
        assert one(spark, text.first_sentence(F.col("t")), t=t) == first and one(spark, text.after_first_sentence(F.col("t")), t=t) == rest


def test_entities_as_the_standard_library_has_them(spark):
    from html.entities import html5

    ends = ["", ";", "x", " ", ";;", "&", "=1", "\u00e9"]
    cases = [f"a&{k}{e}b" for k in html5 for e in ("", " ")] + [f"&{k.rstrip(';')}{e}" for k in list(html5)[::7] for e in ends]
    cases += [f"&#{n}{e}" for n in [*range(0, 200), 8364, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10**9, 10**30] for e in ("", ";", "a")]
    cases += [f"&#{x}{n:x};" for n in (0, 9, 0x41, 0x80, 0x9F, 0x20AC, 0x1F600, 0x10FFFF, 0x110000, 2**70) for x in "xX"] + ["&#0000000000065;", "&#x0000000041", "&", "&&", "a & b", "&#;", "&#x;", "&;", "&notit;", "&notin;", "&ampamp;", "&" + "a" * 40, "", "none", "\t&\n&\f& "]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    out = df.select("i", text.decoded(F.col("t")).alias("u"))
    assert "Python" not in out._jdf.queryExecution().toString()
    wrong = [(cases[r["i"]], r["u"]) for r in out.collect() if r["u"] != htmllib.unescape(cases[r["i"]])]
    assert wrong == []
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(text.decoded(F.col("t"))).first()[0] is None


def test_salvage(spark):
    cases = {
        '[{"a": 1}, {"b": {"c": [1, {"d": 2}]}}, {"e": ': ['{"a":1}', '{"b":{"c":[1,{"d":2}]}}'],
        'so: [{"a": "} { \\" ]"}, {"b": "cut': ['{"a":"} { \\" ]"}'],
        '[{"a": 1}, {bad}, {"b": 2}': ['{"a":1}', '{"b":2}'],
        '[} {"a": 1} }, {"b": 2}': ['{"a":1}', '{"b":2}'],
        '[{"a": "line\nbreak"': None, "no array {}": None, "[": None, "": None, "[{": None, None: None,
        '["x", {"a": "\\\\"}, 3': ['{"a":"\\\\"}'],
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, t string")
    out = df.select("i", jsonx.salvage(F.col("t")).alias("s"))
    assert "Python" not in out._jdf.queryExecution().toString()
    assert {list(cases)[r["i"]]: r["s"] for r in out.collect()} == cases
    assert [jsonx.readable(k) for k in cases] == [v is not None for v in cases.values()]
    long = "[" + ", ".join(f'{{"id": {i}, "t": "x{{{i}"}}' for i in range(3000)) + ', {"id": '
    assert len(one(spark, jsonx.salvage(F.col("a")), a=long)) == 3000


def test_paragraphs(spark):
    assert one(spark, text.paragraphs(F.col("a")), a=" 0 first \n\n10 second\n   \n12 of 12 ") == ["0 first", "10 second", "12 of 12"]

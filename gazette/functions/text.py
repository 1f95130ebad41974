"""Text functions as column expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of importance, in Korean and English, by subject.
IMPORTANT = {
    "critical": ["전쟁", "사망", "사고", "재난", "붕괴", "폭발", "화재", "지진", "태풍", "위기", "비상", "긴급", "경보", "파산", "부도", "폐쇄", "중단", "금리", "인상", "인하", "정책", "법안", "통과", "탄핵", "사퇴", "북한", "미사일", "핵", "테러", "감염", "확진", "팬데믹"]
    + ["war", "death", "accident", "disaster", "collapse", "explosion", "fire", "earthquake", "crisis", "emergency", "urgent", "alert", "bankruptcy", "shutdown", "suspended"]
    + ["interest rate", "policy", "bill", "impeachment", "resignation", "missile", "nuclear", "terror", "pandemic", "outbreak", "conflict"],
    "economic": ["금리", "환율", "주가", "폭락", "급등", "GDP", "실업률", "인플레이션", "경기침체", "부동산", "가격", "상승", "하락", "무역", "적자", "흑자"]
    + ["interest rate", "exchange rate", "stock", "crash", "surge", "GDP", "unemployment", "inflation", "recession", "real estate", "price", "trade", "deficit", "surplus"],
    "political": ["대통령", "국회", "법안", "선거", "투표", "정책", "개혁", "논란", "탄핵", "사퇴", "임명", "해임", "여당", "야당", "정부"]
    + ["president", "congress", "parliament", "bill", "election", "vote", "policy", "reform", "controversy", "impeachment", "resignation", "appointment", "government"],
}
# Keywords of articles on artificial intelligence.
AI_WORDS = ["인공지능", "AI", "생성형", "챗봇", "거대언어모델", "딥러닝", "머신러닝", "LLM", "GPT", "오픈AI", "앤스로픽", "제미나이", "클로드", "코파일럿"] + [
    "artificial intelligence", " ai ", "chatbot", "large language model", "deep learning", "machine learning", "llm", "gpt", "openai", "anthropic", "gemini", "claude", "copilot"
]
# Labels of AI subtypes and the badge of important items.
AI_LABELS = {"release": "신규 모델 출시", "pricing": "가격 정책 변경", "policy": "정책/약관 변경", "industry_shift": "산업 동향"}
BADGE = '<span class="badge badge-important">⚠️ 중요</span>'
# Fixed value: titles of routine bulletins.
BULLETIN = r"^\s*[0-9]{1,2}월\s*[0-9]{1,2}일\s*(궂긴\s*소식|인사|동정|부고|알림|일정)\s*$"
# A description that only wraps a link and a source name; a word of a title.
WRAPPER = r"(?is)^\s*<a[^>]*>.*?</a>\s*(?:&nbsp;)+\s*<font[^>]*>.*?</font>\s*$"
TOKEN = "[가-힣A-Za-z0-9]{2,}"
#: The first sentence or line of a text.
FIRST = r"^[ \t\r\n]*([^\n.!?]*[.!?]?)"
# Fixed value: what ends a sentence, in Korean too.
ENDS = r"[.!?]|다\s|음\s|죠\s"


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: What may be an entity behind an ampersand, as HTML's own rules have it.
_ENTITY = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that HTML also reads without a semicolon, so that other letters may follow; all of them are short.
_SHORT = {k: v for k, v in html5.items() if not k.endswith(";")}
#: Numbers that stand for other characters: those of Windows' code page, as far as it has them, and two more.
_NUMBERS = {0: "\ufffd", 13: "\r"} | {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}

def _literal(pairs: dict) -> Column:
    """A map of texts as one literal, which the optimizer parses once."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def decoded(c: Column) -> Column:
    """Entities decoded where there are any: the text is cut at ampersands, and each piece's begin looked up."""

    def numbered(found: Column) -> Column:
        digits = F.regexp_replace(found, "^#[xX]?0*|;$", "")
        hexed = found.rlike("^#[xX]")
        # More digits than any character takes are too many, whatever they say.
        value = F.when(digits == "", F.lit("0")).when(F.length(digits) > 9, F.lit("2000000")).when(hexed, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        one = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
        nothing = value.between(1, 8) | (value == 11) | value.between(14, 31) | value.between(127, 159) | value.between(64976, 65007) | (value % 65536 >= 65534)
        beyond = value.between(0xD800, 0xDFFF) | (value > 0x10FFFF)
        return F.coalesce(F.element_at(_literal(_NUMBERS), value.cast("string")), F.when(beyond, "\ufffd").when(nothing, "").otherwise(one))

    def named(found: Column) -> Column:
        longest = max(map(len, _SHORT))
        tries = [F.when(F.length(found) > k, F.concat(F.element_at(_literal(_SHORT), F.left(found, F.lit(k))), F.substr(found, F.lit(k + 1)))) for k in range(longest, 1, -1)]
        return F.coalesce(F.element_at(_literal(html5), found), *tries, F.concat(F.lit("&"), found))

    def piece(p: Column) -> Column:
        found = F.regexp_extract(p, _ENTITY, 1)
        text = F.when(found == "", "&").when(found.startswith("#"), numbered(found)).otherwise(named(found))
        return F.concat(text, F.substr(p, F.length(found) + 1))

    pieces = F.split(c, "&", -1)
    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), piece)
    return F.when(c.contains("&"), F.concat(pieces[0], F.array_join(rest, ""))).otherwise(c)


def strip_tags(c: Column) -> Column:
    """Without tags; a mere link wrapper is empty, a null too."""
    c = blank_if_null(c)
    return F.when(c.rlike(WRAPPER), "").otherwise(F.regexp_replace(c, r"<[^<]+?>", ""))


def clean_html(c: Column) -> Column:
    return decoded(strip_tags(c))


def strip_suffix(title: Column) -> Column:
    """Without the " - source" that aggregators append to titles."""
    return strip(F.regexp_replace(blank_if_null(title), r"\s+-\s+[^-]{1,30}$", ""))


def strip_title_prefix(summary: Column, title: Column) -> Column:
    """A summary that begins with the title loses it, and the marks that part them."""
    t, s = strip(title), strip(summary)
    rest = strip(F.regexp_replace(F.substring(s, F.length(t) + 1, F.length(s)), "^[ \\u00a0\\-–—:·]+", ""))
    return F.when((F.length(summary) > 0) & (F.length(t) > 0) & F.startswith(s, t), rest).otherwise(summary)


def first_sentence(c: Column) -> Column:
    """A text's first sentence or line, with the mark that ends it: the title of texts that have none."""
    return F.regexp_extract(blank_if_null(c), FIRST, 1)


def after_first_sentence(c: Column) -> Column:
    """The rest of a text behind its first sentence or line."""
    c = blank_if_null(c)
    return F.substring(c, F.length(F.regexp_extract(c, FIRST, 0)) + 1, F.length(c))


def normalize_title(c: Column) -> Column:
    """Letters and digits of the lower-cased title; what titles are compared by."""
    return F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}]+", "")


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(blank_if_null(c), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Different runs of Hangul, Latin letters and digits of two or more characters, case kept."""
    return F.array_distinct(F.regexp_extract_all(blank_if_null(c), F.lit(TOKEN), F.lit(0)))


def trim_at_boundary(c: Column, limit: int) -> Column:
    """At most limit characters, up to a sentence's end if it leaves half, else to a word's end, and an ellipsis."""
    t = strip(blank_if_null(c))
    window = F.substring(t, 1, limit)
    sentence = F.regexp_extract(window, r"(?s)^(.*(?:[.!?]\s|[다요]\.$))", 1)
    words = F.regexp_extract(window, r"(?s)^(.*) ", 1)
    kept = F.when(window.contains(" ") & (F.length(words) >= limit * 0.5), words).otherwise(window)
    entity = lambda x: F.regexp_replace(x, r"&[#a-zA-Z0-9]{0,7}$", "")
    cut = F.when((F.length(sentence) > 0) & (F.length(sentence) >= limit * 0.5), entity(strip(sentence))).otherwise(F.concat(entity(F.regexp_replace(kept, "[ ,·-]+$", "")), F.lit("…")))
    return F.when(F.length(t) <= limit, t).otherwise(cut)


def _holds_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text holds one of the words, in any place: plain searches, which a regular expression of a hundred words is far slower than.

    Lower-casing the text once, in a lambda, was measured slower: lambdas are interpreted, this is compiled.
    """
    low = F.lower(text)
    found = F.lit(False)
    for w in dict.fromkeys(x.lower() for x in words):
        found = found | low.contains(w)
    return found


def is_important(title: Column, summary: Column) -> Column:
    return _holds_any(F.concat(blank_if_null(title), F.lit(" "), blank_if_null(summary)), [w for x in IMPORTANT.values() for w in x])


def is_ai_related(title: Column, summary: Column) -> Column:
    return _holds_any(F.concat(F.lit(" "), blank_if_null(title), F.lit(" "), blank_if_null(summary), F.lit(" ")), AI_WORDS)


def ai_label(subtype: Column) -> Column:
    """The label of a subtype; an unknown one is its own label."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in AI_LABELS.items() for x in kv]), subtype), subtype)


def badge(important: Column) -> Column:
    return F.when(important, BADGE).otherwise("")


def is_bulletin(title: Column) -> Column:
    return blank_if_null(title).rlike(BULLETIN)


def escape_message(c: Column) -> Column:
    """For messages with mark-up: &, < and >."""
    c = F.replace(blank_if_null(c), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_html(c: Column) -> Column:
    """For pages: quotes too."""
    return F.replace(F.replace(escape_message(c), F.lit('"'), F.lit("&#34;")), F.lit("'"), F.lit("&#39;"))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(blank_if_null(c), "\n"), lambda p: F.trim(p)), lambda p: p != "")


def prose_score(c: Column) -> Column:
    """Ends of sentences for each hundred characters."""
    return F.regexp_count(blank_if_null(c), F.lit(ENDS)) / F.greatest(F.length(blank_if_null(c)) / 100.0, F.lit(1.0))


def needs_body(summary: Column) -> Column:
    """Whether a summary is short, or cut off."""
    s = strip(blank_if_null(summary))
    return (F.length(s) < 300) | F.endswith(s, F.lit("...")) | F.endswith(s, F.lit("…"))


def wrap(c: Column, width: int, lines: int) -> Column:
    """Lines of width characters, the last of them with an ellipsis if text is left over."""

    def cut(t: Column) -> Column:
        parts = F.filter(F.array(*[F.substring(t, i * width + 1, width) for i in range(lines)]), lambda x: x != "")
        last = F.concat(F.substring(t, (lines - 1) * width + 1, width - 1), F.lit("…"))
        return F.when(F.length(t) > width * lines, F.concat(F.slice(parts, 1, lines - 1), F.array(last))).otherwise(parts)

    return F.transform(F.array(one_line(c)), cut)[0]  # a single-element array, so that the text is put on one line once

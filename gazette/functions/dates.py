"""Date functions as column expressions. Presentation time is Korean; everything else is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Seoul"
WEEKDAYS = ("월", "화", "수", "목", "금", "토", "일")
# Where pages state when they were published.
PUBLISHED = (
    r"(?i)article:published_time[\"'][^>]*?content=[\"']([^\"']+)",
    r"(?i)content=[\"']([^\"']+)[\"'][^>]*?article:published_time",
    r"(?i)[\"']datePublished[\"']\s*:\s*[\"']([^\"']+)",
)


def parse_date(c: Column) -> Column:
    """RFC 822 (weekday and offset may be missing: UTC) or ISO 8601; null if it is neither."""
    s = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*[A-Za-z]{3,9},\s*", ""))
    s = F.regexp_replace(F.regexp_replace(s, r"\s+(?:GMT|UTC|UT|Z)$", " +0000"), r"([0-9]{2}:[0-9]{2}(?::[0-9]{2})?)$", "$1 +0000")
    rfc = [F.try_to_timestamp(s, F.lit(f"d MMM {y} HH:mm{sec} Z")) for y in ("yyyy", "yy") for sec in (":ss", "")]
    iso = F.try_to_timestamp(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(s.rlike("^[0-9]{1,2} [A-Za-z]{3} [0-9]{4} "), F.coalesce(rfc[0], rfc[1])).when(s.rlike("^[0-9]{1,2} [A-Za-z]{3} [0-9]{2} "), F.coalesce(rfc[2], rfc[3])).otherwise(iso)


def choose_date(parsed: Column, raw: Column, anchor: Column, index: Column) -> Column:
    """published and is_approximate: the parsed date, else the raw string's, else the feed's time less a minute for each place."""
    exact = F.coalesce(parsed, parse_date(raw))
    return F.struct(F.coalesce(exact, F.timestamp_add("MINUTE", -index, anchor)).alias("published"), exact.isNull().alias("is_approximate"))


def page_published(html: Column) -> Column:
    found = F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in PUBLISHED])
    return F.try_to_timestamp(F.trim(found))


def local(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, ZONE)


def local_minute(ts: Column) -> Column:
    return F.date_format(local(ts), "yyyy-MM-dd HH:mm")


def local_day(ts: Column) -> Column:
    """2026년 08월 14일 (금)"""
    day = F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.weekday(local(ts)) + 1)
    return F.concat(F.date_format(local(ts), "yyyy년 MM월 dd일 ("), day, F.lit(")"))


def rfc822(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss Z")


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")

"""RSS and Atom feeds as a Spark data source: one partition for each feed, which fails alone."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gazette.functions import dates, text, urls
from gazette.sources.fetch import fetch

SCHEMA = "source_seq int, feed_seq int, entry_seq int, title string, link string, description string, date string, feed_date string"
_NAMES = {"title": "title", "description": "description", "summary": "description", "encoded": "content", "pubDate": "date", "published": "date", "updated": "updated", "date": "date", "link": "link"}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parse_feed(data: bytes, limit: int) -> list[dict]:
    """The first entries of a feed; no rows if it is not well-formed, or declares entities of its own."""
    if b"<!ENTITY" in data:
        return []
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return []
    channel = root.find("channel") if root.find("channel") is not None else root
    stamp = next((x.text for n in ("lastBuildDate", "pubDate", "updated") for x in channel if _local(x.tag) == n and x.text), None)
    out = []
    for item in (x for x in root.iter() if _local(x.tag) in ("item", "entry")):
        if len(out) >= limit:
            break
        row: dict = {"feed_date": stamp}
        for x in item:
            name = _NAMES.get(_local(x.tag))
            if name == "link":
                value = (x.text or "").strip() or x.get("href")
            else:
                value = "".join(x.itertext())
            if name and value and not row.get(name):
                row[name] = value
        out.append(row)
    return out


class FeedPartition(InputPartition):
    def __init__(self, feed: dict):
        self.feed = feed


class FeedReader(DataSourceReader):
    def __init__(self, options):
        self.feeds, self.timeout = json.loads(options["feeds"]), float(options.get("timeout", 10))

    def partitions(self):
        return [FeedPartition(f) for f in self.feeds]

    def read(self, partition):
        f = partition.feed
        try:
            data = fetch(f["url"], self.timeout)
        except Exception:  # a feed that cannot be had gives no entries, and the others theirs
            return
        for i, row in enumerate(parse_feed(data, f["limit"])):
            yield (f["source_seq"], f["feed_seq"], i, row.get("title"), row.get("link"), row.get("description"), row.get("date") or row.get("updated"), row.get("feed_date"))


class FeedSource(DataSource):
    """spark.read.format("gazette_feeds").option("feeds", json)"""

    @classmethod
    def name(cls):
        return "gazette_feeds"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FeedReader(self.options)


def read_feeds(spark: SparkSession, feeds: DataFrame) -> DataFrame:
    """Entries of all feeds of the registry (some dozens of rows), as they stand."""
    spark.dataSource.register(FeedSource)
    rows = feeds.select("source_seq", "feed_seq", "url", F.col("entry_limit").alias("limit")).collect()
    return spark.read.format("gazette_feeds").option("feeds", json.dumps([r.asDict() for r in rows])).load()


_FEED = "channel struct<lastBuildDate string, item array<struct<title string, link string, description string, pubDate string>>>, broken string"


def read_saved(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    """entry_seq, title, link, description, date, feed_date, broken of saved RSS files, parsed by Spark's own XML reader, with the columns that the folder's names give.

    A file that is not well-formed has one row with its text as broken, and no entries.
    """
    raw = spark.read.format("xml").option("rowTag", "rss").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").schema(_FEED).load(folder)
    item = F.slice("channel.item", 1, limit)
    own = [c for c in raw.columns if c not in ("channel", "broken")]
    each = raw.select(*own, F.posexplode_outer(item).alias("entry_seq", "i"), F.col("channel.lastBuildDate").alias("feed_date"), "broken")
    return each.where("entry_seq IS NOT NULL OR broken IS NOT NULL").select(*own, "entry_seq", "i.title", F.trim("i.link").alias("link"), "i.description", F.col("i.pubDate").alias("date"), "feed_date", "broken")


def articles(entries: DataFrame, feeds: DataFrame, now) -> DataFrame:
    """Entries as articles: cleaned, dated, with the language, region and category of their feed. now: a timestamp column."""
    title = text.strip_suffix(text.decoded(F.coalesce("title", F.lit(""))))
    one = entries.join(F.broadcast(feeds), ["source_seq", "feed_seq"]).withColumns({"_title": title, "_summary": text.clean_html(F.col("description"))})
    dated = dates.choose_date(F.lit(None).cast("timestamp"), F.col("date"), F.coalesce(dates.parse_date(F.col("feed_date")), now), F.col("entry_seq"))
    summary = text.strip_title_prefix(F.col("_summary"), F.col("_title"))
    seq = (F.col("source_seq") * 1000 + F.col("feed_seq")).cast("long") * 1000 + F.col("entry_seq")
    out = one.select("*", dated.alias("_d")).select(
        seq.alias("article_seq"), "category", "region", "language", "source_id", "source", F.col("_title").alias("title"), urls.guarded(F.trim(F.coalesce("link", F.lit("")))).alias("link"),
        F.col("_d.published").alias("published"), F.col("_d.is_approximate").alias("date_is_approximate"), F.coalesce(F.nullif(summary, F.lit("")), F.substring("_title", 1, 200)).alias("summary"),
    )
    return out.withColumn("canonical_link", urls.canonical(F.col("link")))


def liveness(entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """Feeds with the number of their entries, and whether they are alive."""
    n = entries.groupBy("source_seq", "feed_seq").agg(F.count(F.lit(1)).alias("entries"))
    return feeds.join(n, ["source_seq", "feed_seq"], "left").withColumn("entries", F.coalesce("entries", F.lit(0))).withColumn("alive", F.col("entries") > 0)

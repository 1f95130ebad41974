"""Daily snapshots in a tree of YYYY/MM/DD.json, in either of their shapes."""

from __future__ import annotations

import codecs
import datetime as dt
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from gazette.functions import jsonx, urls

ARTICLE = "struct<title:string,link:string,published:string,summary:string,source:string,category:string,is_important:boolean>"
PICK = "struct<symbol:string,name:string,price:double,reason:string,daily_change_pct:double,weekly_change_pct:double,monthly_change_pct:double,volume_ratio:double>"
_SHAPE = f"date string, categories map<string,string>, stock_picks map<string,map<string,array<{PICK}>>>"


#: Bytes of a file that are read at once; characters of the articles that a row holds, about.
READ, PIECE = 4 << 20, 1 << 20
_JSON = json.JSONDecoder()


class _Text:
    """A stream of JSON text, of which as much is held as its next value takes."""

    def __init__(self, stream, text: bytes):
        self.stream, self.decoder, self.at, self.ended = stream, codecs.getincrementaldecoder("utf-8")("replace"), 0, False
        self.text = self.decoder.decode(text)

    def more(self) -> bool:
        if self.ended:
            return False
        self.text, self.at = self.text[self.at :], 0
        got = self.stream.read(max(READ, len(self.text)))
        self.ended = not got
        self.text += self.decoder.decode(got, final=self.ended)
        return True

    def peek(self) -> str:
        while True:
            rest = self.text[self.at : self.at + 64]
            self.at += len(rest) - len(rest.lstrip(" \t\r\n"))
            if rest.strip(" \t\r\n"):
                return self.text[self.at]
            if not rest and not self.more():
                raise ValueError("the text ends too early")

    def take(self, any_of: str) -> str:
        c = self.peek()
        if c not in any_of:
            raise ValueError(f"{c} where one of {any_of} is due")
        self.at += 1
        return c

    def value(self) -> str:
        """The next value as it stands."""
        self.peek()
        while True:
            try:
                end = _JSON.raw_decode(self.text, self.at)[1]
                if end < len(self.text) or not self.more():  # a number may go on
                    own, self.at = self.text[self.at : end], end
                    return own
            except ValueError:
                if not self.more():
                    raise

    def entries(self) -> Iterator[str]:
        """The keys of an object as they stand; after each its value must be taken."""
        self.take("{")
        if self.peek() == "}":
            self.take("}")
            return
        while True:
            if self.peek() != '"':
                raise ValueError("no key")
            key = self.value()
            self.take(":")
            yield key
            if self.take(",}") == "}":
                return

    def elements(self) -> Iterator[str]:
        self.take("[")
        if self.peek() == "]":
            self.take("]")
            return
        while True:
            yield self.value()
            if self.take(",]") == "]":
                return


def _pieces(stream, text: bytes) -> Iterator[tuple[str, int]]:
    """A snapshot as several smaller ones: the articles of a category in lists, each with the place that it begins at; then all else. ValueError if it is no JSON."""
    t = _Text(stream, text)
    other, there = [], False
    for key in t.entries():
        if json.loads(key) != "categories" or t.peek() != "{":
            other.append(f"{key}:{t.value()}")
            continue
        there = True
        for category in t.entries():
            begin, own, size = 0, [], 0
            if t.peek() not in "[{":
                yield f'{{"categories":{{{category}:{t.value()}}}}}', 0
                continue
            for a in t.elements() if t.peek() == "[" else (a for _ in t.entries() for a in t.elements()):
                own.append(a)
                size += len(a)
                if size >= PIECE:
                    yield f'{{"categories":{{{category}:[{",".join(own)}]}}}}', begin
                    begin, own, size = begin + len(own), [], 0
            if own:
                yield f'{{"categories":{{{category}:[{",".join(own)}]}}}}', begin
    if there:
        yield "{" + ",".join([*[o for o in other if not o.startswith('"categories":')], '"categories":{}']) + "}", 0


def _snapshot(store, path: str) -> Iterator[tuple[str, int]]:
    """value, begin: the text of a file, of a large one in pieces; none if a large one is no JSON."""
    with store.open_input_stream(path) as f:
        start = f.read(READ)
        rest = f.read(1) if len(start) == READ else b""
        if not rest:
            yield start.decode(errors="replace"), 0
            return
        try:
            for _ in _pieces(f, start + rest):  # all of it is read before any of it counts
                pass
        except ValueError:
            return
    with store.open_input_stream(path) as f:
        yield from _pieces(f, f.read(READ))


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri in b.column("path").to_pylist():
            store, path = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
            for value, begin in _snapshot(store, path):
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([value]), pa.array([begin], pa.int64())], ["path", "value", "begin"])


class Days(InputPartition):
    def __init__(self, days: list[dt.date]):
        self.days = days


class DayReader(DataSourceReader):
    """The files of the days that a query asks for, by their names: the tree is never listed."""

    def __init__(self, options):
        self.folder, self.tasks = options["path"].rstrip("/"), int(options.get("tasks", 64))
        self.first, self.last, self.only = None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        one = dt.timedelta(days=1)
        for f in filters:
            if getattr(f, "attribute", None) != ("date",):
                yield f
            elif isinstance(f, (EqualTo, In)):
                days = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = days if self.only is None else self.only & days
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                begin = f.value + one if isinstance(f, GreaterThan) else f.value
                self.first = begin if self.first is None else max(self.first, begin)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                end = f.value - one if isinstance(f, LessThan) else f.value
                self.last = end if self.last is None else min(self.last, end)
            else:
                yield f

    def days(self) -> list[dt.date]:
        if self.only is None and (self.first is None or self.last is None):
            raise ValueError("days are read by their names: ask for a first and a last date, or for some dates")
        if self.only is None:
            return [self.first + dt.timedelta(days=k) for k in range((self.last - self.first).days + 1)]
        return sorted(d for d in self.only if d and (self.first is None or d >= self.first) and (self.last is None or d <= self.last))

    def partitions(self) -> list[Days]:
        days = self.days()
        size = max(1, -(-len(days) // self.tasks))
        return [Days(days[k : k + size]) for k in range(0, len(days), size)] or [Days([])]

    def read(self, partition: Days) -> Iterator[tuple]:
        store, base = pyarrow.fs.FileSystem.from_uri(self.folder)
        for day in partition.days:
            try:
                for value, begin in _snapshot(store, f"{base}/{day:%Y/%m/%d}.json"):
                    yield day, value, begin
            except FileNotFoundError:  # no edition on that day
                continue


class DaySource(DataSource):
    """spark.read.format("gazette_days").load(folder): date, value, begin (rows of _snapshot()) of YYYY/MM/DD.json; a query must bound the dates."""

    @classmethod
    def name(cls):
        return "gazette_days"

    def schema(self):
        return "date date, value string, begin long"

    def reader(self, schema):
        return DayReader(self.options)


def read_days(spark: SparkSession, folder: str, first: dt.date, last: dt.date) -> DataFrame:
    """read() of the days from first to last, of which nothing but their own files is opened; folder is a URI."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DaySource)
    raw = spark.read.format("gazette_days").load(folder).where(F.col("date").between(F.lit(first), F.lit(last)))
    return raw.select("date", "begin", F.from_json("value", _SHAPE).alias("s")).where("s.categories is not null").select("date", "s.categories", "s.stock_picks", "begin")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """date, categories (JSON text by category), stock_picks, begin of each snapshot; files with other names or without valid JSON are left out.

    A large file comes in several rows, each with a part of a category's articles and the place (begin) of its first one.
    """
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder).select("path")
    raw = paths.where(r"path rlike '/[0-9]{4}/[0-9]{2}/[0-9]{2}\\.json$'").mapInArrow(_files, "path string, value string, begin long")
    day = F.regexp_extract("path", r"/([0-9]{4}/[0-9]{2}/[0-9]{2})\.json$", 1)
    named = raw.withColumn("d", F.nullif(day, F.lit(""))).select("begin", F.expr("try_to_date(d, 'yyyy/MM/dd')").alias("date"), F.from_json("value", _SHAPE).alias("s"))
    return named.where("date is not null and s.categories is not null").select("date", "s.categories", "s.stock_picks", "begin")


def articles(snapshots: DataFrame) -> DataFrame:
    """date, category, seq and the fields of each article."""
    begin = F.col("begin") if "begin" in snapshots.columns else F.lit(0)
    one = snapshots.select("date", begin.alias("begin"), F.explode("categories").alias("category", "entry"))
    flat = one.select("date", "category", "begin", F.posexplode(jsonx.flattened(F.col("entry"), ARTICLE)).alias("seq", "a"))
    return flat.select("date", "category", (F.col("seq") + F.col("begin")).cast("long").alias("seq"), "a.title", "a.summary", "a.source", "a.link", "a.published", "a.is_important")


def picks(snapshots: DataFrame) -> DataFrame:
    """year_month, date, market, horizon, symbol, name, reason, price_at_pick of each pick."""
    one = snapshots.select("date", F.explode("stock_picks").alias("market", "h")).select("date", "market", F.explode("h").alias("horizon", "p")).select("date", "market", "horizon", F.explode("p").alias("p"))
    return one.select(F.date_format("date", "yyyy-MM").alias("year_month"), F.date_format("date", "yyyy-MM-dd").alias("date"), "market", "horizon", "p.symbol", "p.name", "p.reason", F.col("p.price").alias("price_at_pick"))


def recent_links(snapshots: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """canonical_link, date of articles of the days before today."""
    return links(snapshots.where((F.col("date") < today) & (F.col("date") >= F.date_sub(today, days))))


def links(snapshots: DataFrame) -> DataFrame:
    """canonical_link, date of the articles of snapshots."""
    return articles(snapshots).select(urls.canonical(F.col("link")).alias("canonical_link"), "date").where("canonical_link <> ''").distinct()


def links_before(spark: SparkSession, folder: str, today: dt.date, days: int = 7) -> DataFrame:
    """links() of the days before today, by opening their files alone."""
    return links(read_days(spark, folder, today - dt.timedelta(days=days), today - dt.timedelta(days=1)))

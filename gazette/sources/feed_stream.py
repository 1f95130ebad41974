"""Feeds as a streaming source: each poll gives the entries that earlier ones did not have, also when a batch is run again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from gazette.sinks.files import put_in_place
from gazette.sources.fetch import fetch
from gazette.sources.rss import SCHEMA, parse_feed

#: Polls of a feed whose entries are known; an entry that is gone for longer counts as new again.
KEEP = 16


class Polls(InputPartition):
    def __init__(self, feed: dict, polls: list[int]):
        self.feed, self.polls = feed, polls


class FeedStreamReader(DataSourceStreamReader):
    """The offset is the number of the last poll. What a poll found is kept in a folder that all machines share before any of
    it is given on, so a batch that is run again gives the same entries, whatever the feed says by then."""

    def __init__(self, options):
        self.feeds, self.timeout, self.folder = json.loads(options["feeds"]), float(options.get("timeout", 10)), options["kept"].rstrip("/")

    def _store(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.folder)

    @staticmethod
    def _numbers(store: pyarrow.fs.FileSystem, folder: str) -> list[int]:
        found = store.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
        return sorted(int(f.base_name[:9]) for f in found if f.base_name[:9].isdigit())

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        """Another poll, whose number is noted so that no later one gets it."""
        store, base = self._store()
        store.create_dir(f"{base}/polls")
        polls = self._numbers(store, f"{base}/polls")
        poll = polls[-1] + 1 if polls else 1
        with store.open_output_stream(f"{base}/polls/{poll:09d}") as out:
            out.write(b"")
        for old in polls[:-1]:
            store.delete_file(f"{base}/polls/{old:09d}")
        return {"poll": poll}

    def partitions(self, start: dict, end: dict) -> list[Polls]:
        polls = list(range(start["poll"] + 1, end["poll"] + 1))
        return [Polls(f, polls) for f in self.feeds] if polls else []

    def read(self, partition: Polls) -> Iterator[tuple]:
        store, base = self._store()
        f = partition.feed
        own = f"{base}/{f['source_seq']}-{f['feed_seq']}"
        for poll in partition.polls:
            entries = self._kept(store, own, poll) or self._polled(store, own, poll, f)
            known = {self._key(e) for n in self._numbers(store, own) if n < poll for e in self._kept(store, own, n) or []}
            for i, e in enumerate(entries):
                if self._key(e) not in known:
                    known.add(self._key(e))
                    yield (f["source_seq"], f["feed_seq"], i, e.get("title"), e.get("link"), e.get("description"), e.get("date") or e.get("updated"), e.get("feed_date"))

    def commit(self, end: dict) -> None:
        store, base = self._store()
        for f in self.feeds:
            own = f"{base}/{f['source_seq']}-{f['feed_seq']}"
            for n in self._numbers(store, own):
                if n <= end["poll"] - KEEP:
                    store.delete_file(f"{own}/{n:09d}.json")

    @staticmethod
    def _key(entry: dict) -> str:
        return entry.get("link") or entry.get("title") or ""

    @staticmethod
    def _kept(store: pyarrow.fs.FileSystem, own: str, poll: int) -> list[dict] | None:
        try:
            with store.open_input_stream(f"{own}/{poll:09d}.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def _polled(self, store: pyarrow.fs.FileSystem, own: str, poll: int, feed: dict) -> list[dict]:
        """What the feed has now; nothing if it cannot be had, which leaves the others theirs."""
        try:
            entries = parse_feed(fetch(feed["url"], self.timeout), feed["limit"])
        except Exception:
            entries = []
        store.create_dir(own)
        temporary = f"{own}/.{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as out:
            out.write(json.dumps(entries).encode())
        if (before := self._kept(store, own, poll)) is not None:  # another attempt was first
            store.delete_file(temporary)
            return before
        put_in_place(store, temporary, f"{own}/{poll:09d}.json")
        return entries


class FeedStream(DataSource):
    """spark.readStream.format("gazette_feed_stream").option("feeds", json).option("kept", folder)"""

    @classmethod
    def name(cls):
        return "gazette_feed_stream"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return FeedStreamReader(self.options)


def feed_stream(spark: SparkSession, feeds: DataFrame, kept: str) -> DataFrame:
    """New entries of all feeds of the registry (some dozens of rows), poll by poll; kept: a folder (a URI) that all machines share."""
    spark.dataSource.register(FeedStream)
    rows = feeds.select("source_seq", "feed_seq", "url", F.col("entry_limit").alias("limit")).collect()
    return spark.readStream.format("gazette_feed_stream").option("feeds", json.dumps([r.asDict() for r in rows])).option("kept", kept).load()

"""Phrases whose words keep company, mined from a corpus.

Texts are split into pieces, and equal pieces of a language become one with a
multiplicity: all later work is on different pieces. Their n-grams, weighted by it,
are counted in hash buckets: each task adds up what it has, sends every bucket its
share, and a bucket's task streams all shares through DuckDB, whose aggregate goes to
disk when memory is full. That happens three times: hashes of one and two words;
hashes of three and more words, of which all pairs were frequent; and the words themselves of
whatever may be frequent, which gives the exact counts (the hashes only decide what
is counted then, and a collision only lets more through). Every candidate asks for
the counts of its parts: requests are shuffled to the counts, answers back to the
candidate, together with what longer candidates report of the phrases inside them.

Defined cases. Null or empty text: no pieces. Null language: `und`, together with
those named so. Repeated rows: each counts. Ties: scores and counts that are equal go
by the phrase's bytes. Empty table: empty result. doc_id and other columns are
ignored, whatever their names. Texts of any length are read whole.
"""

from __future__ import annotations

import shutil
import string
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.common import FILTER_BITS, collected_filter, text_of, tidy
from gazette.llm.words import gathered, hashes, mixed, places, text_bytes
from gazette.staging import discard, stage

#: Bytes of pieces that a task adds up before it sends, and words of all pieces that a bucket has on average at most.
SHARE, BUCKET_WORDS = 8 << 20, 4_000_000
#: Memory of a bucket's aggregate, behind which it goes to disk.
MEMORY = "256MB"
#: Rows of a language are ranked in so many parts first.
PARTS = 64


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (lower-case words joined by one space), n (how often it stands in docs)."""
    low = F.translate(text_of(), string.ascii_uppercase, string.ascii_lowercase)
    one = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(low, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    clean = one.select("lang", F.btrim(F.regexp_replace("piece", r"[\x20\x09]+", " ")).alias("piece")).where("piece <> ''")
    return clean.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("n"))


def _may(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = (keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


class _Grams:
    """The n-grams of a table of pieces: hashes by number of words, and where they may begin."""

    def __init__(self, table: pa.Table, longest: int):
        lang = table.column("lang").combine_chunks().dictionary_encode()
        seeds = np.array([xxhash.xxh64_intdigest(x) for x in lang.dictionary.to_pylist()], np.uint64)
        self.data, at = text_bytes(table.column("piece").combine_chunks())
        self.begins, self.ends, piece = places(self.data, at)
        self.lang, self.names = lang.indices.to_numpy()[piece], lang.dictionary.to_pylist()
        self.weight = table.column("n").to_numpy()[piece]
        self.words = hashes(self.data, self.begins, self.ends)
        self.of = {1: mixed(seeds[self.lang], self.words)}
        self.room = np.searchsorted(piece, piece, "right") - np.arange(len(piece))  # words from here to the piece's end
        for n in range(2, longest + 1):
            self.of[n] = mixed(self.of[n - 1][:-1], self.words[n - 1 :]) if len(self.of[n - 1]) else self.of[n - 1]

    def fitting(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.room[: len(self.of[n])] >= n)

    def pairs_may(self, n: int, bits: np.ndarray) -> np.ndarray:
        """Begins of n-grams all of whose pairs of words may be frequent."""
        pair = np.zeros(len(self.of[2]), bool)
        here = self.fitting(2)
        pair[here] = _may(bits, self.of[2][here])
        good = self.fitting(n)
        for k in range(n - 1):
            good = good[pair[good + k]]
        return good


def _summed(keys: np.ndarray, weights: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, their weights' sums, and one place of each; keys whose checks differ are different."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    if check is not None and (~new[1:] & (check[order[1:]] != check[order[:-1]])).any():
        order = np.lexsort((check, keys))
        new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
    first = np.flatnonzero(new)
    return keys[order[first]], np.add.reduceat(weights[order], first) if len(first) else weights[:0], order[first]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)


def _send(orders: tuple[int, ...], buckets: int, passed):
    """A message to each bucket: different hashes in order, then their weights in as few bytes as they take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, "piece", SHARE):
            grams = _Grams(table, max(orders))
            at = {n: grams.fitting(n) if n < 3 else grams.pairs_may(n, passed.value) for n in orders}
            keys, sums, _ = _summed(np.concatenate([grams.of[n][at[n]] for n in orders]), np.concatenate([grams.weight[at[n]] for n in orders]))
            del grams, at
            cuts = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
            to = np.flatnonzero(np.diff(cuts))
            sent = []
            for k in to:
                own = sums[cuts[k] : cuts[k + 1]]
                own = own.astype(np.min_scalar_type(own.max()))
                sent.append(keys[cuts[k] : cuts[k + 1]].tobytes() + own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.diff(cuts)[to], pa.int64()), pa.array(sent, pa.binary())], ["bucket", "rows", "message"])
        tidy()

    return run


def _opened(message: bytes, n: int) -> pa.RecordBatch:
    size = len(message) // n - 8
    return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(message, "<u8", n)), pa.array(np.frombuffer(message, f"<u{size}", n, 8 * n).astype(np.int64))], ["k", "n"])


def _aggregated(shares: Iterator[pa.RecordBatch], schema: pa.Schema, keys: str, least: int) -> Iterator[pa.RecordBatch]:
    """Keys whose n add up to least or more, counted by DuckDB; only the aggregate's spill is on this machine's disk, and goes with it."""
    folder = tempfile.mkdtemp(prefix="gazette-counts-")
    base = duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": folder, "preserve_insertion_order": False})
    try:
        shares = pa.RecordBatchReader.from_batches(schema, shares)  # DuckDB finds it by its name
        yield from base.sql(f"SELECT {keys}, sum(n)::BIGINT AS n FROM shares GROUP BY {keys} HAVING sum(n) >= {int(least)}").to_arrow_reader(100_000)
    finally:
        base.close()
        shutil.rmtree(folder, ignore_errors=True)


def _count_hashes(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = (_opened(m.as_py(), n.as_py()) for b in batches for n, m in zip(b.column("rows"), b.column("message")))
        for b in _aggregated(shares, pa.schema([("k", pa.uint64()), ("n", pa.int64())]), "k", least):
            yield pa.RecordBatch.from_arrays([pa.array(b.column("k").to_numpy().view(np.int64))], ["k"])
        tidy()

    return run


PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


def _write_out(longest: int, buckets: int, passed, further):
    """A message to each bucket: the n-grams that may be frequent as compressed Arrow rows, equal ones of a share added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = pa.ipc.IpcWriteOptions(compression="zstd")
        for table in gathered(batches, "piece", SHARE):
            grams = _Grams(table, longest)
            second = hashes(grams.data, grams.begins, grams.ends, 1)
            raw, names = grams.data.tobytes(), np.array(grams.names, object)
            for n in range(1, longest + 1):
                at = grams.fitting(n) if n < 3 else grams.pairs_may(n, passed.value)
                at = at[_may((passed if n < 3 else further).value, grams.of[n][at])]
                check = second[at]
                for k in range(1, n):
                    check = mixed(check, second[at + k])
                keys, sums, one = _summed(grams.of[n][at], grams.weight[at], check)
                at = at[one]
                cuts = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
                to = np.flatnonzero(np.diff(cuts))
                sent = []
                for k in to:
                    own = at[cuts[k] : cuts[k + 1]]
                    phrases = [raw[b:e] for b, e in zip(grams.begins[own].tolist(), grams.ends[own + n - 1].tolist())]
                    rows = [pa.array(names[grams.lang[own]], pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.full(len(own), n, np.int32)), pa.array(sums[cuts[k] : cuts[k + 1]], pa.int64())]
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, PHRASES, options=packed) as stream:
                        stream.write_batch(pa.RecordBatch.from_arrays(rows, schema=PHRASES))
                    sent.append(out.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(sent, pa.binary())], ["bucket", "message"])
            del grams
        tidy()

    return run


def _count_phrases(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = (rows for b in batches for m in b.column("message") for rows in pa.ipc.open_stream(m.as_buffer()))
        yield from _aggregated(shares, PHRASES, "lang, phrase, words", least)
        tidy()

    return run


def frequent_phrases(own: DataFrame, least: int, longest: int) -> DataFrame:
    """lang, phrase, words, n of all n-grams of pieces (lang, piece, n) up to longest words that stand least times or more."""
    spark = own.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = own.agg(F.sum(F.length("piece") - F.length(F.replace("piece", F.lit(" "))) + 1)).first()[0] or 0  # one number
    partitions = max(partitions, -(-total // BUCKET_WORDS))
    buckets = 2 * partitions

    def counted(orders, passed):
        sent = own.mapInArrow(_send(orders, buckets, passed), "bucket int, rows long, message binary")
        return spark.sparkContext.broadcast(collected_filter(sent.repartition(partitions, "bucket").mapInArrow(_count_hashes(least), "k long"), "k"))

    passed = counted((1, 2), None)
    further = counted(tuple(range(3, longest + 1)), passed) if longest > 2 else None
    out = own.mapInArrow(_write_out(longest, buckets, passed, further), "bucket int, message binary")
    return out.repartition(partitions, "bucket").mapInArrow(_count_phrases(least), "lang string, phrase string, words int, n long")


def scored(counts: DataFrame, longest: int, scale: int) -> DataFrame:
    """lang, phrase, a, l, r, score of all candidates, and inside: the largest count of a longer candidate that holds one's words."""
    counts = counts.withColumn("w", F.split("phrase", " "))
    part = lambda begin, size: f"array_join(slice(w, {begin}, {size}), ' ')"
    asked = counts.where("words > 1").select(
        "lang", "phrase", F.col("n").alias("a"),
        F.explode(F.expr(f"flatten(transform(sequence(1, words - 1), k -> array(struct(k, true AS head, {part(1, 'k')} AS part), struct(k, false AS head, {part('k + 1', 'words - k')} AS part))))")).alias("q"),
    ).select("lang", "phrase", "a", "q.*")
    answers = asked.join(counts.select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"]).select("lang", "phrase", "a", "k", "head", "n")
    held = counts.where("words > 2").select("lang", "n", F.explode(F.expr(f"flatten(transform(sequence(2, words - 1), s -> transform(sequence(1, words - s + 1), b -> {part('b', 's')})))")).alias("phrase"))
    held = held.groupBy("lang", "phrase").agg(F.max("n").alias("n")).select("lang", "phrase", F.lit(None).cast("long").alias("a"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("boolean").alias("head"), "n")
    told = [F.max(F.when((F.col("k") == k) & (F.col("head") == head), F.col("n"))).alias(f"{side}{k}") for k in range(1, longest) for side, head in (("l", True), ("r", False))]
    one = answers.unionByName(held).groupBy("lang", "phrase").agg(F.max("a").alias("a"), *told, F.max(F.when(F.col("k").isNull(), F.col("n"))).alias("inside"))
    exact = lambda k: F.expr(f"cast((cast({scale} AS decimal(38, 0)) * a) div (cast(l{k} AS decimal(38, 0)) + r{k}) AS bigint)")
    cuts = [F.when(F.col(f"l{k}").isNotNull(), F.struct(exact(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    return one.select("lang", "phrase", "a", "inside", F.array_min(F.array(*cuts)).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "inside")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, share: int = 80, top: int = 2000, scale: int = 2_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first top phrases of each language of two to longest words.

    A phrase stands least times or more, and goes if a longer one that holds its words stands share of 100 times as often or
    more. Its score is that of its worst cut into two parts: scale * a / (l + r), rounded down.
    """
    own = stage(pieces(docs), "phrase-pieces")
    totals = stage(own.groupBy("lang").agg(F.sum((F.length("piece") - F.length(F.replace("piece", F.lit(" "))) + 1) * F.col("n")).alias("n")), "phrase-totals")
    counts = stage(frequent_phrases(own, least, longest), "phrase-counts")
    discard(own)
    left = scored(counts, longest, scale).where(f"inside IS NULL OR 100 * cast(inside AS decimal(38, 0)) < {share} * cast(a AS decimal(38, 0))")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    best = left.withColumn("_n", F.row_number().over(parts)).where(F.col("_n") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

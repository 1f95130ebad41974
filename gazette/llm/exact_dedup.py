"""Exact deduplication by a Golomb-coded fingerprint exchange.

Every input partition sorts the 48-bit fingerprints of its texts and sends each
owner (a range of fingerprints, OWNED of them at most) the different ones of its share as Golomb-Rice coded gaps,
with a bit for those that it has more than once (exchange.py). The owner
answers with a bitmap of those that occur more than once anywhere. Only rows
marked so, the suspects, have their texts shuffled: a map-side aggregate on
(digest, text) verifies byte by byte that a digest stands for one text, and
collapses the copies within a task before anything moves. Rows without a
suspect's mark never leave their place.

Defined cases. Null text: the empty text. Null doc_id: an ordinary row, chosen as
the one that stays only in a group without any doc_id. Repeated rows and ties on
doc_id: every row counts and exactly one of them stays; of rows that share the doc_id that stays and the normalised text,
drop_exact_duplicates() keeps the first by their columns as JSON. Empty table: empty result.
Other columns are ignored, whatever their names. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import key_filter, mark_possible, text_of
from gazette.llm.exchange import OWNED, PRINT_BITS, answer, marked, questions
from gazette.staging import small_batches, stage

SPACES = r"[\x20\x09-\x0D]+"


ROWS = "kind int, pid int, seq long, doc_id long, sha binary, print long, owner int, prints binary, many binary"


def _send(owners: int):
    """Each row as it is, and after the last one a message to every owner: its share of the sorted fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq, prints = TaskContext.get().partitionId(), 0, []
        names = [x.split()[0] for x in ROWS.split(", ")]
        for b in batches:
            n = b.num_rows
            prints.append(b.column("print").to_numpy(zero_copy_only=False))
            full = lambda v, t: pa.array(np.full(n, v), t)
            yield pa.RecordBatch.from_arrays(
                [full(0, pa.int32()), full(pid, pa.int32()), pa.array(np.arange(seq, seq + n), pa.int64()), b.column("doc_id"), b.column("sha"), b.column("print"), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names
            )
            seq += n
        different, counts = np.unique(np.concatenate(prints), return_counts=True) if prints else (np.zeros(0), np.zeros(0))
        q = questions(different.astype(np.uint64), counts > 1, owners)
        n = len(q["owner"])
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([1] * n, pa.int32()), pa.array([pid] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(q["owner"], pa.int32()), pa.array(q["prints"], pa.binary()), pa.array(q["many"], pa.binary())], names
            )

    return run


def _mark(owners: int):
    """A partition's rows and the bitmaps sent back to it: the rows with the column suspect."""

    def run(rows: pa.Table, maps: pa.Table) -> pa.Table:
        different, place = np.unique(rows.column("print").to_numpy().astype(np.uint64), return_inverse=True)
        hit = marked(different, owners, dict(zip(maps.column("owner").to_pylist(), maps.column("bits").to_pylist())))
        return pa.table({"doc_id": rows.column("doc_id"), "pid": rows.column("pid"), "seq": rows.column("seq"), "sha": rows.column("sha"), "suspect": pa.array(hit[place])})

    return run


def normalised(column: str = "text"):
    return F.regexp_replace(text_of(column), SPACES, " ")


def exchange(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """doc_id, pid and seq (a row's place), sha (of the normalised text), suspect; one row per input row."""
    spark = docs.sparkSession
    owners = owners or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // OWNED))
    small_batches(spark, 2048)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm")).select(
        "doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), F.shiftrightunsigned(F.xxhash64("norm"), 64 - PRINT_BITS).alias("print")
    )
    sent = stage(keyed.mapInArrow(_send(owners), ROWS), "exact-sent", ["kind"])
    maps = sent.where("kind = 1").select("owner", "pid", "prints", "many").groupBy("owner").applyInArrow(answer(owners, "pid"), "pid int, owner int, bits binary")
    rows = sent.where("kind = 0").select("pid", "seq", "doc_id", "sha", "print")
    marked = rows.groupBy("pid").cogroup(maps.groupBy("pid")).applyInArrow(_mark(owners), "doc_id long, pid int, seq long, sha binary, suspect boolean")
    return stage(marked, "exact-marked")


def verified_classes(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """sha, keep_id, group_size, keep (the place of the row that stays) of each group of two or more equal texts."""
    suspects = marked.where("suspect")
    bitmap = stage(key_filter(suspects.select("doc_id"), "doc_id"), "exact-filter")
    near = mark_possible(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), bitmap, "doc_id", "near").where("near")
    texts = near.select(normalised().alias("norm")).select(F.unhex(F.sha2("norm", 256)).alias("sha"), "norm").groupBy("sha", "norm").agg(F.count(F.lit(1)).alias("n"))
    proven = texts.groupBy("sha").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("seen"))
    groups = suspects.groupBy("sha").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("pid"), F.col("seq"))).alias("keep"),
    ).where("group_size > 1")
    one = F.when(F.col("texts") > 1, F.raise_error("two different texts share a SHA-256 digest").cast("long")).otherwise(F.col("group_size"))
    return groups.join(proven, "sha").select("sha", F.col("keep.doc_id").alias("keep_id"), one.alias("group_size"), "keep")


def exact_duplicates(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    marked = exchange(docs, owners)
    # Written, so that the join below reads both sides by an exchange of its own and a hot digest's rows can be split.
    classes = stage(verified_classes(docs, marked), "exact-classes")
    stays = (F.col("keep.pid") == F.col("pid")) & (F.col("keep.seq") == F.col("seq"))
    found = marked.where("suspect").join(classes, "sha", "left")
    alone = marked.where("not suspect")
    out = found.select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(stays, F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    return out.unionByName(
        alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    )


def drop_exact_duplicates(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """The rows of docs that stay, all columns as they are. Texts of rows that are no suspects are not shuffled."""
    marked = exchange(docs, owners)
    classes = stage(verified_classes(docs, marked).select("sha", "keep_id", F.col("keep.none").alias("none")), "exact-classes")
    members = marked.where("suspect").join(classes.select("sha"), "sha", "left_semi")
    bitmap = stage(key_filter(members.select("doc_id"), "doc_id"), "exact-members")
    # Columns of docs go into one struct, so that no name of theirs meets one of ours.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    whole = mark_possible(whole, bitmap, "id", "near")
    near = whole.where("near").withColumn("sha", F.unhex(F.sha2(F.regexp_replace(F.coalesce("row.text", F.lit("")), SPACES, " "), 256)))
    near = near.join(classes, "sha", "left")
    free = near.where("none is null")
    first = near.where("none is not null and id <=> keep_id").groupBy("sha").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return whole.where("not near").select("row.*").unionByName(free.select("row.*")).unionByName(first.select("row.*"))

"""Similarity join of word sets within groups, and the greedy choice over its pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.operators.set_tiles import Tile, may_be_alike, meetings, size_class, unpacked
from gazette.staging import discard, stage


def set_classes(df: DataFrame, group: list[str], id: str, words: str) -> DataFrame:
    """group, words (sorted), rep: the smallest id of each different word set of a group; sets are not empty."""
    own = df.select(*group, id, F.array_sort(F.array_distinct(words)).alias("words")).where("size(words) > 0")
    return own.groupBy(*group, "words").agg(F.min(id).alias("rep"))


#: Members of a tile (2 bytes each), and of groups that share tiles with others; sizes of a tile's sets are within a factor.
TILE, SMALL, SIZES = 1 << 23, 1 << 17, 2.1


def _candidates(threshold: float):
    def compare(pair: pa.Table) -> pa.Table:
        sides = unpacked(pair, np.uint16)
        tiles = [Tile(n, buckets) for _, _, n, buckets in sides]
        (one, tag, *_), (other, tags, *_) = sides[0], sides[-1]
        found = [(np.zeros(0, np.int64),) * 3]
        for x, y in may_be_alike(tiles[0], tiles[1] if len(tiles) > 1 else None, threshold):
            same = tag[x] == tags[y]
            x, y = x[same], y[same]
            found.append((tag[x], np.minimum(one[x], other[y]), np.maximum(one[x], other[y])))
        return pa.table(dict(zip(("tag", "a", "b"), map(np.concatenate, zip(*found)))))

    return compare


def candidate_rows(classes: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """group, a, b of different sets of a group that may reach the threshold, by their words' 16-bit hashes: few others pass.

    Groups are compared tile by tile (operators/set_tiles.py); small ones share tiles. The work is that of all pairs of near
    sizes, but a pair costs a column of a product of matrices, and only pairs that pass are rows. A group that is null in part has no pairs.
    """
    rep = classes.schema["rep"].dataType
    own = classes.dropna(subset=group).select(F.xxhash64(*group).alias("tag"), F.col("rep").cast("long").alias("id"), F.size("words").alias("n"), F.transform("words", lambda w: F.shiftright(F.xxhash64(w), 48).cast("smallint")).alias("members"))
    groups = stage(own.groupBy("tag").agg(F.sum("n").alias("all")), "similar-groups")
    bins = -(-(groups.where(F.col("all") <= SMALL).agg(F.sum("all")).first()[0] or 1) // SMALL)
    small = F.col("all") <= SMALL
    cell = F.when(small, F.pmod("tag", F.lit(bins))).otherwise(F.col("tag"))
    dealt = own.join(groups, "tag").withColumns({"cell": cell, "class": F.when(small, 0).otherwise(size_class(F.col("n"), SIZES))})
    met = meetings(dealt.select("cell", "class", "id", "tag", "n", "members"), threshold, SIZES, TILE, "similar")
    found = met.groupBy("cell", "p", "q", "s", "t").applyInArrow(_candidates(threshold), "tag long, a long, b long")
    names = classes.dropna(subset=group).select(*group).distinct().withColumn("tag", F.xxhash64(*group))
    return found.join(names, "tag").select(*group, F.col("a").cast(rep).alias("a"), F.col("b").cast(rep).alias("b"))


def similar_pairs(classes: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """group, a, b (reps, a < b), jaccard of the different word sets of a group that reach the threshold (above 0).

    Candidates are verified on the words. Nothing is lost, and no group is collected.
    """
    if not hasattr(classes, "staged_at"):
        classes = stage(classes, "similar-sets")
    pairs = stage(candidate_rows(classes, group, threshold), "similar-candidates")
    a, b = (classes.select(*group, F.col("rep").alias(end), F.col("words").alias(f"_{end}")) for end in ("a", "b"))
    both = F.size(F.array_intersect("_a", "_b"))
    found = pairs.join(a, [*group, "a"]).join(b, [*group, "b"]).withColumn("_both", both)
    return found.select(*group, "a", "b", (F.col("_both") / (F.size("_a") + F.size("_b") - F.col("_both"))).alias("jaccard")).where(F.col("jaccard") >= threshold)


def first_kept(pairs: DataFrame, group: list[str]) -> DataFrame:
    """group, b, a: for each node that a greedy pass in the order of ids does not keep, the first kept node beside it; pairs: group, a, b with a < b.

    A node without an undecided smaller neighbour is kept, and its neighbours are not; what is left is looked at again. The
    rounds are as many as the longest chain of decisions that depend on each other, not as the nodes.
    """
    pairs = stage(pairs.select(*group, "a", "b"), "greedy-pairs")
    left, kept, gone = pairs, None, None
    while not left.isEmpty():
        old = [t for t in (left, kept, gone) if t is not None and t is not pairs]
        lower = left.select(*group, F.col("a").alias("node")).distinct().join(left.select(*group, F.col("b").alias("node")).distinct(), [*group, "node"], "left_anti")
        kept = stage(lower if kept is None else kept.unionByName(lower), "greedy-kept")
        gone = stage(pairs.join(kept.withColumnRenamed("node", "a"), [*group, "a"], "left_semi").select(*group, F.col("b").alias("node")).distinct(), "greedy-gone")
        for end in ("a", "b"):
            left = left.join(gone.withColumnRenamed("node", end), [*group, end], "left_anti")
        left = stage(left, "greedy-left")
        discard(*old)
    if gone is None:
        return pairs
    # Whatever no kept node dropped is kept; a pair whose smaller node is kept drops its larger one.
    return pairs.join(gone.withColumnRenamed("node", "a"), [*group, "a"], "left_anti").groupBy(*group, "b").agg(F.min("a").alias("a"))

"""Sets that may be alike, found tile by tile with products of matrices.

The members of a set are counted in buckets. Over as many buckets as a matrix has columns, the product of two sets' counts is
never less than the number of members that they share, so one product of matrices rules out nearly all pairs of two blocks of sets.
What is left is looked up over all BUCKETS buckets, which bounds the shared members once more. No pair that reaches
the threshold is lost, and no row is made for a pair that fails the bounds.

meetings() deals the sets to tiles by collection and size, writes each tile once as one row, and brings together the tiles
whose sizes are near enough. So what is shuffled is packed tiles, at most as often as other tiles can be like them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.staging import stage

#: Buckets of a member: 2 bytes each.
BUCKETS = 1 << 16
#: Sets of a block at most, and counts of its matrix (4 bytes each) at most.
ROWS, COUNTS = 512, 1 << 21
#: Columns for each member of the largest set of a block: so few members then meet by chance that the bound rules out most pairs.
SPREAD = 4
_LOOKED_UP = 1 << 20  # members that are looked up at once


class Tile:
    """Sets in the order of their sizes; at: where they stood in what was given."""

    def __init__(self, sizes: np.ndarray, buckets: np.ndarray):
        self.at = np.argsort(sizes, kind="stable")
        begins = np.cumsum(sizes) - sizes
        self.n = sizes[self.at].astype(np.int64)
        self.ends = np.concatenate(([0], np.cumsum(self.n)))
        self.buckets = buckets[_ranges(begins[self.at], self.n)] if len(sizes) else buckets
        self.blocks = []
        widths = np.minimum(BUCKETS, 1 << np.ceil(np.log2(np.maximum(SPREAD * self.n, 64))).astype(np.int64))
        cuts = np.flatnonzero(np.diff(widths, prepend=0, append=0))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            width = int(widths[low])
            step = max(1, min(ROWS, COUNTS // width))
            self.blocks += [(k, min(k + step, high), width) for k in range(low, high, step)]

    def counts(self, low: int, high: int, width: int) -> np.ndarray:
        rows = np.repeat(np.arange(high - low) * width, self.n[low:high])
        own = self.buckets[self.ends[low] : self.ends[high]] & (width - 1)
        return np.bincount(rows + own, minlength=(high - low) * width).reshape(high - low, width).astype(np.float32)

    def present(self, low: int, high: int) -> np.ndarray:
        out = np.zeros((high - low, BUCKETS), bool)
        out[np.repeat(np.arange(high - low), self.n[low:high]), self.buckets[self.ends[low] : self.ends[high]]] = True
        return out


def _ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of the ranges, one after the other."""
    return np.arange(lengths.sum()) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)


def may_be_alike(a: Tile, b: Tile | None, threshold: float):
    """Arrays of positions (in what was given for a and b; within a where b is None, each pair once) of what may reach the threshold (above 0), block by block.

    Sets of n and m members whose Jaccard similarity reaches t share t / (1 + t) * (n + m) or more.
    """
    share = threshold / (1 + threshold)
    other = a if b is None else b
    for i, (low, high, wide) in enumerate(a.blocks):
        there = None
        for j, (first, last, broad) in enumerate(other.blocks):
            if b is None and j < i or a.n[high - 1] < threshold * other.n[first] - 1e-6 or other.n[last - 1] < threshold * a.n[low] - 1e-6:
                continue
            width = max(wide, broad)
            n, m = a.n[low:high], other.n[first:last]
            shared = a.counts(low, high, width) @ other.counts(first, last, width).T
            x, y = np.nonzero(shared >= (share * n * (1 - 1e-6) - 1e-2).astype(np.float32)[:, None] + (share * m).astype(np.float32)[None, :])
            kept = np.minimum(n[x], m[y]) >= threshold * np.maximum(n[x], m[y]) - 1e-6
            if b is None and j == i:
                kept &= x < y
            x, y = x[kept], y[kept]
            if not len(x):
                continue
            there = a.present(low, high) if there is None else there
            enough = []
            step = max(1, _LOOKED_UP // int(m.max()))
            for k in range(0, len(x), step):
                p, q = x[k : k + step], y[k : k + step]
                sizes = m[q]
                found = there[np.repeat(p, sizes), other.buckets[_ranges(other.ends[first + q], sizes)]]
                enough.append(np.add.reduceat(found, np.cumsum(sizes) - sizes, dtype=np.int64) >= share * (n[p] + sizes) - 1e-6)
            enough = np.concatenate(enough)
            if enough.any():
                yield a.at[low + x[enough]], other.at[first + y[enough]]


def size_class(n: Column, base: float) -> Column:
    """Sets of sizes within a factor of base of each other are in the same or in the next class."""
    return F.floor(F.log(n) / math.log(base)).cast("int")


def _pack(tile: pa.Table) -> pa.Table:
    """One row for a tile."""
    packed = {c: tile.column(c)[:1] for c in ("cell", "class", "salt")}
    for c in ("id", "tag", "n"):
        packed[c] = pa.array([tile.column(c).to_numpy().tobytes()], pa.binary())
    members = tile.column("members").combine_chunks().flatten()
    return pa.table(packed | {"members": pa.array([members.to_numpy(zero_copy_only=False).tobytes()], pa.binary())})


def meetings(sets: DataFrame, threshold: float, base: float, most: int, name: str) -> DataFrame:
    """A row for each packed tile in each pair of tiles that it is part of; cell, p, q, s, t (tile s of class p and tile t of class q) name the pair, second says which of the two it is.

    sets: cell (only sets of the same cell meet), class (by size_class), id, tag (longs), n, members (an array of numbers). A tile has most members or so.
    """
    parts = stage(sets.groupBy("cell", "class").agg(F.expr(f"cast(ceil(sum(n) / {most}) AS long)").alias("parts")), f"{name}-parts")
    dealt = sets.join(F.broadcast(parts), ["cell", "class"]).withColumn("salt", F.expr("pmod(xxhash64(id, tag), parts)"))
    schema = "cell long, class int, salt long, id binary, tag binary, n binary, members binary"
    packed = stage(dealt.select("cell", "class", "salt", "id", "tag", "n", "members").groupBy("cell", "class", "salt").applyInArrow(_pack, schema), f"{name}-tiles")
    reach = math.floor(-math.log(threshold) / math.log(base) + 1e-6) + 1
    roles = None
    for ahead in range(reach + 1):
        other = parts.select("cell", (F.col("class") - ahead).alias("class"), F.col("parts").alias("others"))
        met = parts.join(other, ["cell", "class"]).select("cell", F.col("class").alias("p"), (F.col("class") + ahead).alias("q"), "parts", "others")
        both = met.select("cell", F.col("p").alias("class"), "p", "q", F.lit(False).alias("second"), "others").unionByName(met.select("cell", F.col("q").alias("class"), "p", "q", F.lit(True).alias("second"), F.col("parts").alias("others")))
        roles = both if roles is None else roles.unionByName(both)
    met = packed.join(F.broadcast(roles), ["cell", "class"]).withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    # Within a class each unordered pair of tiles meets once; a tile meets itself once.
    met = met.where("p <> q OR (NOT second AND salt <= mate) OR (second AND salt > mate)")
    s, t = F.when(F.col("second"), F.col("mate")).otherwise(F.col("salt")), F.when(F.col("second"), F.col("salt")).otherwise(F.col("mate"))
    return met.select("cell", "p", "q", s.alias("s"), t.alias("t"), "second", "id", "tag", "n", "members")


def unpacked(pair: pa.Table, dtype: type) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """id, tag, n, members of one or two tiles of a pair."""
    types = {"id": np.int64, "tag": np.int64, "n": np.int32, "members": dtype}
    return [tuple(np.frombuffer(pair.column(c)[k].as_buffer(), t) for c, t in types.items()) for k in range(pair.num_rows)]

"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints are one node. Nodes are dealt into tiles by population count, and each tile is packed once (8 bytes a
node) and written; only packed tiles go to the pairs of tiles that meet, never single nodes. Two tiles meet only if their population counts differ by no more than the radius,
since each differing bit changes the count by one. Inside a pair of tiles the same
bound, taken over the four 16-bit quarters, skips blocks before numpy compares
the rest by exclusive-or and bit counts. A pair of tiles reports a spanning forest
of its links, never the links themselves, so that a large group of near copies
yields at most one row for each member. Every pair within the radius is compared
or ruled out by the bound: the result is exact.

Defined cases. Null text: the empty text, fingerprint 0. Null doc_id: a row like any
other, never the smallest id. Repeated rows: same fingerprint, same component. Empty
table: empty result. Other columns are ignored. Texts are read whole.

drop_near_duplicates(), the pipeline's stage (rows that share a doc_id are one document to it, and stay or go together), has
another contract: texts are near copies from a Jaccard similarity of SIMILAR of their sets of NEAR_SHINGLE-word shingles on.
The tiles above give candidates within RADIUS bits; but near copies often differ in 4 to 11 bits, a radius at which tiles would
rule out next to nothing. So documents that agree in one of BANDS bands of MinHash values are candidates too; a pair at the
threshold shares a band with a probability of 0.99995. Candidates are links to the smallest id of a band or fingerprint, then
pairs of a band whose documents these links leave in different components, and every link is verified on the whole texts.
The second kind are rows for bands of up to CROWD documents only; documents of larger bands are compared, all with all, in tiles
of their shingles (operators/set_tiles.py), which report a spanning forest of the components that they join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import key_filter, mark_possible, tidy
from gazette.llm.components import components
from gazette.operators import set_tiles
from gazette.staging import small_batches, stage

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Nodes of a tile at most (on average, as they are dealt by hash): 1 MB.
TILE = 1 << 17
_BLOCK = 1 << 18  # pairs that are compared at once
#: Near copies in the pipeline: words of a shingle, least similarity; bands of the MinHash values, values of a band.
NEAR_SHINGLE, SIMILAR, BANDS, BAND = 5, 0.8, 25, 5
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND, np.uint64) * np.uint64(2) + np.uint64(1)
#: Links of one document that are verified in one group of rows.
STAR = 500
#: Documents of a band whose pairs are made one by one, at most; those of larger bands are compared in tiles.
CROWD = 32
#: Shingles of such a tile: 4 MB. Sizes of its sets are within this factor.
_CROWD_TILE, _CROWD_SIZES = 1 << 19, 1.3


def shingles(text: bytes, size: int) -> np.ndarray:
    """XXH64 values of the runs of size words, all words if there are fewer; words end at ASCII white space."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[: n - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(begins, ends)], np.uint64, len(begins))


def fingerprint(text: bytes) -> int:
    """64 bits: 1 where over half of the shingles' XXH64 values have a 1."""
    hashes = shingles(text, SHINGLE)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        part = hashes[k : k + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        values = np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(values)], ["doc_id", "fp"])
    tidy()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the bits of the fingerprint as a signed long)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)


class _Forest:
    """Union-find over positions, fed with arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def flat(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return self.root
            self.root = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            new = ra != rb
            if not new.any():
                return
            a, b = a[new], b[new]
            np.minimum.at(self.root, np.maximum(ra, rb)[new], np.minimum(ra, rb)[new])
            self.flat()


def tile_links(a: np.ndarray, b: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all pairs within the radius between tiles a and b, or within a where b is None."""
    order_a = np.lexsort(_quarters(a).T)
    a = a[order_a]
    both = a if b is None else np.concatenate([a, b := b[np.lexsort(_quarters(b).T)]])
    other, shift = (a, 0) if b is None else (b, len(a))
    forest = _Forest(len(both))

    def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = _quarters(x)
        cuts = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]).any(axis=1)))) if len(x) else np.zeros(0, int)
        return q[cuts], np.append(cuts, len(x))

    (qa, cut_a), (qb, cut_b) = cells(a), cells(other)
    for i in range(len(qa)):
        near = np.flatnonzero(np.abs(qb - qa[i]).sum(axis=1) <= radius)
        if b is None:
            near = near[near >= i]
        if not len(near):
            continue
        at = np.concatenate([np.arange(cut_b[j], cut_b[j + 1]) for j in near])
        right = other[at]
        step = max(1, _BLOCK // len(at))
        for k in range(cut_a[i], cut_a[i + 1], step):
            left = a[k : min(k + step, cut_a[i + 1])]
            x, y = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)
            if len(x):
                forest.link(x + k, at[y] + shift)
    root = forest.flat()
    moved = np.flatnonzero(root != np.arange(len(root)))
    return both[moved], both[root[moved]]


def _pack(tile: pa.Table) -> pa.Table:
    """One row for a tile: its nodes' fingerprints, 8 bytes each."""
    return pa.table({"pop": tile.column("pop")[:1], "salt": tile.column("salt")[:1], "nodes": pa.array([tile.column("fp").to_numpy().tobytes()], pa.binary())})


def _compare(pair: pa.Table) -> pa.Table:
    """A spanning forest between two packed tiles, or within one."""
    first, second = ([np.frombuffer(t, np.uint64) for t, two in zip(pair.column("nodes").to_pylist(), pair.column("second").to_pylist()) if two is side] for side in (False, True))
    if pair.column("same")[0].as_py():
        u, v = tile_links(first[0])
    elif first and second:
        u, v = tile_links(first[0], second[0])
    else:
        u = v = np.zeros(0, np.uint64)
    return pa.table({"a": pa.array(u.view(np.int64)), "b": pa.array(v.view(np.int64))})


def tile_pairs(nodes: DataFrame, tile: int = TILE, radius: int = RADIUS) -> DataFrame:
    """p, q, s, t (tile s of population count p and tile t of q), second (which of the two), same, nodes: a row for each packed tile in each pair it is part of.

    The number of nodes of each population count (65 rows) sets into how many tiles they are dealt.
    """
    spark = nodes.sparkSession
    counted = nodes.withColumn("pop", F.bit_count("fp"))
    sizes = {r["pop"]: r["n"] for r in counted.groupBy("pop").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = {p: -(-n // tile) for p, n in sizes.items()}
    own = F.create_map(*[F.lit(x) for p, n in (salts or {0: 1}).items() for x in (p, n)])
    dealt = counted.withColumn("salt", F.pmod(F.xxhash64("fp"), own[F.col("pop")]))
    packed = stage(dealt.groupBy("pop", "salt").applyInArrow(_pack, "pop int, salt long, nodes binary"), "simhash-tiles")
    plan = [(p, q, salts[p], salts[q]) for p in sorted(salts) for q in sorted(salts) if 0 <= q - p <= radius]
    # One row for each way a tile of a population count takes part; at most 65 * (2 * radius + 2).
    roles = spark.createDataFrame([(p, p, q, False, m) for p, q, n, m in plan] + [(q, p, q, True, n) for p, q, n, m in plan], "pop int, p int, q int, second boolean, others long")
    met = packed.join(F.broadcast(roles), "pop").withColumn("mate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    # Within one population count each unordered pair of tiles meets once; a tile meets itself once.
    met = met.where("p <> q or (not second and salt <= mate) or (second and salt > mate)")
    s = F.when(F.col("second"), F.col("mate")).otherwise(F.col("salt"))
    t = F.when(F.col("second"), F.col("salt")).otherwise(F.col("mate"))
    return met.select("p", "q", s.alias("s"), t.alias("t"), "second", ((F.col("p") == F.col("q")) & (s == t)).alias("same"), "nodes")


def links(nodes: DataFrame, tile: int = TILE, radius: int = RADIUS) -> DataFrame:
    """a, b: for each pair of tiles a spanning forest of the pairs of nodes (fp, distinct) within the radius."""
    return tile_pairs(nodes, tile, radius).groupBy("p", "q", "s", "t").applyInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs."""
    prints = stage(fingerprints(docs), "simhash-prints")
    nodes = prints.select("fp").distinct()
    linked = components(links(nodes, tile))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = stage(classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def bands(own: np.ndarray) -> list[int]:
    """A key for each band of the MinHash values of a set of shingles; equal sets have equal keys."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 2048):
        least = np.minimum(least, (own[k : k + 2048, None] * _FACTORS).min(axis=0))
    return [xxhash.xxh64_intdigest(part.tobytes(), k) for k, part in enumerate(least.reshape(BANDS, BAND))]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t.as_py() or b"" for t in b.column("text").cast(pa.binary())]
        sets = [np.unique(shingles(t, NEAR_SHINGLE)) for t in texts]
        keys = np.array([bands(x) for x in sets], np.uint64).reshape(-1).view(np.int64)
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
        prints = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), prints, keys], ["doc_id", "n", "fp", "keys"])
    tidy()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles, sorted, reach the least similarity; two empty ones do."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, own = None, np.zeros(0, np.uint64)
    for b in batches:
        kept = []
        for one, other in zip(b.column("text_a").cast(pa.binary()), b.column("text_b").cast(pa.binary())):
            one, other = one.as_py() or b"", other.as_py() or b""
            if one != last:
                last, own = one, np.unique(shingles(one, NEAR_SHINGLE))
            kept.append(similar(own, np.unique(shingles(other, NEAR_SHINGLE))))
        yield b.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))
    tidy()


def near_candidates(sketches: DataFrame) -> DataFrame:
    """a, b (doc_ids): what may be near copies: documents whose fingerprints are equal or within the radius, as the tiles find them, and
    documents that agree in a band; both as links to the smallest id of a fingerprint or band, so that there are no more than documents times BANDS + 1."""
    prints = stage(sketches.groupBy("fp").agg(F.min(F.struct("doc_id", "n")).alias("first")), "near-prints")
    equal = sketches.join(prints, "fp").select("first", "doc_id", "n")
    side = lambda x: prints.select(F.col("fp").alias(x), F.col("first").alias(f"of_{x}"))
    tiled = links(prints.select("fp")).join(side("a"), "a").join(side("b"), "b").select(F.least("of_a", "of_b").alias("first"), F.greatest("of_a", "of_b").alias("other")).select("first", "other.doc_id", "other.n")
    rows = sketches.select("doc_id", "n", F.explode("keys").alias("key"))
    groups = stage(rows.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id <> last").select("key", "first"), "near-groups")
    banded = rows.join(groups, "key").select("first", "doc_id", "n")
    # Sets whose sizes differ too much cannot be similar enough; the bound is a little lower, for the division.
    near = equal.unionByName(tiled).unionByName(banded).where(f"doc_id <> first.doc_id and least(n, first.n) >= {SIMILAR - 1e-6} * greatest(n, first.n)")
    return near.select(F.col("first.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()


def mixed_bands(sketches: DataFrame, roots: DataFrame) -> DataFrame:
    """key, size, doc_id, n, root: the documents of bands that hold documents of different components (roots: node, root)."""
    rows = sketches.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n", F.coalesce("root", "doc_id").alias("root"), F.explode("keys").alias("key"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high").select("key", "size")
    return rows.join(mixed, "key")


def cross_candidates(sketches: DataFrame, roots: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """a, b (doc_ids): documents that agree in a band of at most CROWD but are in different components (roots: node, root) of the links to its smallest id.

    Links within a component add nothing. What only agrees with other members of a band than the smallest is found here.
    """
    rows = (stage(mixed_bands(sketches, roots), "near-mixed") if rows is None else rows).where(F.col("size") <= CROWD)
    side = lambda x: rows.select("key", F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("root").alias(f"root_{x}"))
    near = side("a").join(side("b"), "key").where(f"a < b and root_a <> root_b and least(n_a, n_b) >= {SIMILAR - 1e-6} * greatest(n_a, n_b)")
    return near.select("a", "b").distinct()


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.unique(shingles(t.as_py() or b"", NEAR_SHINGLE)).view(np.int64) for t in b.column("text").cast(pa.binary())]
        ends = np.cumsum([0] + [len(x) for x in sets], dtype=np.int32)
        members = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("root"), pa.array(np.diff(ends)), members], ["id", "tag", "n", "members"])
    tidy()


def _joined(pair: pa.Table) -> pa.Table:
    """Verified links between documents of different components of a pair of tiles: as many as join what they join, not more."""
    sides = [(i, tag, np.cumsum(n) - n, n, own.view(np.uint64)) for i, tag, n, own in set_tiles.unpacked(pair, np.int64)]
    tiles = [set_tiles.Tile(n, own.astype(np.uint16)) for _, _, _, n, own in sides]
    first, second = sides[0], sides[-1]
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    a, b = [], []
    for x, y in set_tiles.may_be_alike(tiles[0], tiles[1] if len(tiles) > 1 else None, SIMILAR):
        apart = first[1][x] != second[1][y]
        for i, j in zip(x[apart].tolist(), y[apart].tolist()):
            u, v = top(int(first[1][i])), top(int(second[1][j]))
            if u != v and similar(*(side[4][side[2][k] : side[2][k] + side[3][k]] for side, k in ((first, i), (second, j)))):
                up[max(u, v)] = min(u, v)
                a.append(min(first[0][i], second[0][j]))
                b.append(max(first[0][i], second[0][j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def crowd_links(own: DataFrame, rows: DataFrame) -> DataFrame:
    """a, b: verified links that join components, among all documents of bands (rows: mixed_bands) of more than CROWD."""
    crowd = stage(rows.where(F.col("size") > CROWD).select("doc_id", "root").distinct(), "near-crowd")
    found = stage(key_filter(crowd, "doc_id"), "crowd-filter")
    texts = mark_possible(own, found, "doc_id", "near").where("near").select("doc_id", "text").join(crowd, "doc_id")
    sets = stage(texts.mapInArrow(_shingled, "id long, tag long, n int, members array<long>").where("n > 0"), "crowd-sets")
    sets = sets.withColumns({"cell": F.lit(0).cast("long"), "class": set_tiles.size_class(F.col("n"), _CROWD_SIZES)})
    met = set_tiles.meetings(sets, SIMILAR, _CROWD_SIZES, _CROWD_TILE, "crowd")
    return met.groupBy("cell", "p", "q", "s", "t").applyInArrow(_joined, "a long, b long")


def near_links(docs: DataFrame) -> DataFrame:
    """a, b: verified links (doc_ids, a the smaller) between near copies: those to the smallest of a band or fingerprint, then those between what these leave apart."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    sketches = stage(own.mapInArrow(_sketched, "doc_id long, n long, fp long, keys array<long>"), "near-sketches")
    first = stage(_verified_links(own, near_candidates(sketches)), "near-first")
    roots = components(first)
    rows = stage(mixed_bands(sketches, roots), "near-mixed")
    return first.unionByName(_verified_links(own, cross_candidates(sketches, roots, rows))).unionByName(crowd_links(own, rows))


def _verified_links(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose whole texts reach the least similarity."""
    pairs = stage(pairs, "near-pairs")
    # The first text of a star goes out once for each STAR links, so that no task has to verify all of a large one.
    stars = stage(pairs.groupBy("a").agg(F.expr(f"count(*) div {STAR} + 1").alias("parts")), "near-stars")
    pairs = pairs.join(stars, "a").select("a", "b", F.expr("pmod(xxhash64(b), parts)").alias("part"))
    found = stage(key_filter(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id"), "near-filter")
    texts = mark_possible(own, found, "doc_id", "near").where("near").drop("near")
    ones = texts.withColumnRenamed("doc_id", "a").join(stars, "a").select("a", F.col("text").alias("text_a"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    pairs = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(ones, ["a", "part"])
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component of near copies, all columns as they are; rows without doc_id stay."""
    gone = stage(components(near_links(docs)).where("node <> root").select(F.col("node").alias("doc_id")).distinct(), "near-gone")
    return without(docs, gone)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in gone. Only rows that a fixed-size filter of gone lets through are shuffled."""
    bitmap = stage(key_filter(gone, "doc_id"), "gone-filter")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    whole = mark_possible(whole, bitmap, "id", "near")
    near = whole.where("near").join(gone.select(F.col("doc_id").alias("id")), "id", "left_anti")
    return whole.where("not near").select("row.*").unionByName(near.select("row.*"))

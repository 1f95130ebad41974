import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazette.llm import exact_dedup, exchange, simhash
from gazette.llm.common import key_filter, mark_possible
from gazette.llm.components import components
from gazette.llm.queries import ORACLE, op7_simhash, op9_exact_dedup
from tests.test_catalog import assert_same


@given(st.lists(st.integers(0, 2**48 - 1), min_size=1, max_size=200))
@settings(max_examples=100, deadline=None)
def test_golomb_round_trip(values):
    v = np.array(sorted(values), np.uint64)
    assert (exchange.golomb_decode(exchange.golomb_encode(v)) == v).all()


def test_exact_against_sql(spark, sf):
    assert_same(op9_exact_dedup(spark, sf), ORACLE["op9_exact_dedup"], sf)


def test_exact_odd(odd, empty):
    rows = exact_dedup.exact_duplicates(odd, owners=3).collect()
    assert len(rows) == 9
    same = [r for r in rows if r["group_size"] == 4]
    assert len(same) == 4 and {r["keep_id"] for r in same} == {1} and sum(r["kept"] for r in same) == 1
    blank = [r for r in rows if r["doc_id"] in (3, 4)]
    assert {r["keep_id"] for r in blank} == {3} and [r["kept"] for r in sorted(blank, key=lambda r: r["doc_id"])] == [True, False]
    assert exact_dedup.exact_duplicates(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7]
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_exact_many_partitions(spark):
    rng = random.Random(1)
    rows = [(i, f"text {rng.randint(0, 400)}") for i in range(1000)]
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), owners=5).collect()}
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert got == {i: first[t] for i, t in rows}


def test_owners_follow_the_rows(spark, monkeypatch):
    """No owner has more fingerprints than it may hold; the result does not depend on their number."""
    monkeypatch.setattr(exact_dedup, "OWNED", 20)
    seen = []
    send = exact_dedup._send
    monkeypatch.setattr(exact_dedup, "_send", lambda owners: seen.append(owners) or send(owners))
    rows = [(i, f"text {i % 150}") for i in range(400)]
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert seen == [20] and got == {i: i % 150 for i, _ in rows}


def test_one_of_rows_with_the_same_id_stays(spark):
    rows = [(1, "a b", "z"), (1, "a  b", "y"), (1, "a b", "x"), (2, "a b", "w")]
    for order in (rows, rows[::-1]):
        kept = exact_dedup.drop_exact_duplicates(spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)).collect()
        assert [tuple(r) for r in kept] == [(1, "a  b", "y")]


def test_key_filter(spark):
    keys = spark.createDataFrame([(i,) for i in range(0, 500, 5)], "k long")
    got = {r["k"]: r["near"] for r in mark_possible(spark.range(500).withColumnRenamed("id", "k"), key_filter(keys, "k"), "k", "near").collect()}
    assert all(got[k] for k in range(0, 500, 5)) and sum(got.values()) < 110


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aAbB \t\n\x0b\x1cÉé\u00a0中", max_size=40))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_print(text)


def roots(prints):
    root = list(range(len(prints)))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    while True:
        new = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(prints))]
        if new == root:
            return root
        root = new


@pytest.mark.parametrize("tile", [50, 65536])
def test_links_and_components(spark, tile):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    bit = lambda: np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)
    prints = np.unique(np.concatenate([base, base ^ bit(), base ^ bit() ^ bit() ^ bit() ^ bit(), base[:1] ^ bit(), [np.uint64(0)]]))
    want = roots(prints)
    nodes = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(nodes, tile)).collect()}
    groups = {}
    for x, r in zip(prints.view(np.int64), want):
        groups.setdefault(r, []).append(int(x))
    for g in groups.values():
        assert {got.get(x, x) for x in g} == {min(g)}


def test_nodes_are_not_copied_for_each_pair_of_tiles(spark):
    """At several tiles a population count, rows for pairs are those of packed tiles: far below ten a node."""
    prints = np.random.default_rng(4).integers(0, 2**63, 6000, dtype=np.uint64)
    met = simhash.tile_pairs(spark.createDataFrame([(int(x),) for x in prints], "fp long"), tile=40).select("p", "q", "s", "t", "second", "same", F.length("nodes").alias("bytes")).collect()
    assert len({(r["p"], r["s"]) for r in met}) > 100 and len(met) / len(prints) < 10
    pairs = {}
    for r in met:
        pairs.setdefault((r["p"], r["q"], r["s"], r["t"]), []).append(r)
    assert all(len(x) == (1 if x[0]["same"] else 2) for x in pairs.values())
    assert sum(r["bytes"] for r in met if r["same"]) == 8 * len(prints)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == got[100] == 100
    assert components(edges.where("false")).count() == 0


def test_simhash_query(spark, sf, texts):
    rows = op7_simhash(spark, sf).collect()
    prints = {r["doc_id"]: brute_print(texts[r["doc_id"]]) for r in rows}
    assert len(rows) == len(texts) and all(int(r["fingerprint"], 16) == prints[r["doc_id"]] and len(r["fingerprint"]) == 16 for r in rows)
    ids = sorted(prints)
    want = roots(np.array([prints[i] for i in ids], np.uint64))
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: ids[k] for i, k in zip(ids, want)}


def test_simhash_odd(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 9
    assert {r["component_id"] for r in rows if r["doc_id"] in (3, 4)} == {3}
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {1}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and 2 not in {r["doc_id"] for r in kept.collect()}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def five_word_sets(texts):
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    return {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}


def test_near_copies_beyond_the_radius(spark):
    rng = random.Random(5)
    texts = {}
    for k in range(0, 200, 2):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        texts[k] = " ".join(words)
        words[rng.randrange(5, 115)] = "changed"
        words[rng.randrange(5, 115)] = "changed"
        texts[k + 1] = " ".join(words)
    sets, prints = five_word_sets(texts), {i: simhash.fingerprint(t.encode()) for i, t in texts.items()}
    near = {k for k in texts if k % 2 and len(sets[k] & sets[k - 1]) >= 0.8 * len(sets[k] | sets[k - 1])}
    assert sum((prints[k] ^ prints[k - 1]).bit_count() > simhash.RADIUS for k in near) > 50
    out = simhash.drop_near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"] for r in out.collect()} == set(texts) - near


def test_near_copies_of_the_table(docs, texts):
    sets, up = five_word_sets(texts), {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()} == {i for i in texts if up[i] == i}


def test_near_links_between_others_than_the_smallest_of_a_band(spark):
    """2 and 3 are alike and share a band with 1, which is like neither, but for no band of their own."""
    from gazette.llm.simhash import cross_candidates

    sketches = spark.createDataFrame([(1, 90, 1, [7]), (2, 100, 2, [7]), (3, 99, 3, [7]), (4, 100, 4, [8]), (5, 30, 5, [7])], "doc_id long, n long, fp long, keys array<long>")
    roots = spark.createDataFrame([], "node long, root long")
    assert {tuple(r) for r in cross_candidates(sketches, roots).collect()} == {(1, 2), (1, 3), (2, 3)}
    roots = spark.createDataFrame([(2, 1), (1, 1)], "node long, root long")
    assert {tuple(r) for r in cross_candidates(sketches, roots).collect()} == {(1, 3), (2, 3)}


def test_pairs_of_a_large_band_are_not_rows(spark):
    """Documents that share a band but are mostly unlike are compared in tiles: no row for each pair, and no link lost."""
    rng = random.Random(11)
    common = [f"c{k}" for k in range(60)]
    texts = {0: " ".join(common)}
    for k in range(1, 161, 2):
        own = [*common, *(f"o{k}x{rng.randrange(10**6)}" for _ in range(60))]
        texts[k] = " ".join(own)
        texts[k + 1] = " ".join([*own[:-2], "last", "words"])
    sets = five_word_sets(texts)
    like = {(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert like == {(k, k + 1) for k in range(1, 161, 2)}
    sketches = spark.createDataFrame([(i, len(x), i, [7]) for i, x in sets.items()], "doc_id long, n long, fp long, keys array<long>")
    rows = simhash.mixed_bands(sketches, spark.createDataFrame([], "node long, root long")).cache()
    assert rows.count() == len(texts) and simhash.cross_candidates(sketches, None, rows).count() == 0
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {tuple(r) for r in simhash.crowd_links(docs, rows).collect()} == like
    met = simhash.set_tiles.meetings(rows.selectExpr("0L AS cell", "cast(doc_id % 3 AS int) AS class", "doc_id AS id", "root AS tag", "cast(n AS int) AS n", "array(1L) AS members"), 0.8, 1.3, 2000, "test")
    pairs = {}
    for r in met.select("p", "q", "s", "t", "second").collect():
        pairs.setdefault(tuple(r)[:4], []).append(r["second"])
    assert all(sorted(x) == ([False] if k[0] == k[1] and k[2] == k[3] else [False, True]) for k, x in pairs.items()) and all(k[1] - k[0] in (0, 1) for k in pairs)
    rows.unpersist()

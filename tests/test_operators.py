import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gazette.functions import text
from gazette.operators import dedup, joins, metrics, ranking, series, similar
from gazette.staging import release, stage


def test_round_robin(spark):
    t = dt.datetime(2026, 8, 14)
    rows = [("A", i, t - dt.timedelta(minutes=i)) for i in range(30)] + [("B", 100, t), ("B", 101, t - dt.timedelta(days=1)), ("C", 200, t - dt.timedelta(minutes=5))]
    df = spark.createDataFrame([("p", s, q, p) for s, q, p in rows], "cat string, source string, seq long, published timestamp")
    got = ranking.round_robin(df, ["cat"], "source", "published", "seq").orderBy("position").collect()
    assert [r["seq"] for r in got][:6] == [0, 100, 200, 1, 101, 2]  # equal times: the smaller number first
    assert len(got) == 20


def test_exact_longest(spark):
    rows = [(1, "Hello, World", "ab"), (2, "hello world!", "abcd"), (3, "HELLO WORLD", "wxyz"), (4, "", "a"), (5, " ?! ", "bb"), (6, "한글 제목", "x"), (7, None, "c")]
    df = spark.createDataFrame([("p", *r) for r in rows], "cat string, seq long, title string, summary string")
    got = {r["pos"]: r["seq"] for r in dedup.exact_longest(df, ["cat"]).collect()}
    assert got == {1: 2, 4: 5, 6: 6}


def _greedy(rows, threshold):
    kept = []
    for pos, words, size in rows:
        for k in kept:
            union = k[1] | words
            if union and len(k[1] & words) / len(union) >= threshold:
                if size > k[2]:
                    k[2], k[3] = size, pos
                break
        else:
            kept.append([pos, words, size, pos])
    return {(k[0], k[3]) for k in kept}


@pytest.mark.parametrize("seed", range(4))
def test_near_greedy_against_loop(spark, seed):
    rng = random.Random(seed)
    rows, want = [], set()
    for source in ("a", "b"):
        own = [(i, " ".join(rng.sample("alpha beta gamma delta eps zeta".split(), rng.randint(0, 4))), "x" * rng.randint(0, 5)) for i in range(25)]
        rows += [(source, *r) for r in own]
        want |= {(source, *k) for k in _greedy([(i, set(t.split()), len(s)) for i, t, s in own], 0.5)}
    df = spark.createDataFrame(rows, "source string, pos long, title string, summary string")
    got = {(r["source"], r["kept_pos"], r["pos"]) for r in dedup.near_greedy(df, ["source"]).collect()}
    assert got == want


def test_unseen_and_answers(spark):
    d = dt.date(2026, 8, 14)
    today = spark.createDataFrame([(1, "a"), (2, "b"), (3, ""), (4, "c")], "id long, k string")
    old = spark.createDataFrame([("a", d - dt.timedelta(days=7)), ("b", d - dt.timedelta(days=8)), ("", d - dt.timedelta(days=1)), ("c", d)], "k string, date date")
    assert {r["id"] for r in joins.unseen(today, old, "k", 7, F.lit(d)).collect()} == {2, 3, 4}
    answers = spark.createDataFrame([(1, 0, "x"), (1, 5, "y"), (9, 1, "z")], "id long, pos int, said string")
    assert {r["id"]: r["said"] for r in joins.with_answers(today, answers).collect()} == {1: "y", 2: None, 3: None, 4: None}


def test_looked_up(spark):
    candidates = spark.createDataFrame([(i, f"c{i}") for i in range(1, 5)], "id long, name string")
    picks = spark.createDataFrame([(2, 1, 0), (0, 2, 1), (9, 3, 2), (2, 4, 3), (4, None, 4), (1, 2, 5)], "id long, rank int, pos int")
    assert [r["name"] for r in joins.looked_up(picks, candidates, 10).collect()] == ["c2", "c1", "c4"]


def test_insert_and_reroute(spark):
    old = spark.createDataFrame([(1, "a")], "k long, v string")
    assert {tuple(r) for r in joins.insert_if_absent(old, spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string"), "k").collect()} == {(1, "a"), (2, "c")}
    owners = spark.createDataFrame([("x", 0, "k1"), ("y", 1, "k2"), ("z", 2, "k3")], "category string, category_seq int, key string")
    got = {r["category"]: r["key"] for r in joins.reroute(owners, spark.createDataFrame([("k2",), ("k3",)], "key string")).collect()}
    assert got == {"x": "k2", "y": "k2", "z": "k3"}


def test_candidates(spark):
    day = dt.date(2026, 8, 1)
    rows = [("five", day + dt.timedelta(i), 1.0, 1.0) for i in range(5)]
    rows += [("six", day + dt.timedelta(i), 100.0 + i, 10.0) for i in range(6)]
    rows += [("long", day + dt.timedelta(i), 100.0 + i, float(i)) for i in range(30)]
    rows += [("zero", day + dt.timedelta(i), float(i), 0.0) for i in range(6)]
    got = {r["symbol"]: r for r in series.candidates(spark.createDataFrame(rows, "symbol string, date date, close double, volume double"), ["symbol"]).collect()}
    assert "five" not in got
    assert got["six"]["weekly_change_pct"] == got["six"]["monthly_change_pct"] == 5.0
    assert round(got["long"]["monthly_change_pct"], 4) == round((129 - 109) / 109 * 100, 4)
    assert got["long"]["volume_ratio"] == 29 / 26
    assert got["zero"]["monthly_change_pct"] is None and got["zero"]["volume_ratio"] is None


def test_picks_and_indicators(spark):
    e = spark.createDataFrame([("m", 0, "a", 1.0, -1.0, None), ("m", 1, "b", 1.0, -2.0, None), ("m", 2, "c", 0.5, -3.0, 4.0)], "market string, seq int, symbol string, daily_change_pct double, weekly_change_pct double, monthly_change_pct double")
    got = {(r["horizon"], r["rank"]): r["symbol"] for r in series.picks(e, ["market"], "seq").collect()}
    assert got == {("daily", 1): "a", ("daily", 2): "b", ("weekly", 1): "a", ("weekly", 2): "b", ("monthly", 1): "c"}
    h = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 4])] + [("one", 0, 1.0)], "key string, date int, value double")
    (row,) = series.indicators(h, ["key"], "date", "value").collect()
    assert (row["value"], row["pct"], row["dir"]) == ("4.00", "-50.00%", "down") and "#3b82f6" in row["sparkline_svg"]


def test_chunks_and_rates(spark):
    df = spark.createDataFrame([("p", i) for i in range(30)], "c string, seq long")
    sizes = [r["n"] for r in ranking.chunks(df, ["c"], ["seq"], 8).groupBy("chunk").agg(F.count("*").alias("n")).orderBy("chunk").collect()]
    assert sizes == [8, 8, 8, 6]
    empty = metrics.fallback_rate(df.where("false"), F.lit(True)).first()
    assert (empty["total"], empty["pct"], empty["headline"]) == (0, 0, "ok")
    assert metrics.fallback_rate(df, F.col("seq") < 3).first()["headline"] == "degraded"


def test_staging(spark):
    df = stage(spark.createDataFrame([(1, "a")], "x int, y string").where("x > 5"), "nothing")
    assert df.count() == 0 and df.columns == ["x", "y"]
    release(spark)


def test_long_unlike_sets_are_no_candidates(spark):
    """Sets of 400 words that share some 130 of them are far from a similarity of 0.3: no row is made for their pairs."""
    import random

    rng = random.Random(4)
    rows = [(i, "g", [f"c{k}" for k in range(100)] + [f"w{k}" for k in rng.sample(range(3000), 300)]) for i in range(150)]
    rows.append((150, "g", rows[0][2][50:]))
    classes = similar.set_classes(spark.createDataFrame(rows, "id long, g string, w array<string>"), ["g"], "id", "w")
    assert [(r["a"], r["b"]) for r in similar.candidate_rows(classes, ["g"], 0.3).collect()] == [(0, 150)]


def test_near_greedy_writes_little(spark):
    """What is staged stays near the size of the texts, as words are no rows of their own."""
    import glob
    import os
    import random

    from gazette import staging

    rng = random.Random(4)
    rows = [(i, "g", " ".join([f"c{k}" for k in range(100)] + [f"w{k}" for k in rng.sample(range(3000), 300)])) for i in range(300)]
    rows += [(300, None, rows[0][2]), (301, "g", rows[0][2] + " more"), (302, "g", "")]
    before = len(staging._STAGED)
    out = dedup.near_greedy(spark.createDataFrame(rows, "pos long, g string, title string"), ["g"], summary="title")
    wrote = sum(os.path.getsize(f) for path in staging._STAGED[before:] for f in glob.glob(path.removeprefix("file://") + "/**/*.parquet", recursive=True))
    assert wrote < 2 * sum(len(r[2]) for r in rows)
    assert sorted((r["pos"], r["kept_pos"], r["g"]) for r in out.collect()) == sorted([(i, i, "g") for i in range(1, 300)] + [(301, 0, "g"), (300, 300, None), (302, 302, "g")], key=lambda r: r[0])


def test_similarity_join_keeps_few_rows(spark):
    """Rows that the join keeps are a small share of all pairs, however long the texts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", text.tokens(F.col("text")).alias("w"))
    classes = similar.set_classes(docs, ["source"], "doc_id", "w").cache()
    pairs = sum(r["count"] * (r["count"] - 1) // 2 for r in classes.groupBy("source").count().collect())
    assert similar.candidate_rows(classes, ["source"], 0.3).count() < 0.1 * pairs
    classes.unpersist()

"""Fill-in-the-middle, repeated passages and phrases, against brute force."""

import hashlib
import re
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gazette.llm import queries
from gazette.llm.middle import BLOCK, class_runs, fill_in_middle, restored
from gazette.llm import passages
from gazette.llm.exchange import answer, base_of, golomb_decode, golomb_encode, owner_of, questions
from gazette.llm.passages import levels, without_repeats
from gazette.llm.phrases import _summed, collocations
from gazette.llm.words import hashes, places
from tests.test_catalog import assert_same


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_substring_dedup", "op13_collocations"])
def test_query_against_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), queries.ORACLE[name], sf)


@given(st.lists(st.sampled_from(["a", "bcd", "é", "한국", "😀", "", "x" * 300]), max_size=30))
@settings(max_examples=60, deadline=None)
def test_runs_find_every_character(parts):
    text = "".join(parts)
    data = np.frombuffer(text.encode(), np.uint8)
    runs = class_runs(data)
    firsts = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    units = np.arange(len(text) + 1)
    assert (runs.byte_at(units) == firsts).all() and (runs.unit_at(firsts) == units).all()
    assert (np.diff(runs.size[:-1]) != 0).all()  # maximal


def test_runs_over_blocks():
    text = "é" * BLOCK + "a" * BLOCK + "한" * (BLOCK // 2)
    runs = class_runs(np.frombuffer(text.encode(), np.uint8))
    assert len(runs.byte) == 4 and runs.byte_at(np.array([BLOCK + 5]))[0] == 2 * BLOCK + 5


def _fim(doc_id, text):
    text = text or ""
    g = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(g[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
    return (doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")


def test_middle_on_odd_rows(spark, odd, empty):
    rows = [(100 + k, "über <P" * k + "😀>S<" * (k % 7) + ("<S>" if k % 11 == 3 else "")) for k in range(120)]
    docs = odd.select("doc_id", "text", "lang", "row").unionByName(spark.createDataFrame([(i, t, "en", "r") for i, t in rows], "doc_id long, text string, lang string, row string"))
    want = sorted((_fim(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    found = fill_in_middle(docs)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = sorted(r[0] for r in found.select(restored(found["form"], found["output"])).collect())
    assert back == sorted(r["text"] or "" for r in docs.collect())
    assert fill_in_middle(empty).collect() == []


def test_middle_with_other_marks(spark):
    docs = spark.createDataFrame([(k, f"def f{k}(x): return x") for k in range(50)], "doc_id long, text string")
    marks = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    found = fill_in_middle(docs, marks, changed=100, suffix_first=50, salt="other")
    got = found.select("doc_id", "form", restored(found["form"], found["output"], marks).alias("t")).collect()
    assert {r["form"] for r in got} == {"psm", "spm"} and sorted(r["t"] for r in got) == sorted(f"def f{k}(x): return x" for k in range(50))


def _phrases(rows, least, longest, share, top):
    f = defaultdict(Counter)
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            for n in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items()):
                continue
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        n = sum(x for p, x in c.items() if len(p) == 1)
        out += [(lang, rank, p.decode(), -a, l, r, n, -s) for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def test_phrases_against_brute_force(spark, odd, empty):
    rng = np.random.default_rng(3)
    words = ["new", "YORK", "the", "city", "of", "ö", "漢字", "x" * 70000, "in", "per", "se"]
    texts = [" ".join(rng.choice(words[:7], rng.integers(0, 30))) + rng.choice([".", "\t;", "\x0b", ""]) + " new york city\tcouncil, de facto per se" for _ in range(150)]
    texts += ["new york city council"] * 40 + ["a b a b a b a"] * 9 + [words[7] + " end"] * 4
    rows = [("en" if k % 3 else None if k % 2 else "und", t) for k, t in enumerate(texts)] + [("de", "nur das"), ("fr", None)]
    docs = odd.select("lang", "text", "doc_id", "near").unionByName(spark.createDataFrame([(g, t, 1, "n") for g, t in rows], "lang string, text string, doc_id long, near string"))
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    for least, longest, share, top in ((3, 4, 80, 2000), (2, 3, 100, 25), (4, 2, 50, 10)):
        got = collocations(docs, least, longest, share, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert sorted(map(tuple, got.collect())) == _phrases(rows, least, longest, share, top)
    assert collocations(empty).collect() == []


def test_scores_beyond_64_bits(spark):
    from gazette.llm.phrases import scored

    a = 3 * 10**15
    counts = spark.createDataFrame([("en", "a", 1, 7 * a), ("en", "b", 1, a), ("en", "a b", 2, a)], "lang string, phrase string, words int, n long")
    row = scored(counts, 4, 2_000_000).first()
    assert (row["a"], row["l"], row["r"], row["score"], row["inside"]) == (a, 7 * a, a, 250_000, None)


def test_colliding_hashes_stay_apart():
    keys, weights, check = np.array([5, 5, 5, 2], np.uint64), np.array([1, 2, 4, 8]), np.array([1, 0, 1, 3], np.uint64)
    _, sums, one = _summed(keys, weights, check)
    assert sorted(zip(sums.tolist(), check[one].tolist())) == [(2, 0), (5, 1), (8, 3)]


@given(st.lists(st.lists(st.sampled_from(["a", "bb", "é", "x" * 66000, "x" * 65999 + "y", "漢"]), max_size=6), max_size=8))
@settings(max_examples=30, deadline=None)
def test_word_hashes(texts):
    raw = [" ".join(t).encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    begins, ends, text = places(data, at)
    words = [data[b:e].tobytes().decode() for b, e in zip(begins, ends)]
    assert words == [w for t in texts for w in t] and text.tolist() == [k for k, t in enumerate(texts) for _ in t]
    h = hashes(data, begins, ends)
    assert len(set(h.tolist())) == len(set(words)) and len(dict(zip(words, h.tolist()))) == len(set(h.tolist()))


def _without_repeats(rows, length):
    """rows: (doc_id, text) in the order of the table."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    words = [re.findall("[^ \t-\r]+", t or "") for _, t in rows]
    seen, out = set(), []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - length + 1):
            window = tuple(w[k : k + length])
            if window in seen:
                gone.update(range(k, k + length))
            seen.add(window)
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def test_levels():
    assert levels(20) == [5, 10, 20] and levels(7) == [7] and levels(96) == [6, 12, 24, 48, 96]


@pytest.mark.parametrize("length", [20, 6, 40])
def test_repeats_against_brute_force(spark, odd, empty, length):
    rng = np.random.default_rng(length)
    vocabulary = [f"w{k}" for k in range(60)] + ["é", "漢字", "a" * 300]
    passages_ = [" ".join(rng.choice(vocabulary, n)) for n in (19, 20, 21, 45, 90, 200)]
    texts = []
    for k in range(160):
        parts = [" ".join(rng.choice(vocabulary, rng.integers(0, 25))) if rng.random() < 0.6 else passages_[rng.integers(0, 6)] for _ in range(rng.integers(0, 6))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts))
    texts += [passages_[4]] * 60 + ["again and " * 50, "same " * 19, "same " * 41, None, ""]
    docs = odd.select("doc_id", "text", "row", "sha").unionByName(spark.createDataFrame([(200 - k if k != 30 else None, t, "r", "s") for k, t in enumerate(texts)], "doc_id long, text string, row string, sha string").repartition(5))
    want = _without_repeats([(r["doc_id"], r["text"]) for r in docs.collect()], length)
    got = sorted((tuple(r) for r in without_repeats(docs, length, owners=7).select("doc_id", "n_words", "n_removed", "text").collect()), key=str)
    assert got == want and sum(w[2] > 0 for w in want) > 50
    assert without_repeats(empty, length).collect() == []


def test_repeats_end_when_no_candidate_survives(spark):
    docs = spark.createDataFrame([(k, " ".join(f"{k}-{i}" for i in range(50))) for k in range(30)], "doc_id long, text string")
    got = without_repeats(docs).collect()
    assert len(got) == 30 and all(r["n_removed"] == 0 and r["n_words"] == 50 and r["longest"] == 0 for r in got)


def test_a_fresh_worker_has_all_that_chunks_need():
    """Nothing else in a worker may have loaded pyarrow's functions."""
    batch = pa.RecordBatch.from_arrays([pa.array([2, None, 1]), pa.array(["b b", "c", "a"])], ["doc_id", "text"])
    with pa.ipc.new_stream(out := pa.BufferOutputStream(), batch.schema) as stream:
        stream.write_batch(batch)
    code = "import sys, pyarrow as pa; from gazette.llm.passages import _Chunk; print(_Chunk(pa.ipc.open_stream(sys.stdin.buffer.read()).read_all(), 1).table['doc_id'].to_pylist())"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, input=out.getvalue().to_pybytes(), cwd=passages.__file__.rpartition("/gazette/")[0])
    assert done.stdout.strip() == b"[1, 2, None]", done.stderr


def test_texts_go_to_chunks_whole(monkeypatch):
    monkeypatch.setattr(passages, "CHUNK", 100)
    monkeypatch.setattr(passages.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda s: 3})())
    texts = ["x" * n for n in (10, 60, 40, 250, 5, 5, 99, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"])
    found = pa.Table.from_batches(passages._chunked(iter([batch.slice(0, 3), batch.slice(3)]))).to_pydict()
    assert found["text"] == texts and min(found["chunk"]) == 3 << 32
    size = Counter()
    for c, t in zip(found["chunk"], found["text"]):
        size[c] += len(t)
    assert all(n <= 100 or found["chunk"].count(c) == 1 for c, n in size.items())


@given(st.lists(st.integers(0, (1 << 48) - 1), max_size=200), st.integers(1, 50))
@settings(max_examples=60, deadline=None)
def test_golomb_codes_come_back(values, owners):
    values = np.unique(np.array(values, np.uint64))
    for k in np.unique(owner_of(values, owners)):
        own = values[owner_of(values, owners) == k]
        base = base_of(int(k), owners)
        assert (own >= base).all() and (golomb_decode(golomb_encode(own, base), base) == own).all()


def test_owners_get_a_hot_fingerprint_once_a_sender():
    """Senders of many equal fingerprints, and the last owner's bytes for each of its own."""
    rng = np.random.default_rng(1)
    owners, hot, sent = 16, np.uint64((1 << 48) - 7), []
    for sender in range(4):
        prints = np.concatenate([rng.integers(0, 1 << 48, 50_000, dtype=np.uint64), np.full(40_000, hot)])
        different, counts = np.unique(prints, return_counts=True)
        q = questions(different, counts > 1, owners)
        sent.append((different, {"pid": [sender] * len(q["owner"]), **q}))
    last = [(d, q["prints"][-1], q["many"][-1]) for d, q in sent]
    for different, prints, _ in last:
        n = int((owner_of(different, owners) == owners - 1).sum())
        assert n < 4_000 and (golomb_decode(prints, base_of(owners - 1, owners)) == hot).sum() == 1
        assert (len(prints) - 24) * 8 / n < np.log2((1 << 48) / 50_000) + 2.5
    table = pa.table({"pid": [0, 1, 2, 3], "owner": pa.array([owners - 1] * 4, pa.int32()), "prints": [p for _, p, _ in last], "many": [m for _, _, m in last]})
    for (different, _, _), bits in zip(last, answer(owners, "pid")(table).column("bits").to_pylist()):
        own = different[owner_of(different, owners) == owners - 1]
        told = np.unpackbits(np.frombuffer(bits, np.uint8))[: len(own)].astype(bool)
        assert own[told].tolist() == [hot]

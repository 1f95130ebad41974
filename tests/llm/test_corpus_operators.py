import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazette.llm import chat, decontam, toxicity, warc
from gazette.llm.queries import ORACLE, op3_decontaminate, op6_chat_format, op8_warc, op10_toxicity
from tests.test_catalog import assert_same

# --- decontamination


def test_decontamination_against_sql(spark, sf):
    assert_same(op3_decontaminate(spark, sf), ORACLE["op3_decontaminate"], sf)


ITEM = "A train leaves Paris at 40 km an hour and meets Anna after 3 hours, how far did Anna travel in 3 hours by then"


def test_reparameterised(spark):
    def doc(**x):
        t = ITEM
        for a, b in x.items():
            t = t.replace({"speed": "40", "hours": "3", "name": "Anna"}[a], b)
        return "Some words come before it here. " + t + ". And more words follow."

    second = ITEM.replace("3", "5", 1)  # one of two equal slots changed: another question
    rows = [(1, doc()), (2, doc(speed="55", hours="7", name="Bella")), (3, "Words before. " + second), (4, "nothing of the kind " * 10), (5, doc().lower().replace("anna", "Anna").replace("paris", "Paris")), (6, None)]
    got = {r["doc_id"]: r["kind"] for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, ITEM)], "item_id long, text string")).collect()}
    assert got == {1: "copy", 2: "reparameterised", 5: "copy"}


def test_every_alignment_counts(spark):
    item = "A baker fills 12 trays with fresh rolls every single morning and carries them to the old market square where 12 people buy bread"
    part = "A baker fills 12 trays with fresh rolls every single morning and carries them to the old market square where "
    altered = item.replace("12 people", "30 people")
    rows = [
        (1, part + "there were 30 people buy bread"),
        (3, altered + ". Then again: " + item.replace("A baker", "a baker")),
        (4, altered),
        (5, "so a baker fills 12 trays with fresh rolls every single morning and well carries them to the old market square where 12 people buy bread"),
    ]
    got = {r["doc_id"]: r["kind"] for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert got == {1: "copy", 3: "copy", 5: "copy"}


def test_copies_behind_other_words(spark):
    items = {1: "What is the capital of France?", 2: "Which planet in the solar system has the most known moons?", 3: "Compute 12 + 7 - 3 + 15 * 4 and give 9 numbers.", 4: "Does Maria Lopez often walk to the old harbour?"}
    rows = [
        (1, "Question: What is the capital of France?"),
        (2, "quiz, Which planet in the solar system has the most known moons?"),
        (3, "They asked: Compute 12 + 7 - 3 + 15 * 4 and give 9 numbers."),
        (4, "Next: Does Maria Lopez often walk to the old harbour?"),
        (5, "we know that Paris is the capital of France"),
        (6, "They asked: Compute 12 + 7 - 3 + 15 * 5 and give 9 numbers."),
        (7, "What is the capital of France?"),
    ]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontam.contaminated(d, b).collect()}
    assert got == {(1, 1, "copy"), (2, 2, "copy"), (3, 3, "copy"), (4, 4, "copy"), (7, 1, "copy")}


def test_rows_and_items_stand_for_themselves(spark):
    """Windows of two rows of one doc_id are not added up; texts that share an item_id are all searched; scattered phrases don't count together."""
    words = [f"w{chr(97 + i)}{chr(97 + i)}" for i in range(26)]
    item, other = " ".join(words[:16]), " ".join(words[10:])  # nine windows each
    half = [" ".join(words[:12]), "so " + " ".join(words[4:16])]  # five windows each, eight together
    far = half[0] + " and" * 40 + " " + half[1]
    docs = spark.createDataFrame([(1, half[0]), (1, half[1]), (2, item), (3, other), (4, far), (5, half[0] + " " + half[1])], "doc_id long, text string")
    for order in ([(9, item), (9, other)], [(9, other), (9, item)]):
        got = {r["doc_id"]: r["n_windows"] for r in decontam.contaminated(docs, spark.createDataFrame([*order, (9, other), (None, item)], "item_id long, text string")).collect()}
        assert got == {2: 9, 3: 9, 5: 9}


def test_planted_variants_against_sql(spark, tmp_path):
    """Copies, excerpts, texts with insertions and other parameters of every item, some of them inconsistent, as SQL finds them."""
    import random

    rng = random.Random(5)
    names, some = ["Anna", "Bella", "Carlos", "Dora"], "the old baker walked slowly over green hills with seven cats while rain fell upon quiet towns near rivers".split()
    items, docs = [], []
    for i in range(30):
        body = [rng.choice([*some, rng.choice(names), str(rng.randint(2, 9)), f"{rng.randint(2, 9)} km"]) if rng.random() < 0.6 else rng.choice(some) for _ in range(rng.randint(4, 40))]
        items.append((i if i % 7 else 7, " ".join(body).capitalize() if i % 2 else " ".join(body)))
        change = {n: m for n, m in zip(names, rng.sample(names, 4))} | {str(n): str(m) for n, m in zip(range(2, 10), rng.sample(range(2, 10), 8))}
        other = " ".join(change.get(w, w) for w in items[-1][1].split())
        once = items[-1][1].replace("3", "8", 1).replace("Anna", "Bella", 1)
        cut = items[-1][1].split()
        for k, t in enumerate([items[-1][1], other, once, once + ". " + other, " ".join(cut[len(cut) // 3 :]), " ".join([*cut[: len(cut) // 2], "oh", "well", *cut[len(cut) // 2 :]]), items[-1][1].lower(), " ".join(rng.sample(cut, len(cut)))]):
            docs.append((1000 * k + i, f"Words before: {t}, and behind it."))
    docs += [(5, docs[3][1]), (6, None), (None, docs[0][1]), (8, "")]
    spark.createDataFrame(docs, "doc_id long, text string").toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").toPandas().to_parquet(tmp_path / "benchmark.parquet")
    found = op3_decontaminate(spark, str(tmp_path))
    assert_same(found, ORACLE["op3_decontaminate"], str(tmp_path))
    kinds = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds["copy"] > 60 and kinds["reparameterised"] > 20


def test_items_of_few_words(spark, tmp_path):
    """Items too short for a window are found word for word, as a kind of their own, and drop no document."""
    items = [(1, "Who wrote Hamlet?"), (2, "who painted the ceiling"), (3, "Yes"), (4, "???"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi")]
    docs = [(1, "they asked: who wrote HAMLET, and why"), (2, "Who painted the walls? who painted the ceiling"), (3, "yesterday yes no"), (4, "who wrote the play Hamlet"), (5, items[4][1]), (None, "yes"), (6, None)]
    spark.createDataFrame(docs, "doc_id long, text string").toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").toPandas().to_parquet(tmp_path / "benchmark.parquet")
    found = op3_decontaminate(spark, str(tmp_path))
    assert {(r["doc_id"], r["item_id"], r["kind"]) for r in found.collect()} == {(1, 1, "short"), (2, 2, "short"), (3, 3, "short"), (5, 5, "copy")}
    assert_same(found, ORACLE["op3_decontaminate"], str(tmp_path))
    kept = decontam.drop_contaminated(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()
    assert len(kept) == 6 and 5 not in {r["doc_id"] for r in kept}


def test_short_items_and_shuffled_join(spark, monkeypatch):
    b = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "too short"), (3, None), (4, " ".join(f"w{chr(97 + i)}" for i in range(20)))], "item_id long, text string")
    d = spark.createDataFrame([(1, "x alpha beta gamma delta epsilon zeta y"), (2, "too short"), (3, "q " + " ".join(f"w{chr(97 + i)}" for i in range(15)))], "doc_id long, text string")
    for limit in (decontam.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
        assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, b).collect()} == {(1, 1), (2, 2), (3, 4)}


def test_decontamination_odd(spark, odd, empty):
    b = spark.createDataFrame([(1, "long word " * 10)], "item_id long, text string")
    assert [r["doc_id"] for r in decontam.contaminated(odd, b).collect()] == [5]
    kept = decontam.drop_contaminated(odd, b)
    assert kept.columns == odd.columns and kept.count() == 8
    assert decontam.contaminated(empty, b).count() == 0 and decontam.contaminated(odd, b.where("false")).count() == 0


# --- chat


def test_chat_against_sql(spark, sf):
    assert_same(op6_chat_format(spark, sf), ORACLE["op6_chat_format"], sf)


@given(st.text(alphabet=st.sampled_from(list("\\<s>/[INST]|end a\n")), max_size=40))
@settings(max_examples=200, deadline=None)
def test_unescape(text):
    import re

    t = chat.Template()
    done = re.sub(t.pattern(), r"\1\\", text.replace("\\", "\\\\"))
    assert chat.unescape(done) == text and not any(c in done for c in t.controls)


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST] \\ <|end|>"
    rows = [(1, 0, "system", said), (1, 1, "user", said), (1, 2, "assistant", said), (2, 0, "assistant", "a"), (2, 1, "tool<|text|>", said), (2, 1, None, None), (None, None, "user", "x"), (None, 3, "user", "w")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1]["valid"] and got[1]["turns_sha256"] == digest([("system", said), ("user", said), ("assistant", said)])
    assert got[1]["loss_chars"] == len(said) and got[1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert not got[2]["valid"] and got[2]["turns_sha256"] == digest([("assistant", "a"), ("", ""), ("tool<|text|>", said)])
    assert got[None]["turns_sha256"] == digest([("user", "w"), ("user", "x")])
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


def test_machine():
    m = chat.Machine(chat.Template())
    assert [m.step(r) for r in ("user", "assistant", "user", "user", "tool", "assistant")] == [True, True, True, False, False, True]
    assert m.violations == 2 and m.state == "assistant"


# --- archives


def test_warc_against_sql(spark, sf):
    assert_same(op8_warc(spark, sf), ORACLE["op8_warc"], sf)


@pytest.mark.parametrize("n", [1, 3, 400])
def test_archive_round_trip(n):
    records = [warc.record(i, f"https://x/{i}", b"<html>" + str(i).encode() * 300, 6 + 300 * len(str(i)), hashlib.sha256(b"<html>" + str(i).encode() * 300).hexdigest(), None) for i in range(n)]
    out = io.BytesIO()
    assert warc.write_archive(out, iter(records)) == n
    data = out.getvalue()
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    assert list(warc.read_archive(io.BytesIO(data))) == records
    assert warc.parse(records[0])[:3] == (0, "response", None)
    with pytest.raises(ValueError):
        warc.parse(records[0].replace(b"<html>", b"<HTML>"))


def test_warc_odd(spark):
    big = "page " * 100
    rows = [(5, "u", big), (3, None, big), (3, "u", big), (9, "u\r\nx", big), (None, "u", big), (7, "u", None), (8, "u", ""), (1, "u", "short"), (2, "u", "short"), (4, "u", "é" * 50), (6, "u", "é" * 50)]
    df = spark.createDataFrame([(*r, "k", "d") for r in rows], "page_id long, url string, html string, key string, digest string")
    manifest = warc.write_pages(df)
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(manifest).collect())
    assert got == sorted([("5", "revisit", 3, 500), ("3", "response", None, 500), ("3", "response", None, 500), ("9", "revisit", 3, 500), ("None", "response", None, 500), ("7", "response", None, 0), ("8", "response", None, 0), ("1", "response", None, 5), ("2", "response", None, 5), ("4", "response", None, 100), ("6", "revisit", 4, 100)])
    assert warc.read_archives(warc.write_pages(df.where("false"))).count() == 0


# --- toxicity


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Net(5, 5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((5, 4, toxicity.WORD_DIM + toxicity.CHAR_DIM)).astype(np.float32)
    pad = np.zeros((5, 4), bool)
    pad[4, 1] = True
    y = np.array([1, 0, 1, 0.0])
    _, g, _ = net.loss_and_gradients(x, pad, y)
    for k, v in g.items():
        at = tuple(0 for _ in v.shape)
        old, out = net.p[k][at], []
        for e in (1e-3, -1e-3):
            net.p[k][at] = old + e
            out.append(net.loss_and_gradients(x, pad, y)[0])
        net.p[k][at] = old
        assert abs(v[at] - (out[0] - out[1]) / 2e-3) < 1e-4


def test_windows():
    for n in (0, 1, 32, 33, 48, 49, 100):
        s = toxicity.window_starts(n)
        covered = set()
        for a in s:
            covered |= set(range(a, a + toxicity.WINDOW))
        assert set(range(n)) <= covered and (n < toxicity.WINDOW or s[-1] == n - toxicity.WINDOW)


@pytest.fixture(scope="module")
def model():
    import random

    rng = random.Random(0)
    plain = ["".join(rng.choices(["an", "er", "th", "on", "ti", "re"], k=rng.randint(1, 4))) for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        words = rng.choices(plain, k=rng.randint(5, 150))
        if i % 3 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["nastyword", "zzvile" + rng.choice(plain)]))
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return toxicity.train(texts, labels), plain


def test_learns_words_and_spelling(model):
    net, plain = model
    clean, bad = " ".join(plain[:200]), " ".join(plain[:150] + ["zzvileunseen,"] + plain[150:200])
    s = toxicity.Scorer(net).score([clean, bad, " ".join(plain[:40]) + " Nastyword!", "", None])
    assert s[0] < 0.5 and s[1] > 0.5 and s[2] > 0.5 and s[3] == s[4] < 0.5
    long = " ".join(plain * 100 + ["nastyword"] + plain * 100)
    again = toxicity.Scorer(net)
    assert again.score([long])[0] > 0.5 and abs(again.score([bad])[0] - s[1]) < 1e-5


def test_long_words_are_read_to_their_end(model):
    word = "".join(chr(0x4E00 + k) for k in range(1000))
    for n in (1, 64, 65, 66, 124, 125, 1000):
        parts = toxicity.words_of(word[:n])
        assert max(map(len, parts)) <= 64 and (n > 64 or parts == [word[:n]])
        assert {word[i : i + 5] for i in range(n - 4)} <= {g for p in parts for g in toxicity.ngrams(p)}
    glued = "".join(model[1])[:600]
    a, b = toxicity.Scorer(model[0]).score([glued, glued[:300] + "nastyword" + glued[300:]])
    assert a != b


def plain_score(model, text):
    """One window after another, one word after another."""
    p, h = model.net.p, toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-np.float64(x)))
    words = [toxicity.bare(w) for w in toxicity.words_of(text)]
    words += [None] * (toxicity.WINDOW - len(words))
    scores = []
    for at in sorted({*range(0, max(len(words) - toxicity.WINDOW, 0), toxicity.STEP), len(words) - toxicity.WINDOW}):
        inputs = []
        for w in words[at : at + toxicity.WINDOW]:
            if w is None:
                inputs.append(np.concatenate([p["word"][0], np.zeros(toxicity.CHAR_DIM)]))
                continue
            grams = [model.grams[g] for n in toxicity.SIZES for i in range(len(w) + 3 - n) if (g := f"^{w}$"[i : i + n]) in model.grams] or [0]
            inputs.append(np.concatenate([p["word"][model.vocabulary.get(w, 1)], sum(p["char"][g] for g in grams) / np.sqrt(len(grams))]))
        states = []
        for k in (0, 1):
            state, own = np.zeros(h), []
            for x in inputs if not k else inputs[::-1]:
                a, b = x @ p[f"w{k}"] + p[f"b{k}"], state @ p[f"u{k}"]
                z, r = sigmoid(a[:h] + b[:h]), sigmoid(a[h : 2 * h] + b[h : 2 * h])
                new = np.tanh(a[2 * h :] + r * b[2 * h :])
                state = (1 - z) * new + z * state
                own.append(state)
            states.append(own if not k else own[::-1])
        both = [np.concatenate(s) for s in zip(*states)]
        weight = np.array([np.exp(s @ p["attend"] - (30 if w is None else 0)) for s, w in zip(both, words[at:])])
        scores.append(sigmoid(sum(w * s for w, s in zip(weight / weight.sum(), both)) @ p["out"] + p["bias"][0]))
    return max(scores)


def test_scores_against_plain_passes(model):
    net, plain = model
    texts = ["", plain[0], " ".join(plain[:20]), " ".join(plain[:33]), " ".join(plain[:40] + ["Nastyword!"] + plain[40:77]), "".join(plain[:60]) + " zzvile x", "¿… — «»"]
    got = toxicity.Scorer(net).score(texts)
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-5)


def test_held_out_recall_and_precision(spark):
    """On documents whose labels were never learnt from; sf0.1 has enough labels for a floor."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    model = toxicity.train_on(docs, labels)
    held = docs.join(labels.where("toxic is not null"), "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").select("text", "toxic").collect()
    says = toxicity.Scorer(model).score([r["text"] for r in held]) >= 0.5
    toxic = np.array([r["toxic"] == 1 for r in held])
    print("recall", (says & toxic).sum() / toxic.sum(), "precision", (says & toxic).sum() / says.sum(), "of", len(held), toxic.sum())
    assert (says & toxic).sum() >= 0.85 * toxic.sum() and (says & toxic).sum() >= 0.85 * says.sum()


def test_toxicity_query(spark, sf, texts):
    rows = op10_toxicity(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score_documents(odd, labels).collect()} == {0.0}
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == 9
    assert toxicity.score_documents(empty, labels.where("false")).count() == 0

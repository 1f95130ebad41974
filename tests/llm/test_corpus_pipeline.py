import re

import duckdb
import sentencepiece

import corpus_pipeline
from gazette.llm import toxicity
from gazette.llm.queries import ORACLE, tokenizer
from gazette.staging import stage
from tests.llm.test_corpus_operators import plain_score
from tests.llm.test_dedup import five_word_sets


def not_toxic(rows, spark, sf):
    """By plain passes over every window, with the network that the documents' labels give."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_on(docs, labels)
    return [r for r in rows if plain_score(model, r["text"]) < 0.5]


def first_of_equal(rows, spark, sf):
    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r["text"] or ""), r)
    return list(first.values())


def first_of_near(rows, spark, sf):
    """Components of all pairs whose five-word shingles have a similarity of 0.8 or more."""
    sets, up = five_word_sets({r["doc_id"]: r["text"] for r in rows}), {r["doc_id"]: r["doc_id"] for r in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in up:
        for j in up:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [r for r in rows if root(r["doc_id"]) == r["doc_id"]]


def without_items(rows, spark, sf):
    """By the SQL that lays an item's words on those of a document."""
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [(r["doc_id"], r["text"]) for r in rows])
    c.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    gone = {r[0] for r in c.execute(f"SELECT doc_id FROM ({ORACLE['op3_decontaminate']}) WHERE kind <> 'short'").fetchall()}
    assert gone
    return [r for r in rows if r["doc_id"] not in gone]


STEPS = {"toxicity": not_toxic, "exact dedup": first_of_equal, "SimHash near-dedup": first_of_near, "decontamination": without_items}


def test_stages_against_brute_force(spark, sf):
    """Each stage on what its predecessor kept, and all of them together."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [*STEPS, "SentencePiece"]
    for name, step in corpus_pipeline.STAGES:
        before, out = docs.collect(), stage(step(spark, docs, sf), "test-stage")
        if name in STEPS:
            assert out.columns == docs.columns
            assert sorted(map(tuple, out.collect())) == sorted(map(tuple, STEPS[name](before, spark, sf)))
        docs = out
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in before}
    got = {r["doc_id"]: r for r in docs.collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        ids = library.encode(texts[i])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids)
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf).collect()} == {i: r["ids"] for i, r in got.items()}

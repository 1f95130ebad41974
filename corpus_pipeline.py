"""From raw documents to token ids: five stages over one corpus.

Each function takes (spark, docs, sf_dir). run() writes each stage's result as Parquet in
the shared folder and reads it again for the next one, so that lost executors
cost at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.decontam import drop_contaminated
from gazette.llm.exact_dedup import drop_exact_duplicates
from gazette.llm.pieces import encode_documents
from gazette.llm.queries import tokenizer
from gazette.llm.simhash import drop_near_duplicates
from gazette.llm.toxicity import drop_toxic
from gazette.staging import stage
from gazette.tables import load


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose worst window is toxic with a probability of a half or more."""
    return drop_toxic(docs, load(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of those whose texts are equal but for white space."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold an item of the benchmark, as it stands or re-parameterised."""
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded (the text that the ids stand for)."""
    found = encode_documents(docs, tokenizer("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup), ("decontamination", decontaminate), ("SentencePiece", encode)]

#: A network and a tokenizer are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, "pipeline-" + name.replace(" ", "-"))
    return docs

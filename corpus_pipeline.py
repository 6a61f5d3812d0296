"""From raw documents to encoded training text: toxicity filter, exact and near deduplication, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet before the next
one reads it. No stage can be stated in SQL (training, hashing and tokenising), so there is none.

Defined results: null texts count as empty, and of empty and blank texts one stays behind exact deduplication, which near
deduplication and mixing keep; rows with a null identifier are documents, but never copies by near deduplication; rows
that share an identifier are one document in near deduplication, rows of their own elsewhere; ties go to the smallest
identifier; an empty table gives empty results; further columns are carried on unread, whatever their names, to the last
stage, which returns doc_id, ids and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.llm import bpe, exact_dedup, minhash, mixing, queries, toxicity
from lumensift.llm.common import stored, table

#: Documents that score this or more are rejected.
TOXIC = 0.3


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier takes for toxic. It learns from the labelled documents of sf_dir; labels of
    documents that aren't there, and null labels, teach nothing; without labels of both kinds all rows stay. Null and
    empty texts score 0 and stay."""
    model = toxicity.train(table(spark, sf_dir, "documents"), toxicity.toxic_labels(table(spark, sf_dir, "labels")))
    if model.rate is not None:  # nothing tells toxic documents apart: none is rejected
        return docs
    return toxicity.score_rows(docs, model).where(F.col("score") < TOXIC).select("doc.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each text, white space aside: the one of the smallest doc_id."""
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group that links of similarity 0.8 on five-word shingles join."""
    return minhash.drop_near(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix takes them; a document at its source's cut is there with its first words."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text of each row."""
    return bpe.encode(docs, queries.tokenizer())


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

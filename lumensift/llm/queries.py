"""The queries op1 to op10: each applies its operator to a whole table and derives the columns that it promises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.llm import bpe, chat, exact_dedup, minhash, mixing, ngrams, secrets, suffix, toxicity, vectors
from lumensift.llm.common import table


def tokenizer() -> str:
    """The file of the tokenizer that op7 and the pipeline use; every machine has it at the same place."""
    from public_tokenizers import path

    return str(path("word_bpe_49k.json"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix.remove_repeats(table(spark, sf_dir, "documents"), 200)
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.toxic_labels(table(spark, sf_dir, "labels"), held_out=2))
    got = toxicity.score(docs, model)
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 2, F.lit(False))
    predicted = (F.col("score") >= 0.3).cast("int")
    return got.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), F.size("offending").cast("long").alias("n_offending"))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    kinds = [k for k, *_ in secrets.PATTERNS]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return got.select("doc_id", *[count(k).alias(f"n_{k}") for k in kinds], F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), words=2, percent=80)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode(table(spark, sf_dir, "documents"), tokenizer())
    return got.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ngrams.backoff_scores(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), "n_backoff")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = [(-1, n, role, "</s>[INST] ok [/INST]") for n, role in enumerate(("user", "assistant"))]
    turns = turns.unionByName(spark.createDataFrame(both, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_conversations(turns))

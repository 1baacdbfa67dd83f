"""From documents to tokens: known language, no repeated lines, no near copies, no benchmark items, encoded.

Each stage takes the documents that the one before it kept, written as Parquet and read again, and its decisions take
effect: rows go, or their text is cut. All stages but the last return the columns of ``documents``. Rows with null or
empty text go in the first stage, as no language fits them; an empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelproof.llm import bpe, decontam, langid, line_dedup, ngram_join
from labelproof.llm.columns import unused
from labelproof.llm.folds import fold
from labelproof.session import stored

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = "[^\\x20\\x09-\\x0D]"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the model learns from three quarters of the labelled ones."""
    training = F.coalesce(fold("doc_id", 4) != 2, F.lit(False))
    model = langid.fit(docs, "doc_id", "text", "lang", training)
    return langid.known_language(docs, "text", model)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; documents of which no word is left go."""
    removed = unused(docs, "n_removed")
    cut = line_dedup.deduplicated(docs, "doc_id", "text", lines=unused(docs, "n_lines"), removed=removed)
    left = cut.filter((F.col(removed) == 0) | F.col("text").rlike(WORD))
    size = F.char_length("text").cast("long")
    return left.withColumn("n_chars", F.when(F.col(removed) > 0, size).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies."""
    return ngram_join.representatives(docs, "doc_id", "text")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.clean_documents(docs, items, "text", "item_id", "text")


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and the digest of the text decoded from them."""
    encoder = bpe.BytePairEncoder(bpe.read_ranks(VOCABULARY), public_tokenizers.PATTERN)
    return bpe.round_trip(docs, ["doc_id", "lang", "source"], "text", encoder, "token_ids").select(
        "doc_id",
        "lang",
        "source",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

# Trained dictionaries and byte pair merges have no SQL; tests/llm/test_pipeline.py compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

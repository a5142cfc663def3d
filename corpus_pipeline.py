"""From documents to token ids in five stages: quality rules, line dedup, near duplicates, decontamination, encoding."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from invoicelens.llm import bpe_transducer, jaccard_join, line_dedup, quality_rules, wu_manber
from invoicelens.session import releasing_shuffles, shared_folder


def reject_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.filter_documents(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so does a document that had words and has none left. ``n_chars`` follows the text."""
    removed = "removed_lines"
    while removed in docs.columns:
        removed += "_"
    counted = line_dedup.dedup_lines(docs, count_as=removed)
    left = counted.filter((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", F.when(F.col(removed) > 0, length).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return wu_manber.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of the documents that are left."""
    return bpe_transducer.digest_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", reject_by_rules),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("byte_bpe", encode),
]
ORACLE_SQL = None  # fuzzy lines and token ids can't be told in SQL; tests hold the rows against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage leaves is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/corpus-{name}-{uuid.uuid4().hex}"
        with releasing_shuffles(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import (
    additive_model, bin_packing, bpe_counts, bpe_transducer, jaccard_join, license_join, line_dedup, oracle, personal_data,
    pivot_search, quality_rules, spelling_variants, turn_repair, wu_manber,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_transducer.digest_documents(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"), count_as="n_removed")
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("bigint")
    return kept.select("doc_id", (F.col("n_removed") + F.when(F.col("text").isNull(), 0).otherwise(n_lines)).alias("n_lines"), "n_removed",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return personal_data.digest(personal_data.find_spans(docs, personal_data.train(docs)))


def op4_bin_packing(spark: SparkSession, folder: str) -> DataFrame:
    placed = bin_packing.assign_shards(table(spark, folder, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_join.scan_documents(table(spark, folder, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_counts.count_tokens(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7_additive_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = additive_model.score_documents(docs, additive_model.train(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", additive_model.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return wu_manber.digest(wu_manber.search_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, folder, "documents"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.measure_documents(table(spark, folder, "documents"))


def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.audit_conversations(turn_repair.damaged(table(spark, folder, "conversations")))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.group_variants(spelling_variants.count_words(table(spark, folder, "documents")))


def op13_pivot_search(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_search.top_k(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, 10)


def queries() -> dict[str, Query]:
    operators = (op1_byte_bpe, op2_line_dedup, op3_personal_data, op4_bin_packing, op5_license_scan, op6_token_counts,
                 op7_additive_model, op8_decontamination, op9_jaccard_join, op10_quality_rules, op11_turn_repair, op12_spelling_variants, op13_pivot_search)
    return {**{f.__name__: f for f in operators}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return oracle.all_sql()

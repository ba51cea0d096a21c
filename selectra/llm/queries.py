"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from selectra.llm import (
    decontamination, hard_negatives, line_dedup, lm_scoring, ngram_join, packing, piece_encoding, quality_rules, sharding,
    substring_dedup, token_counts, toxicity, vector_codes)
from selectra.llm.queries_sql import CODES_SQL, NEGATIVES_SQL, QUALITY_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, statement: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if statement is not None:
            SQL[name] = statement
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_quality_rules", QUALITY_SQL)
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.clean(table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "text", F.col("_deleted").alias("n_deleted"))


@query("op4_ngram_join")
def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    groups = ngram_join.join_groups(table(spark, folder, "documents"), ngram_join.Likeness(n=3, num=9, den=10))
    return groups.select("doc_id", "n_shingles", "component_id")


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    redacted = token_counts.with_redactions(table(spark, folder, "documents"))
    counts = token_counts.edited_counts(redacted, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return counts.withColumn("edited_crc32", F.crc32(F.col("edited").cast("binary"))).drop("edited")


@query("op6_lm_scoring")
def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score(table(spark, folder, "documents"))


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op8_sharding")
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.document_rows(table(spark, folder, "documents"))
    placed = sharding.assign_shards(rows, F.col("doc_id"))
    return placed.withColumn("law", F.lit("key"))


@query("op9_packing")
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.digest(packing.pack_documents(table(spark, folder, "documents"), vocabulary))


@query("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.passages(table(spark, folder, "documents"))


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    relabelled = table(spark, folder, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(hard_negatives.whole_rows(relabelled))


@query("op12_piece_encoding")
def op12_piece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    return piece_encoding.digest_documents(table(spark, folder, "documents"), vocabulary)


@query("op13_vector_codes", CODES_SQL)
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.coded_rows(table(spark, folder, "embeddings"))

"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, packing.

Each stage takes what its predecessor kept and returns the columns of documents, the last one training windows. Rows
with nulls pass the filters they cannot fail; extra columns are carried, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from selectra.llm import decontamination, line_dedup, ngram_join, packing
from selectra.llm import toxicity as toxic_texts
from selectra.session import shared_dir


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: the columns of documents that a filtering stage reads or writes
READ = ("doc_id", "text", "lang", "n_chars")


def with_any_columns(stage: Stage) -> Stage:
    """The stage on documents whose other columns may have any names, those of its own results included: they are
    numbered on the way in and named again on the way out."""

    @functools.wraps(stage)
    def named_again(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        numbered = [c if c in READ else f"column_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*numbered), sf_dir).toDF(*docs.columns)

    return named_again


@with_any_columns
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language."""
    model = toxic_texts.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxic_texts.score(docs, model).where(~F.col("_rejected")).select(*docs.columns)


@with_any_columns
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that they share with an earlier one; those of which nothing is left go."""
    cleaned = line_dedup.clean(docs)
    left = (F.col("_deleted") == 0) | (F.trim(F.translate("text", "\t\n\x0b\f\r", "     ")) != "")
    changed = F.when(F.col("_deleted") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars").cast("bigint"))
    return cleaned.where(left).select(*[changed.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


@with_any_columns
def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the one with the smallest id; documents
    without words are in no group."""
    return ngram_join.one_of_each(docs, ngram_join.Likeness())


@with_any_columns
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    marked = decontamination.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(F.size("_leaks") == 0).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows, a row per piece."""
    return packing.digest(packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: no SQL form: a fitted classifier, alignments and packing
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

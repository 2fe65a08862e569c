"""Corpus pipeline: quality filter, exact dedup, near dedup, decontamination, BPE coding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tomewise.llm import decontaminate, exact_dedup, ngram_join, quality
from tomewise.llm.common import passing, remove, shared_path
from tomewise.llm.queries import bpe_digests, table, tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones."""
    return ngram_join.keep_one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of each document and of what they decode to."""
    return bpe_digests(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_coding),
]

#: The first stage is a learned model, so no SQL gives the pipeline's rows; tests hold it against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages; what a stage leaves in the shared folder goes once the next one's documents are written."""
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, "stage")
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        remove(spark, before)
        before, docs = [path], spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

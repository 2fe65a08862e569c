"""Exact deduplication by skew-safe combining.

Rows are first merged inside each input split: the salt is the number of the split, so the partial aggregate of (digest, salt, text)
leaves one row for each text and split. These are merged by (digest, salt, text), then the winners of all salts by (digest, text).
Text itself is a grouping key at each stage, so equality is always that of full content; a text that fills a third of all rows comes
to each task as one fixed-size row of each split.

Rows are told of their winner by SHA-256 alone: the last stage has compared full content and found one text for each digest, and
stops the job if there were two. That join salts digests of many rows.

Defined results: null text counts as empty; all empty texts are one group; a repeated row joins its group and counts in
``group_size``; of rows with the largest doc_id, all repeated ones count as kept; rows with null doc_id never win over
others and have ``kept`` false unless their whole group has none; an empty table gives an empty result; extra columns are
ignored. ``drop_exact_duplicates`` tells rows by id and text, so another text under a repeated id is never dropped with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewise.llm.common import id_text, join_salted, materialize, shuffle_partitions, text_key, without


def _digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_text(df, id_col, text_col).withColumn("digest", F.unhex(F.sha2("text", 256)))


def _winners(rows: DataFrame) -> DataFrame:
    """One row per distinct text: digest, the winning id and the size of its group."""
    # About a square root of the splits: a text comes to a salt from as many splits as its winners come to the last stage from salts.
    salts = max(2, round(shuffle_partitions(rows.sparkSession) ** 0.5))
    best = lambda size: (F.max("keep_id").alias("keep_id"), F.sum(size).alias("group_size"))
    local = rows.select("digest", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"), "text", F.col("doc_id").alias("keep_id"))
    salted = local.groupBy("digest", "salt", "text").agg(*best(F.lit(1)))
    whole = salted.repartition("digest").groupBy("digest", "text").agg(*best("group_size"))
    # One row per digest is left unless two texts share it; both aggregations read the one shuffle by digest.
    one = whole.groupBy("digest").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    safe = F.when(F.col("texts") > 1, F.raise_error(F.lit("two different texts have one SHA-256 digest"))).otherwise(F.col("group_size"))
    return one.select("digest", "keep_id", safe.cast("long").alias("group_size"))


def _told(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest and more columns of each row."""
    rows = _digests(df, id_col, text_col)
    told = join_salted(rows.select("doc_id", "digest", *more), materialize(_winners(rows), "winners"), ["digest"], "group_size")
    return told.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    return _told(df, id_col, text_col).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id wins the group of their text, with all their columns; rows with null id stay."""
    return without(df, _told(df, id_col, text_col, *text_key("text")).where("not kept and doc_id is not null").select("doc_id", "t1", "t2"), id_col, text_col)

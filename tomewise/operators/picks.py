"""One row or value out of a group, always by a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Per key the columns of the row that comes first (nulls in the order come last). Combines before the shuffle; structs are compared by a sort aggregate."""
    rank = [c for o in order for c in (o.isNull(), o)]
    first = F.min(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(rank)), *(F.col(c).alias(c) for c in columns)))
    return df.groupBy(*keys).agg(first.alias("first")).select(*keys, *(F.col(f"first.{c}").alias(c) for c in columns))


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Whole rows: the first of each key in a given total order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place_", place).where("place_ = 1").drop("place_")


def first_occurrence(df: DataFrame, keys: list[str], value: str, position: str, out_order: str) -> DataFrame:
    """Distinct values of each key, numbered from 1 in order of their first position."""
    first = df.groupBy(*keys, value).agg(F.min(position).alias("first_"))
    return first.select(*keys, value, F.row_number().over(Window.partitionBy(*keys).orderBy("first_", value)).alias(out_order))


def majority(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Per key the most frequent value, the smallest of equally frequent ones. Two aggregations, both combined before their shuffle."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n_"))
    best = F.min(F.struct((-F.col("n_")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col("best.v").alias(out))


def narrow_if_any(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Rows that meet the condition where any row of their key does, else all rows of the key."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumn("hit_", hit).withColumn("any_", F.max("hit_").over(Window.partitionBy(*keys))).where("hit_ or not any_").drop("hit_", "any_")

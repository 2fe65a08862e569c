"""Keyed merges, differences and set operations of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewise.operators.picks import first_wins


def keyed_merge(current: DataFrame, new: DataFrame, key: str, replaced: DataFrame | None = None) -> DataFrame:
    """``current`` without the keys of ``replaced`` (of ``new`` if not given), plus ``new``."""
    return current.join((replaced if replaced is not None else new).select(key).distinct(), key, "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def insert_or_ignore(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return current.unionByName(new.join(current.select(key), key, "left_anti").dropDuplicates([key]))


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``keys``."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def map_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change, old and new value) of keys added, removed or changed. A null value isn't the same as a missing key."""
    a = old.select(key, F.col(value).alias("old_value"), F.lit(True).alias("in_old"))
    b = new.select(key, F.col(value).alias("new_value"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"), "old_value", "new_value").where("change is not null")


def full_outer_by_position(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pair children of two tables by key and position; either side may be missing."""
    return left.join(right, keys, "full_outer")


def union_distinct(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts).distinct()


def duplicates(df: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(out)).where(F.col(out) > 1)


def latest_result(current: DataFrame, results: DataFrame, key: str, status: str, order: list[str | Column]) -> DataFrame:
    """Merge fetch results: an ``error`` replaces only what is missing or itself an error. Of several results of a key the first in ``order`` counts."""
    one = first_wins(results, [key], order)
    was = current.select(key, F.col(status).alias("was_"))
    taken = one.join(was, key, "left").where((F.col(status) != "error") | F.col("was_").isNull() | (F.col("was_") == "error")).drop("was_")
    return keyed_merge(current, taken, key)


def key_candidates(df: DataFrame, row: str, key: str) -> DataFrame:
    """Per row that shares a key with other rows the smallest of these (``candidate``) and how often it shares a key with another row (``n``).

    Each key is told by its count and its two smallest rows, so no pair of rows is made. Null keys are shared with none."""
    keys = df.where(F.col(key).isNotNull() & F.col(row).isNotNull()).select(row, key).distinct()
    of = keys.groupBy(key).agg(F.count("*").alias("of_"), F.min(row).alias("lowest_")).where("of_ > 1")
    second = keys.join(of, key).where(F.col(row) > F.col("lowest_")).groupBy(key).agg(F.min(row).alias("second_"))
    other = F.when(F.col(row) == F.col("lowest_"), F.col("second_")).otherwise(F.col("lowest_"))
    return keys.join(of.join(second, key), key).groupBy(row).agg(F.min(other).alias("candidate"), F.sum(F.col("of_") - 1).alias("n"))

"""Top-k, pages and search with stable results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewise.operators.lists import any_of


def top(df: DataFrame, order: list[Column], n: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + n`` in an order that ends in a unique column; ``n`` 0: all of them."""
    ordered = df.orderBy(*order)
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(n) if n else ordered


def with_total(df: DataFrame, order: list[Column], n: int, out: str = "total") -> DataFrame:
    """The first ``n`` rows, each with the number of all rows. The count is an aggregate of one row, not a window over a single task."""
    total = df.agg(F.count("*").alias(out))
    return df.orderBy(*order).limit(n).crossJoin(F.broadcast(total))


def matches(columns: list[str], term: str) -> Column:
    """Any column contains ``term``, without regard to case; no character of ``term`` is special."""
    return any_of([F.contains(F.lower(F.col(c)), F.lower(F.lit(term))) for c in columns])


def search(df: DataFrame, columns: list[str], term: str, child: DataFrame | None = None, key: str | None = None, child_column: str | None = None) -> DataFrame:
    """Rows that contain ``term`` themselves or have a child row that does (an existence join; keys are made distinct before their shuffle, so that no task gets all child rows of a frequent key)."""
    hit = F.coalesce(matches(columns, term), F.lit(False))
    if child is None:
        return df.where(hit)
    own = child.select(F.col(key).alias("key_"), F.col(child_column).alias("text_")).where(matches(["text_"], term)).select("key_").distinct()
    # unqualified, the key would be looked up below the child's projection first, where a column of that name is compared to itself
    return df.alias("row_").where(hit | own.where(F.col("key_") == F.col(f"row_.{key}").outer()).exists())


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

"""Ordered lists of child rows, their defaults, and predicates over lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_list(child: DataFrame, keys: list[str], order: list[str | Column], value: str, out: str) -> DataFrame:
    """One row per key with its values as a list in the given order. The order must be total for a defined result."""
    by = [F.expr(c) if isinstance(c, str) else c for c in order]
    packed = F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(by)), F.col(value).alias("v"))))
    return child.groupBy(*keys).agg(F.transform(packed, lambda s: s["v"]).alias(out))


def list_or_empty(name: str, kind: str = "string") -> Column:
    return F.coalesce(F.col(name), F.expr(f"cast(array() as array<{kind}>)"))


def with_list(parent: DataFrame, child: DataFrame, key: str, order: list[str | Column], value: str, out: str, empty: bool = True, kind: str = "string") -> DataFrame:
    """``parent`` with the ordered list of its children; a parent without any has an empty list, or null if ``empty`` is false."""
    joined = parent.join(ordered_list(child, [key], order, value, out), key, "left")
    return joined.withColumn(out, list_or_empty(out, kind)) if empty else joined


def split_explode(df: DataFrame, keys: list[str], text: str, separator: str, out: str, order: str) -> DataFrame:
    """Split a column at a literal separator, trim, drop empty parts and number the rest from 1."""
    parts = F.filter(F.transform(F.split(F.col(text), f"\\Q{separator}\\E"), trimmed), lambda x: x != "")
    return df.select(*keys, F.posexplode(parts).alias("at", out)).select(*keys, (F.col("at") + 1).alias(order), out)


#: White space that is trimmed: Unicode's, plus the four ASCII separators. Fixed values.
_BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"


def trimmed(c: Column) -> Column:
    """Strip Unicode white space at both ends (SQL ``trim`` strips spaces only)."""
    return F.regexp_replace(c, rf"^{_BLANK}+|{_BLANK}+$", "")


def overlaps(name: str, values: list) -> Column:
    return F.arrays_overlap(F.col(name), F.array(*map(F.lit, values)))


def contains_text(name: str, term: str) -> Column:
    """A list's values joined by spaces contain ``term``, without regard to case."""
    return F.contains(F.lower(F.array_join(name, " ")), F.lit(term.lower()))


def common_values(df: DataFrame, keys: list[str], order: list[str], values: str, out: str) -> DataFrame:
    """Per key the values of the first row's list that every other row's list has, in the first row's order, repeats kept."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col(values).alias("v"))))
    lists = df.groupBy(*keys).agg(F.transform(packed, lambda s: s["v"]).alias("lists"))
    return lists.select(*keys, F.filter(F.element_at("lists", 1), lambda x: F.forall("lists", lambda rest: F.array_contains(rest, x))).alias(out))


def common_value(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Per key the value that all rows have, null if they differ or any is null."""
    same = (F.count(value) == F.count("*")) & (F.min(value) == F.max(value))
    return df.groupBy(*keys).agg(F.when(same, F.max(value)).alias(out))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)

"""The catalogue export: a JSON array of books, validated as a whole and normalised.

The document is read as one VARIANT, which keeps booleans, integers and decimals apart. All errors are gathered before anything
is written."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewise.functions import fields, udfs
from tomewise.operators.lists import split_explode, trimmed
from tomewise.sources.store import Store

#: Keys of a book and the end of valid times in milliseconds. Fixed values.
REQUIRED, OPTIONAL, TIME_END = ("acquiredTime", "asin", "authors", "readStatus", "title"), ("productImage",), 4102444800000
_TEXT = ("title", "authors", "readStatus", "asin")


def _kind(key: str) -> Column:
    """SQL type of a value, ``VOID`` for JSON null, null where the key is missing."""
    return F.schema_of_variant(F.expr(f"variant_get(v, '$.{key}', 'variant')"))


def _text(key: str) -> Column:
    return F.when(_kind(key) == "STRING", F.expr(f"try_variant_get(v, '$.{key}', 'string')"))


def read_items(spark: SparkSession, path: str | Path) -> DataFrame:
    """(pos, v) of the array's items."""
    location = Path(path).resolve()
    if not location.is_file():
        raise FileNotFoundError(f"File not found: {path}")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last of repeated keys counts
    root = spark.read.text(location.as_uri(), wholetext=True).select(F.expr("try_parse_json(value)").alias("root"))
    try:
        kind = root.select(F.schema_of_variant("root").alias("kind"), F.col("root").isNull().alias("bad")).first()
    except PySparkException as e:
        raise ValueError(f"Invalid JSON: {path}") from e
    if kind is None or kind["bad"]:
        raise ValueError(f"Invalid JSON: {path}")
    if not kind["kind"].startswith("ARRAY"):
        raise ValueError("the root of the library JSON must be an array")
    return root.select(F.expr("variant_get(root, '$', 'array<variant>')").alias("items")).select(F.posexplode("items").alias("pos", "v"))


def problems(items: DataFrame) -> DataFrame:
    """(pos, errors, unknown) of items with errors or unknown keys."""
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    asin = F.when(is_object, _text("asin"))
    label = F.when(trimmed(asin) != "", F.concat(F.lit("ASIN "), asin)).otherwise(F.concat(F.lit("index "), F.col("pos")))
    found = []
    for key in REQUIRED:
        kind = _kind(key)
        missing = kind.isNull() | (kind == "VOID") | F.coalesce(trimmed(_text(key)) == "", F.lit(False))
        found.append(F.when(missing, F.concat(label, F.lit(f": missing or empty required key '{key}'"))))
    for key in _TEXT:
        found.append(F.when(~_kind(key).isin("STRING", "VOID"), F.concat(label, F.lit(f": '{key}' must be str"))))
    found.append(F.when(~_kind("productImage").isin("STRING", "VOID"), F.concat(label, F.lit(": 'productImage' must be str or null"))))
    kind, value = _kind("acquiredTime"), F.expr("try_variant_get(v, '$.acquiredTime', 'decimal(38,0)')")
    whole = (kind == "BIGINT") | F.regexp_like(kind, F.lit(r"^DECIMAL\((19|[23]\d),0\)$"))  # 1.0 is DECIMAL(1,0)
    found.append(F.when(~whole & (kind != "VOID"), F.concat(label, F.lit(": 'acquiredTime' must be int epoch milliseconds"))))
    found.append(F.when(whole & ~((value >= 0) & (value < TIME_END)), F.concat(label, F.lit(f": 'acquiredTime' must satisfy 0 <= acquiredTime < {TIME_END}"))))
    errors = F.when(is_object, F.filter(F.array(*found), lambda e: e.isNotNull())).otherwise(F.array(F.concat(F.lit("index "), F.col("pos"), F.lit(": each item must be an object"))))
    keys = F.when(is_object, F.map_keys(F.expr("try_variant_get(v, '$', 'map<string,variant>')")))
    unknown = F.array_sort(F.array_except(keys, F.array(*map(F.lit, [*REQUIRED, *OPTIONAL]))))
    return items.select("pos", errors.alias("errors"), label.alias("label"), F.coalesce(unknown, F.expr("cast(array() as array<string>)")).alias("unknown"), asin.alias("asin"))


def validate(items: DataFrame, warn: Callable[[str], None] | None = None) -> None:
    """Raise one ``ValueError`` with all errors in order; warn of unknown keys."""
    checked = problems(items)
    repeated = checked.where(trimmed(F.col("asin")) != "").groupBy("asin").agg(F.count("*").alias("n")).where("n > 1").orderBy("asin")
    errors = [e for r in checked.where(F.size("errors") > 0).orderBy("pos").select("errors").collect() for e in r["errors"]]
    if twice := [r["asin"] for r in repeated.collect()]:
        errors.append(f"Duplicate ASIN values: {', '.join(twice)}")
    if warn is not None:
        for r in checked.where(F.size("unknown") > 0).orderBy("pos").collect():
            warn(f"{r['label']}: ignoring unknown keys: {', '.join(r['unknown'])}")
    if errors:
        raise ValueError("; ".join(errors))


def normalise(items: DataFrame, imported_at: datetime) -> tuple[DataFrame, DataFrame]:
    """(books, book_authors) of valid items."""
    books = items.select(
        _text("asin").alias("asin"), udfs.unescape_html(_text("title")).alias("title"), udfs.unescape_html(_text("authors")).alias("authors_text"),
        fields.utc_of_millis(F.expr("try_variant_get(v, '$.acquiredTime', 'bigint')")).alias("acquired_at"), _text("readStatus").alias("read_status"),
        fields.blank_to_null(_text("productImage")).alias("product_image_url"), F.lit(imported_at).cast("timestamp_ntz").alias("imported_at"),
    )
    return books, split_explode(books, ["asin"], "authors_text", ", ", "author_name", "author_order")


def import_library(spark: SparkSession, store: Store, path: str | Path, now: datetime, warn: Callable[[str], None] | None = None) -> int:
    """Replace the catalogue by the export's. The number of books."""
    items = read_items(spark, path).cache()
    try:
        validate(items, warn)
        books, authors = normalise(items, now)
        count = items.count()
        store.commit({"books": books, "book_authors": authors}, {"import_metadata": {"source_path": str(Path(path).resolve()), "source_type": "json", "books_count": count, "imported_at": now}})
        return count
    finally:
        items.unpersist()

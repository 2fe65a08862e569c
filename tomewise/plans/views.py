"""The nine views of a library, each a function of its tables; children are aggregated once and joined, never looked up per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewise.operators.lists import with_list
from tomewise.operators.merging import full_outer_by_position
from tomewise.operators.picks import majority, pick
from tomewise.plans.schema import SINGLES, TABLES
from tomewise.sources.store import Store

Read = Callable[[str], DataFrame]
BOOK_COLUMNS = [
    "asin", "title", "authors", "authors_text", "read_status", "product_image_url", "acquired_at", "genres", "series_title", "series_asin", "series_position", "author_ids", "author_names_official",
    "isbn", "paper_issued", "publisher", "pages", "bib_series", "ndc", "ndc_label", "subjects", "bib_notes", "bib_match", "bib_status",
]

def _series_asin():
    return F.nullif(F.col("series_asin"), F.lit("")).alias("series_asin")


def v_books(t: Read) -> DataFrame:
    """One row per book. ``authors`` is null for a book without any; other lists are empty."""
    books = with_list(t("books"), t("book_authors"), "asin", ["author_order"], "author_name", "authors", empty=False)
    for child, order, value, out in (
        ("book_genres", "genre", "genre", "genres"), ("book_author_ids", "author_order", "author_id", "author_ids"), ("book_author_names", "author_order", "author_name", "author_names_official"),
        ("bib_subjects", "subject_order", "subject", "subjects"), ("bib_notes", "note_order", "note", "bib_notes"),
    ):
        books = with_list(books, t(child), "asin", [order], value, out)
    order = [F.col(c) for c in ("series_title", "position_in_collection", "series_asin")]
    series = pick(t("book_series").where("relation_type = 'PRIMARY'"), ["asin"], order, ["series_title", "series_asin", "position_in_collection"])
    series = series.select("asin", "series_title", _series_asin(), F.col("position_in_collection").alias("series_position"))
    found = t("bib_matches").withColumnRenamed("method", "bib_match").drop("candidate_ids", "ndc_edition", "matched_at")
    status = t("bib_fetches").select("asin", F.col("status").alias("bib_status"))
    labels = t("v_ndc_labels").withColumnRenamed("label", "ndc_label")
    joined = books.join(series, "asin", "left").join(found, "asin", "left").join(status, "asin", "left")
    return joined.join(labels, F.substring("ndc", 1, 3) == F.col("ndc3"), "left").select(*BOOK_COLUMNS)


def v_author_counts(t: Read) -> DataFrame:
    return t("book_authors").groupBy("author_name").agg(F.count_distinct("asin").alias("book_count"))


def v_book_genres(t: Read) -> DataFrame:
    return t("books").join(t("book_genres"), "asin").select("asin", "title", "genre")


def v_book_series(t: Read) -> DataFrame:
    return t("books").select("asin", "title").join(t("book_series"), "asin").select(_series_asin(), "series_title", F.col("position_in_collection").alias("series_position"), "asin", "title", "relation_type")


def v_series_counts(t: Read) -> DataFrame:
    rows = t("books").select("asin").join(t("book_series").where("relation_type = 'PRIMARY'"), "asin")
    return rows.groupBy(_series_asin(), "series_title").agg(F.count_distinct("asin").alias("book_count"))


def v_genre_counts(t: Read) -> DataFrame:
    return v_book_genres(t).groupBy("genre").agg(F.count_distinct("asin").alias("book_count"))


def v_book_authors_official(t: Read) -> DataFrame:
    return full_outer_by_position(t("book_author_ids"), t("book_author_names"), ["asin", "author_order"]).join(t("books").select("asin"), "asin", "left_semi").select("asin", "author_order", "author_id", "author_name")


def v_author_id_counts(t: Read) -> DataFrame:
    """Books per author id, with the name most of them give it; books without a name for the id don't vote."""
    ids = t("book_author_ids").join(t("books").select("asin"), "asin", "left_semi")
    names = majority(ids.join(t("book_author_names"), ["asin", "author_order"]), ["author_id"], "author_name", "author_name")
    counts = ids.groupBy("author_id").agg(F.count_distinct("asin").alias("book_count"))
    return counts.join(names, "author_id", "left").select("author_id", F.coalesce("author_name", F.lit("(unknown)")).alias("author_name"), "book_count")


VIEWS: dict[str, Callable[[Read], DataFrame]] = {f.__name__: f for f in (v_books, v_author_counts, v_book_genres, v_book_series, v_series_counts, v_genre_counts, v_book_authors_official, v_author_id_counts)}


def reader(spark: SparkSession, store: Store, labels: DataFrame) -> Read:
    """Tables and views by name."""

    def read(name: str) -> DataFrame:
        if name == "v_ndc_labels":
            return labels
        return VIEWS[name](read) if name in VIEWS else store.read(spark, name)

    return read


def register(spark: SparkSession, store: Store, labels: DataFrame) -> list[str]:
    """Make all tables and views temporary views of the session."""
    read = reader(spark, store, labels)
    names = [*TABLES, *SINGLES, "v_ndc_labels", *VIEWS]
    for name in names:
        read(name).createOrReplaceTempView(name)
    return names

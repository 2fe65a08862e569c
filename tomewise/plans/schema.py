"""Tables of the library store: schemas, keys, and a hash that names their version."""

from __future__ import annotations

import hashlib

from pyspark.sql.types import StructType, _parse_datatype_string

#: Columns of each table, its key, and columns that may not be null.
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "books": ("asin string, title string, authors_text string, acquired_at timestamp_ntz, read_status string, product_image_url string, imported_at timestamp_ntz", ("asin",)),
    "book_authors": ("asin string, author_name string, author_order int", ("asin", "author_order")),
    "book_genres": ("asin string, genre string", ("asin", "genre")),
    "book_series": ("asin string, series_asin string, series_title string, series_author string, series_author_id string, position_in_collection int, relation_type string", ("asin", "series_asin", "relation_type")),
    "book_author_ids": ("asin string, author_id string, author_order int", ("asin", "author_order")),
    "book_author_names": ("asin string, author_name string, author_order int", ("asin", "author_order")),
    "bib_fetches": ("asin string, status string, source string, stages string, error string, fetched_at timestamp_ntz", ("asin",)),
    "bib_candidates": ("asin string, candidate_id string, search_rank int, item_xml string", ("asin", "candidate_id")),
    "bib_matches": ("asin string, method string, candidate_ids array<string>, isbn string, paper_issued string, publisher string, pages int, bib_series string, ndc string, ndc_edition string, matched_at timestamp_ntz", ("asin",)),
    "bib_subjects": ("asin string, subject string, subject_order int", ("asin", "subject_order")),
    "bib_notes": ("asin string, note string, note_order int", ("asin", "note_order")),
    "bib_overrides": ("asin string, isbn string", ("asin",)),
    "bib_refetch_done": ("asin string", ("asin",)),
}
#: Single rows: kept as fields of the manifest and shown as one-row tables.
SINGLES: dict[str, str] = {
    "import_metadata": "source_path string, source_type string, books_count int, imported_at timestamp_ntz",
    "import_metadata_official": "source_path string, source_type string, genres_count int, series_count int, author_ids_count int, author_names_count int, distinct_asin_count int, imported_at timestamp_ntz",
    "schema_meta": "schema_hash string",
    "bib_refetch_pending": "mode string, where_clause string, started_at timestamp_ntz",
    "bib_metadata": "last_enrich_at timestamp_ntz, last_enrich_fetched int, last_rematch_at timestamp_ntz, last_rematch_books int, overrides_source_path string, overrides_updated_at timestamp_ntz",
}
IMPORTED, OFFICIAL = ("books", "book_authors"), ("book_genres", "book_series", "book_author_ids", "book_author_names")
BIBLIOGRAPHIC = ("bib_fetches", "bib_candidates", "bib_matches", "bib_subjects", "bib_notes")
SCHEMA_HASH = hashlib.sha256(repr((sorted(TABLES.items()), sorted(SINGLES.items()))).encode()).hexdigest()


def struct(name: str) -> StructType:
    return _parse_datatype_string(TABLES[name][0] if name in TABLES else SINGLES[name])

"""The official archive: a zip of CSV sets, normalised with anti-joins, first-wins and first-occurrence ranks."""

from __future__ import annotations

import shutil
import uuid
import zipfile
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewise.functions import fields
from tomewise.operators.lists import trimmed
from tomewise.operators.merging import delete_keys, union_distinct
from tomewise.operators.picks import first_occurrence, first_wins
from tomewise.sources.store import Store

#: Folder of the sets, their names and the columns they must have, and the suffix that holds an id. Fixed values.
BASE = "Kindle.UnifiedLibraryIndex/datasets"
SETS = {
    "genres": ("Kindle.UnifiedLibraryIndex.CustomerGenres_FE", {"ASIN", "Genre"}),
    "relationships": ("Kindle.UnifiedLibraryIndex.CustomerRelationshipIndex_FE", {"ASIN", "Series Title", "Series Author", "Position In Collection", "Relation Type", "Deleted By Customer"}),
    "author_ids": ("Kindle.UnifiedLibraryIndex.CustomerAuthorIdRelationship_FE", {"ASIN", "Author ID"}),
    "author_names": ("Kindle.UnifiedLibraryIndex.CustomerAuthorNameRelationship_FE", {"ASIN", "Author Name"}),
}
SUFFIX = "^(.+) (B[0-9A-Z]{9})$"


def unpack(path: str | Path, into: Path) -> Path:
    """Extract an archive whose members stay inside the folder."""
    path = Path(path)
    if not path.is_file():
        raise FileNotFoundError(f"File not found: {path}")
    if not zipfile.is_zipfile(path):
        raise ValueError(f"Not a zip file: {path}")
    with zipfile.ZipFile(path) as z:
        for member in z.namelist():
            if not (into / member).resolve().is_relative_to(into.resolve()):
                raise ValueError(f"Unsafe path in the archive: {member}")
        z.extractall(into)
    return into


def read_set(spark: SparkSession, root: Path, name: str) -> DataFrame:
    """Rows of a set's files, with ``file`` and ``row`` for their order. Files are small; each is one partition."""
    folder, required = SETS[name]
    files = sorted((root / BASE / folder).glob("*.csv"))
    if not files:
        raise ValueError(f"Required file of the official archive is missing: {folder}/*.csv")
    parts = []
    for number, file in enumerate(files):
        df = spark.read.csv(file.resolve().as_uri(), header=True, multiLine=True, escape='"')
        if missing := sorted(required - set(df.columns)):
            raise ValueError(f"CSV header mismatch in {file.relative_to(root).as_posix()}: missing {', '.join(missing)}; actual columns: {', '.join(df.columns)}")
        parts.append(df.select(*(F.col(f"`{c}`") for c in sorted(required)), F.lit(number).alias("file"), F.monotonically_increasing_id().alias("row")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    asin = fields.null_marker(F.col("ASIN"))
    return out.withColumn("asin_", asin).drop("ASIN").withColumnRenamed("asin_", "asin").where("asin is not null")


def _value(name: str) -> Column:
    return fields.null_marker(F.col(f"`{name}`"))


def _ranked(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct values per book in order of first occurrence, numbered from 1."""
    known = rows.withColumn(out, _value(column)).where(F.col(out).isNotNull()).withColumn("at", F.struct("file", "row"))
    return first_occurrence(known, ["asin"], out, "at", "author_order")


def normalise(sets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables of the archive. Books that the customer has deleted are dropped from all sets."""
    relations = sets["relationships"]
    gone = F.coalesce(trimmed(F.col("`Deleted By Customer`")) == "Yes", F.lit(False))
    deleted = relations.where(gone).select("asin")
    live = {name: delete_keys(df, deleted, "asin") for name, df in sets.items()}
    title, series_asin = fields.suffix_split(_value("Series Title"), SUFFIX)
    author, author_id = fields.suffix_split(_value("Series Author"), SUFFIX)
    series = live["relationships"].select(
        "asin", F.coalesce(series_asin, F.lit("")).alias("series_asin"), title.alias("series_title"), author.alias("series_author"), author_id.alias("series_author_id"),
        fields.safe_int(_value("Position In Collection")).alias("position_in_collection"), _value("Relation Type").alias("relation_type"), "file", "row",
    ).where("series_title is not null and relation_type is not null")
    return {
        "book_genres": live["genres"].select("asin", _value("Genre").alias("genre")).where("genre is not null").distinct(),
        "book_series": first_wins(series, ["asin", "series_asin", "relation_type"], ["file", "row"]).drop("file", "row"),
        "book_author_ids": _ranked(live["author_ids"], "Author ID", "author_id"),
        "book_author_names": _ranked(live["author_names"], "Author Name", "author_name"),
    }


def import_archive(spark: SparkSession, store: Store, path: str | Path, now: datetime) -> dict[str, int]:
    """Replace the archive's tables. Row counts, and the number of books in any of them."""
    staging = store.root / f"staging-{uuid.uuid4().hex}"
    staging.mkdir(parents=True)
    try:
        root = unpack(path, staging)
        tables = {name: df.cache() for name, df in normalise({name: read_set(spark, root, name) for name in SETS}).items()}
        counts = {name: df.count() for name, df in tables.items()}
        books = union_distinct([df.select("asin") for df in tables.values()]).count()
        told = {"genres_count": counts["book_genres"], "series_count": counts["book_series"], "author_ids_count": counts["book_author_ids"], "author_names_count": counts["book_author_names"], "distinct_asin_count": books}
        store.commit(tables, {"import_metadata_official": {"source_path": str(Path(path).resolve()), "source_type": "zip", **told, "imported_at": now}})
        for df in tables.values():
            df.unpersist()
        return told
    finally:
        shutil.rmtree(staging, ignore_errors=True)

"""Read commands over a store: guarded SQL, search, authors, recent books, status."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tomewise.operators.paging import matches, top
from tomewise.plans import guard, views
from tomewise.plans.schema import SINGLES, TABLES
from tomewise.sources.labels import no_labels
from tomewise.sources.store import Store

#: Names of list functions that users know, as SQL functions that the analyzer inlines.
COMPATIBLE = {
    "list_contains": "(a array<string>, x string) RETURNS boolean RETURN array_contains(a, x)",
    "list_has_any": "(a array<string>, b array<string>) RETURNS boolean RETURN arrays_overlap(a, b)",
    "array_to_string": "(a array<string>, s string) RETURNS string RETURN array_join(a, s)",
}


class Library:
    """A session's view of a store."""

    def __init__(self, spark: SparkSession, store: Store, labels: DataFrame | None = None):
        if not store.exists:
            raise FileNotFoundError(f"No store at {store.root}; import a library first")
        store.upgrade(spark)
        self.spark, self.store = spark, store
        self.read = views.reader(spark, store, labels if labels is not None else no_labels(spark))
        self.labels = labels if labels is not None else no_labels(spark)

    def register(self) -> None:
        views.register(self.spark, self.store, self.labels)
        for name, body in COMPATIBLE.items():
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")

    def query(self, sql: str, allow_unlimited: bool = False) -> DataFrame:
        """Run one reading statement; dialect is Spark SQL, with arrays written as ``array('a', 'b')``."""
        names = [*TABLES, *SINGLES, "v_ndc_labels", *views.VIEWS]
        guard.check(self.spark, sql, allow_unlimited, names)
        self.register()
        sql = re.sub(r"(\s*;)+\s*$", "", sql)
        return self._pragma(sql) if re.match(r"\s*PRAGMA\b", sql, re.IGNORECASE) else self.spark.sql(sql)

    def _pragma(self, sql: str) -> DataFrame:
        text = re.sub(r"(?i)^\s*PRAGMA\s+", "", sql).strip()
        if text.lower() == "database_list":
            return self.spark.createDataFrame([(0, "library", str(self.store.root))], "seq int, name string, file string")
        if m := re.fullmatch(r"(?i)table_info\s*\(\s*'?(\w+)'?\s*\)", text):
            rows = [(i, f.name, f.dataType.simpleString(), not f.nullable) for i, f in enumerate(self.read(m[1]).schema.fields)]
            return self.spark.createDataFrame(rows, "cid int, name string, type string, notnull boolean")
        raise guard.GuardError(f"Unknown PRAGMA: {text}")

    def search(self, term: str, limit: int = 50) -> tuple[DataFrame, int]:
        """Books with the term in title, authors, asin, status or a subject: (page by title and asin, number in all)."""
        found = self.read("v_books").where(F.coalesce(matches(["title", "authors_text", "asin", "read_status"], term), F.lit(False)) | F.exists("subjects", lambda s: F.contains(F.lower(s), F.lower(F.lit(term)))))
        page = top(found.select("asin", "title", "authors", "read_status", "acquired_at"), [F.col("title").asc_nulls_last(), F.col("asin")], limit)
        return page, found.count()

    def authors(self, limit: int = 50) -> tuple[DataFrame, int]:
        counts = self.read("v_author_counts")
        return top(counts, [F.col("book_count").desc(), F.col("author_name").asc_nulls_last()], limit), counts.count()

    def recent(self, limit: int = 20) -> DataFrame:
        books = self.read("v_books").select("asin", "title", "authors", "read_status", "acquired_at")
        return top(books, [F.col("acquired_at").desc_nulls_last(), F.col("asin").desc()], limit)

    def status(self) -> list[tuple[str, str]]:
        """Labels and values of the status table; books that are gone don't count."""
        t, rows = self.read, []
        books = t("books")
        one = lambda name: (t(name).collect() or [None])[0]
        grouped = lambda df, c: [(r[c], str(r["n"])) for r in df.groupBy(c).agg(F.count("*").alias("n")).orderBy(c).collect()]
        present = lambda name: t(name).join(books.select("asin"), "asin", "left_semi")
        if meta := one("import_metadata"):
            rows += [("Last import", str(meta["imported_at"])), ("Source", meta["source_path"]), ("Source type", meta["source_type"])]
        total = books.agg(F.count("*").alias("n"), F.count("product_image_url").alias("images")).first()
        rows += [("Books", str(total["n"])), ("Authors", str(t("book_authors").select("author_name").distinct().count()))]
        rows += [(f"Read status: {k}", n) for k, n in grouped(books, "read_status")] + [("With image URL", str(total["images"]))]
        if meta := one("import_metadata_official"):
            names = {"genres_count": "Genres (rows)", "series_count": "Series (rows)", "author_ids_count": "Author IDs (rows)", "author_names_count": "Author names (rows)", "distinct_asin_count": "Official ASIN (uniq)"}
            rows += [("Official import", str(meta["imported_at"])), ("Official source", meta["source_path"]), *((label, str(meta[c])) for c, label in names.items())]
        rows.append(("Bib not fetched", str(books.join(t("bib_fetches"), "asin", "left_anti").count())))
        rows += [(f"Bib status: {k}", n) for k, n in grouped(present("bib_fetches"), "status")]
        rows += [(f"Bib match: {k}", n) for k, n in grouped(present("bib_matches"), "method")]
        if unmatched := present("bib_fetches").where("status = 'found'").join(t("bib_matches"), "asin", "left_anti").count():
            rows.append(("Bib found, unmatched", f"{unmatched} (rerun: enrich --refresh --where \"bib_status = 'found' AND bib_match IS NULL\")"))
        if pending := one("bib_refetch_pending"):
            scope = f"--{pending['mode'].replace('_', '-')}" + (f" --where {pending['where_clause']!r}" if pending["where_clause"] else "")
            rows.append(("Bib refetch unfinished", f"{scope} since {pending['started_at']}, {t('bib_refetch_done').count()} books done"))
        if overrides := present("bib_overrides").count():
            rows.append(("Bib overrides", str(overrides)))
        if meta := one("bib_metadata"):
            rows += [(label, str(meta[c])) for c, label in (("last_enrich_at", "Last enrich"), ("last_rematch_at", "Last rematch")) if meta[c]]
        return [*rows, ("Database", str(self.store.root))]


def _streamed(df: DataFrame) -> Iterator[Row]:
    """Rows one partition after another; an error of a row is told as ``ValueError``."""
    try:
        yield from df.toLocalIterator()
    except Py4JJavaError as e:
        told = re.search(r"\[[A-Z_.]+\] [^\n]*", str(e))
        raise ValueError(told[0] if told else str(e).splitlines()[0]) from e


def json_lines(df: DataFrame) -> Iterator[str]:
    """The result as lines of a JSON array, so that an unlimited one is never held as a whole."""
    held = None
    for row in _streamed(df):
        yield "[" if held is None else f"{held},"
        held = "\n".join(f"  {line}" for line in json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2, default=str).split("\n"))
    yield from ("[]",) if held is None else (held, "]")


def as_json(df: DataFrame) -> str:
    return "\n".join(json_lines(df))


def shown(value: Any) -> str:
    """A value in a table: lists joined, null empty."""
    return "" if value is None else ", ".join(map(shown, value)) if isinstance(value, list) else str(value)


#: Cells that a column of a table has at most; longer values go on in the next line.
MOST_CELLS = 60


def cells_of(char: str) -> int:
    """Terminal cells of a character: two for wide ones, none for combining ones."""
    return 0 if unicodedata.combining(char) else 2 if unicodedata.east_asian_width(char) in "WF" else 1


def folded(text: str, most: int = MOST_CELLS) -> list[tuple[str, int]]:
    """A text as lines of at most ``most`` cells, with the cells of each."""
    lines, line, held = [], "", 0
    for char in text.replace("\n", " "):
        wide = cells_of(char)
        if held + wide > most:
            lines.append((line, held))
            line, held = "", 0
        line, held = line + char, held + wide
    return [*lines, (line, held)]


def as_table(columns: list[str], rows: list[tuple]) -> str:
    cells = [[folded(shown(v)) for v in row] for row in [columns, *rows]]
    widths = [max(held for row in cells for _, held in row[i]) for i in range(len(columns))]
    out = []
    for row in cells:
        for k in range(max(map(len, row), default=1)):
            parts = [c[k] if k < len(c) else ("", 0) for c in row]
            out.append("  ".join(text + " " * (w - held) for (text, held), w in zip(parts, widths, strict=True)).rstrip())
    return "\n".join(out)

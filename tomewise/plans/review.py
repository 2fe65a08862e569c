"""Review of matches: labels, lists, details, and corrections."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewise.functions import fields
from tomewise.operators.lists import overlaps
from tomewise.operators.merging import map_diff
from tomewise.operators.paging import matches
from tomewise.sources.overrides import overrides_frame
from tomewise.sources.records import record_of

#: Labels that each view shows, genres that count as comics, rows in a list, and the form of an id. Fixed values.
VIEWS = {"review": ("not_found", "incomplete", "work", "unmatched"), "corrected": ("isbn", "not_in_ndl"), "excluded": ("excluded",), "all": None}
COMICS = ["コミック・ラノベ・BL", "少年マンガ", "青年マンガ", "女性マンガ", "少女マンガ", "インディーズマンガ"]
MOST, ASIN = 500, r"[A-Z0-9]{10}"
LINK = "https://ndlsearch.ndl.go.jp/books/"


def label_of(status: Column, match: Column, source: Column) -> Column:
    """What a book's state is called."""
    return F.when(status.isNull(), "unfetched").when(status == "found", F.coalesce(match, F.lit("unmatched"))).when((status == "not_found") & (source == "isbn"), "not_in_ndl").otherwise(status)


def list_books(read: Callable[[str], DataFrame], overrides: dict[str, str | None], view: str = "review", query: str = "", staged: tuple[str, ...] = (), exclude_comics: bool = False) -> dict[str, Any]:
    """Books of a view by title: the first 500 and the number of all. Pending and staged corrections belong to the review."""
    if view not in VIEWS:
        raise ValueError(f"Unknown view: {view}")
    if bad := [a for a in staged if not re.fullmatch(ASIN, a)]:
        raise ValueError(f"Invalid ASIN: {bad[0]!r}")
    books = read("v_books")
    spark = books.sparkSession
    if term := query.strip():
        books = books.where(matches(["title", "authors_text"], term) | (F.col("asin") == term))
    if exclude_comics:
        books = books.where(~(overlaps("genres", COMICS) | F.coalesce(F.col("ndc").startswith("726"), F.lit(False))))
    pending = map_diff(read("bib_overrides"), overrides_frame(spark, overrides), "asin", "isbn").select("asin", F.lit(True).alias("pending"))
    rows = books.join(read("bib_fetches").select("asin", "source"), "asin", "left").join(pending, "asin", "left")
    rows = rows.select("asin", "title", F.col("authors_text").alias("authors"), label_of(F.col("bib_status"), F.col("bib_match"), F.col("source")).alias("label"), "isbn", F.coalesce("pending", F.lit(False)).alias("pending"))
    if VIEWS[view] is not None:
        wanted = F.col("label").isin(*VIEWS[view])
        rows = rows.where(wanted | F.col("pending") | F.col("asin").isin(list(staged)) if view == "review" else wanted)
    page = rows.orderBy(F.col("title").asc_nulls_last(), "asin").limit(MOST)
    return {"total": rows.count(), "books": [r.asDict() for r in page.collect()]}


def book_detail(read: Callable[[str], DataFrame], asin: str, overrides: dict[str, str | None]) -> dict[str, Any]:
    """A book with its candidates in rank order; which ISBNs are valid, which candidates its match has."""
    own = F.col("asin") == asin
    book = read("v_books").where(own).first()
    if book is None:
        raise LookupError(f"No book with ASIN {asin}")
    names = {"asin": "asin", "title": "title", "authors": "authors_text", "series_title": "series_title", "image": "product_image_url", "acquired_at": "acquired_at", "status": "bib_status", "match": "bib_match", "isbn": "isbn",
             "paper_issued": "paper_issued", "publisher": "publisher", "pages": "pages", "ndc": "ndc", "ndc_label": "ndc_label"}
    out = {k: book[c] for k, c in names.items()}
    out["acquired_at"] = None if out["acquired_at"] is None else str(out["acquired_at"])
    fetch, match = read("bib_fetches").where(own).first(), read("bib_matches").where(own).first()
    out["source"] = fetch["source"] if fetch else None
    label = label_of(F.lit(out["status"]).cast("string"), F.lit(out["match"]).cast("string"), F.lit(out["source"]).cast("string"))
    spark = read("books").sparkSession
    out["label"] = spark.range(1).select(label.alias("label")).first()["label"]
    out["override"] = {"isbn": overrides[asin], "excluded": overrides[asin] is None} if asin in overrides else None
    applied = {r["asin"]: r["isbn"] for r in read("bib_overrides").where(own).collect()}
    missing = object()
    out["pending"] = overrides.get(asin, missing) != applied.get(asin, missing)
    matched = F.array(*map(F.lit, match["candidate_ids"])) if match and match["candidate_ids"] else F.expr("cast(array() as array<string>)")
    isbns = F.transform(F.filter(F.transform("r.isbns", fields.isbn13), lambda i: i.isNotNull()), lambda i: F.struct(i.alias("isbn"), fields.isbn_ok(i).alias("valid")))
    rows = read("bib_candidates").where(own).select("search_rank", record_of("item_xml").alias("r")).select(
        "search_rank", *(f"r.{c}" for c in ("id", "title", "volume", "edition", "series", "publishers", "issued", "extent")), isbns.alias("isbns"), F.array_contains(matched, F.col("r.id")).alias("matched"), F.concat(F.lit(LINK), "r.id").alias("link")
    )
    candidates = [r.asDict(recursive=True) for r in rows.orderBy("search_rank").collect()]
    return {"book": out, "candidates": [{k: v for k, v in c.items() if k != "search_rank"} for c in candidates]}


def merged_overrides(read: Callable[[str], DataFrame], overrides: dict[str, str | None], changes: list[dict[str, Any]]) -> dict[str, str | None]:
    """Corrections after a list of changes ({asin, action: isbn, exclude or clear, isbn}); all errors in one ``ValueError``."""
    spark = read("books").sparkSession
    out, errors = dict(overrides), []
    known = {r["asin"] for r in read("books").where(F.col("asin").isin([str(c.get("asin")) for c in changes])).select("asin").collect()}
    given = [(n, str(c.get("isbn") or "")) for n, c in enumerate(changes)]
    checked = {r["n"]: r for r in spark.createDataFrame(given, "n int, isbn string").select("n", fields.isbn_ok(F.col("isbn")).alias("ok"), fields.isbn13(F.col("isbn")).alias("isbn13")).collect()} if given else {}
    for n, c in enumerate(changes):
        asin, action = c.get("asin"), c.get("action")
        if not isinstance(asin, str) or not re.fullmatch(ASIN, asin):
            errors.append(f"Invalid ASIN: {asin!r}")
        elif action == "clear":
            out.pop(asin, None)
        elif asin not in known:
            errors.append(f"No book with ASIN {asin}")
        elif action == "exclude":
            out[asin] = None
        elif action == "isbn" and checked[n]["ok"]:
            out[asin] = checked[n]["isbn13"]
        else:
            errors.append(f"Invalid ISBN for {asin}: {c.get('isbn')}" if action == "isbn" else f"Unknown action for {asin}: {action!r}")
    if errors:
        raise ValueError("; ".join(errors))
    return out

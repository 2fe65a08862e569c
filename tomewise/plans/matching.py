"""Matching of books to paper editions: records are read by Spark's XML expression, the title grammar runs on Arrow batches, everything that compares the candidates
of a book is an expression over its ordered array of candidates. A book has at most as many as one response holds (500), so these
arrays are bounded; books are spread by key, and no step needs more than one shuffle of candidates.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewise.functions import fields, titles
from tomewise.functions.lazy import column_function
from tomewise.sources.records import record_of

_JUDGED = "first boolean, second boolean, labels_fit array<boolean>, editions_fit array<boolean>, has_edition boolean, special boolean"
_CARRIED = ("isbns", "subjects", "ndcs", "descriptions", "issued", "extent", "publishers", "series")
_EMPTY = "cast(array() as array<string>)"
MATCH_COLUMNS = ("method", "candidate_ids", "isbn", "paper_issued", "publisher", "pages", "bib_series", "ndc", "ndc_edition", "subjects", "notes")


@column_function(_JUDGED)
def judged(title: pd.Series, series: pd.Series, candidate: pd.Series, volume: pd.Series, candidate_series: pd.Series, edition: pd.Series) -> pd.DataFrame:
    """What one candidate is to one book: same work by either reading, and how it meets each label and edition of the title."""
    rows = []
    for t, s, *record in zip(title, series, candidate, volume, candidate_series, edition, strict=True):
        book, c = titles.read_title(t or "", s), titles.read_candidate(record[0], record[1], tuple(record[2]), record[3])
        first, second = titles.answers(t or "", s, c)
        labels_fit, editions_fit = [titles.label_fits(label, c.series_names) for label in book.labels], [titles.same_edition(e, c.editions) for e in book.editions]
        rows.append((first, second, labels_fit, editions_fit, bool(c.editions), c.special))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _JUDGED.split(", ")], dtype=object)


def _read(rows: DataFrame) -> DataFrame:
    """Rows with a book's title, series_title and a candidate's item_xml, those of paper editions only, with the record and what it is to the book."""
    is_paper = lambda r: r["id"].startswith(titles.PAPER_PREFIX) & F.arrays_overlap(F.array(F.lit(titles.PAPER_CATEGORIES[0])), r["categories"]) & F.arrays_overlap(F.array(F.lit(titles.PAPER_CATEGORIES[1])), r["categories"])
    # The condition binds the record to a name: it is read once for it and once for what follows, and the title grammar runs on paper editions alone.
    read = rows.withColumn("r", record_of("item_xml")).where(F.get(F.transform(F.array("r"), is_paper), F.lit(0)))
    return read.withColumn("j", judged("title", "series_title", "r.title", "r.volume", "r.series", "r.edition"))


def _one_per_isbn(records: Column, kind: str) -> Column:
    """In order, drop records that share an ISBN with an earlier kept or dropped-for-none one; those without ISBN stay."""
    start = F.struct(F.expr(_EMPTY).alias("seen"), F.expr(f"cast(array() as array<{kind}>)").alias("kept"))
    step = lambda acc, r: F.when(F.arrays_overlap(acc["seen"], r["isbn13s"]), acc).otherwise(F.struct(F.concat(acc["seen"], r["isbn13s"]).alias("seen"), F.concat(acc["kept"], F.array(r)).alias("kept")))
    return F.aggregate(records, start, step, lambda acc: acc["kept"])


def _narrowed(records: Column, flags: str, index: Column) -> Column:
    """The records whose flag is set, or all if none is."""
    hit = F.filter(records, lambda r: F.coalesce(F.get(r[flags], index), F.lit(False)))
    return F.when(F.size(hit) > 0, hit).otherwise(records)


def _same_in_all(values: Column) -> Column:
    """The first of an array's values if all are equal and none is null."""
    return F.when((F.size(values) > 0) & F.forall(values, lambda v: v.isNotNull() & (v == F.get(values, F.lit(0)))), F.get(values, F.lit(0)))


def _common(lists: Column) -> Column:
    return F.coalesce(F.filter(F.get(lists, F.lit(0)), lambda v: F.forall(lists, lambda other: F.array_contains(other, v))), F.expr(_EMPTY))


def match(books: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per book (asin, title, series_title, source) with its match, all null where there is none.

    ``candidates``: (asin, candidate_id, search_rank, item_xml). Books whose source is ``isbn`` take any paper candidate."""
    rows = candidates.select("asin", "search_rank", "item_xml").join(books.select("asin", "title", "series_title", "source"), "asin")
    rows = _read(rows).withColumn("isbn13s", F.filter(F.transform("r.isbns", fields.isbn13), lambda x: x.isNotNull()))
    # The rank comes first and is unique in a book, so arrays sort by it alone.
    packed = rows.groupBy("asin").agg(F.array_sort(F.collect_list(F.struct("search_rank", "isbn13s", "r.id", *(f"r.{x}" for x in _CARRIED), "j.*"))).alias("all"), F.max("j.first").alias("any_first"), F.first("source").alias("source"))
    kind = packed.schema["all"].dataType.elementType.simpleString()
    by_isbn = F.coalesce(F.col("source") == "isbn", F.lit(False))
    adopted = F.when(by_isbn, F.col("all")).when(F.col("any_first"), F.filter("all", lambda r: r["first"])).otherwise(F.filter("all", lambda r: r["second"]))
    kept = packed.select("asin", by_isbn.alias("by_isbn"), _one_per_isbn(adopted, kind).alias("adopted")).where(F.size("adopted") > 0)

    count = lambda name: F.size(F.get("adopted", F.lit(0))[name])
    indexes = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    by_label = F.aggregate(indexes(count("labels_fit")), F.col("adopted"), lambda acc, i: _narrowed(acc, "labels_fit", i))
    labelled = kept.select("*", F.when(F.col("by_isbn"), F.col("adopted")).otherwise(by_label).alias("labelled"), count("editions_fit").alias("editions"))
    by_edition = F.aggregate(
        indexes(F.col("editions")), F.struct(F.col("labelled").alias("left"), F.lit(True).alias("known")),
        lambda acc, i: F.struct(_narrowed(acc["left"], "editions_fit", i).alias("left"), (acc["known"] & F.exists(acc["left"], lambda r: F.coalesce(F.get(r["editions_fit"], i), F.lit(False)))).alias("known")),
    )
    told = labelled.withColumn("e", F.when(F.col("by_isbn"), F.struct(F.col("labelled").alias("left"), F.lit(True).alias("known"))).otherwise(by_edition))
    # A title without an edition isn't settled by labels alone if these leave only later editions, nor by special editions.
    later_only = (F.size("labelled") < F.size("adopted")) & F.forall("labelled", lambda r: r["has_edition"])
    special_only = F.forall("e.left", lambda r: r["special"])
    known = F.col("by_isbn") | (F.col("e.known") & ~((F.col("editions") == 0) & (later_only | special_only)))
    final = told.select("asin", "by_isbn", F.col("e.left").alias("left"), known.alias("known"))

    one = F.get("left", F.lit(0))
    single = (F.size("left") == 1) & F.col("known")
    classes = F.transform("left", lambda r: fields.preferred_class(r["ndcs"]))
    edition = lambda c: F.when(single, c)
    ndc = _same_in_all(F.transform(classes, lambda c: c["code"]))
    found = final.select(
        "asin", F.when(F.col("by_isbn"), "isbn").when(single, "edition").otherwise("work").alias("method"), F.transform("left", lambda r: r["id"]).alias("candidate_ids"),
        edition(F.get(one["isbn13s"], F.lit(0))).alias("isbn"), edition(fields.issued(one["issued"])).alias("paper_issued"), edition(F.nullif(F.array_join(one["publishers"], ", "), F.lit(""))).alias("publisher"),
        edition(fields.pages(one["extent"])).alias("pages"), edition(F.get(one["series"], F.lit(0))).alias("bib_series"), ndc.alias("ndc"),
        F.when(ndc.isNotNull(), F.nullif(_same_in_all(F.transform(classes, lambda c: c["edition"])), F.lit(""))).alias("ndc_edition"),
        _common(F.transform("left", lambda r: r["subjects"])).alias("subjects"), _common(F.transform("left", lambda r: fields.notes(r["descriptions"]))).alias("notes"),
    )
    return books.select("asin").join(found, "asin", "left")


def adoptable(books: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, adoptable) per group of candidates (keys, title, series_title, item_xml): whether either reading adopts any."""
    rows = _read(candidates.join(books.select("asin", "title", "series_title"), "asin")).groupBy(*keys).agg(F.max(F.col("j.first") | F.col("j.second")).alias("yes"))
    return candidates.select(*keys).distinct().join(rows, keys, "left").select(*keys, F.coalesce("yes", F.lit(False)).alias("adoptable"))


def children(matches: DataFrame, column: str, value: str, order: str) -> DataFrame:
    """Child rows (asin, value, order from 1) of a list column."""
    return matches.select("asin", F.posexplode(column).alias("at", value)).select("asin", value, (F.col("at") + 1).alias(order))

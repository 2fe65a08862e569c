"""Bibliographic fields as SQL expressions: ISBN, date of issue, pages, notes, class numbers, imported text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomewise.operators.lists import trimmed


def _digits(c: Column) -> Column:
    """Full-width letters and digits narrowed, everything else but digits and X dropped."""
    narrow = F.translate(c, "０１２３４５６７８９Ｘｘ", "0123456789Xx")
    return F.upper(F.regexp_replace(narrow, "[^0-9Xx]", ""))


def _weighted(digits: Column, n: int, weight: Column | None = None) -> Column:
    """Sum of the first ``n`` digits by alternating weights 1 and 3, or n + 1, n, ... down to 2."""
    by = (lambda i: F.when(i % 2 == 1, 1).otherwise(3)) if weight is None else (lambda i: weight - i)
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda total, i: total + F.substring(digits, i, F.lit(1)).try_cast("int") * by(i))


def isbn13(c: Column) -> Column:
    """13 digits as they are, 10 digits with prefix 978 and a new check digit, else null."""
    d = _digits(c)
    core = F.concat(F.lit("978"), F.substring(d, 1, 9))
    check = (10 - _weighted(core, 12) % 10) % 10
    return F.when(F.regexp_like(d, F.lit("^[0-9]{13}$")), d).when(F.regexp_like(d, F.lit("^[0-9]{9}[0-9X]$")), F.concat(core, check.cast("string")))


def isbn_ok(c: Column) -> Column:
    """Whether an ISBN's check digit is right; false for anything else, null included."""
    d = _digits(c)
    last = F.substring(d, -1, 1)
    long = ((10 - _weighted(d, 12) % 10) % 10).cast("string") == last
    short = F.when(((11 - _weighted(d, 9, F.lit(11)) % 11) % 11) == 10, "X").otherwise(((11 - _weighted(d, 9, F.lit(11)) % 11) % 11).cast("string")) == last
    return F.coalesce(F.when(F.regexp_like(d, F.lit("^[0-9]{13}$")), long).when(F.regexp_like(d, F.lit("^[0-9]{9}[0-9X]$")), short), F.lit(False))


def issued(c: Column) -> Column:
    """``[2020.3]`` and the like as YYYY, YYYY-MM or YYYY-MM-DD, as precise as given; null if it can't be read."""
    text = trimmed(F.translate(c, "０１２３４５６７８９．［］", "0123456789.[]"))
    part = lambda k: F.nullif(F.regexp_extract(text, r"^\[?([0-9]{4})(?:\.([0-9]{1,2})(?:\.([0-9]{1,2}))?)?\.?\]?\.?$", k), F.lit(""))
    year, month, day = part(1), part(2), part(3)
    good = lambda x, most: x.cast("int").between(1, most)
    return (
        F.when(year.isNull(), F.lit(None).cast("string")).when(month.isNull(), year).when(~good(month, 12), None)
        .when(day.isNull(), F.concat_ws("-", year, F.lpad(month, 2, "0"))).when(~good(day, 31), None)
        .otherwise(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))
    )


def pages(c: Column) -> Column:
    """The largest number before plates, size or supplements, if the extent has a unit of pages; else null."""
    text = F.element_at(F.split(F.translate(c, "０１２３４５６７８９ｐ；＋", "0123456789p;+"), "図版|;|\\+"), 1)
    numbers = F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)")), lambda x: x.cast("int"))
    return F.when(F.regexp_like(text, F.lit(r"[0-9]\s*(?:p\b|p$|pages?\b|ページ)")) & ~F.contains(c, F.lit("ページ付なし")), F.array_max(numbers))


def notes(c: Column) -> Column:
    """Distinct notes in order, without years alone and the two words that aren't notes."""
    clean = F.transform(F.coalesce(c, F.expr("cast(array() as array<string>)")), trimmed)
    return F.array_distinct(F.filter(clean, lambda x: (x != "") & ~F.regexp_like(x, F.lit("^[0-9]{4}$")) & ~x.isin("出版", "頒布")))


def preferred_class(c: Column) -> Column:
    """Of an array of (edition, code) the first of the newest edition: 10, 9, 8, none, others."""
    rank = lambda e: F.when(e == "10", 0).when(e == "9", 1).when(e == "8", 2).when(e == "", 3).otherwise(4)
    best = F.array_min(F.transform(c, lambda x, i: F.struct(rank(x["edition"]).alias("rank"), i.alias("i"), x["edition"].alias("edition"), x["code"].alias("code"))))
    return F.when(F.size(c) > 0, F.struct(best["edition"].alias("edition"), best["code"].alias("code")))


def null_marker(c: Column) -> Column:
    """Trimmed; empty or ``Not Available`` becomes null."""
    t = trimmed(c)
    return F.when(t.isin("", "Not Available"), None).otherwise(t)


def blank_to_null(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def safe_int(c: Column) -> Column:
    """An integer as text (spaces around it, a sign, full-width digits and single underscores between digits are fine); else null."""
    text = trimmed(F.translate(c, "０１２３４５６７８９", "0123456789"))
    return F.when(F.regexp_like(text, F.lit("^[+-]?[0-9]+(_[0-9]+)*$")), F.regexp_replace(text, "_", "").try_cast("int"))


def suffix_split(c: Column, pattern: str) -> tuple[Column, Column]:
    """(name, id) by a pattern of two groups; (whole text, null) where it doesn't match."""
    hit = F.regexp_like(c, F.lit(pattern))
    return F.when(hit, F.regexp_extract(c, pattern, 1)).otherwise(c), F.when(hit, F.regexp_extract(c, pattern, 2))


def utc_of_millis(c: Column) -> Column:
    """Milliseconds since the epoch as a UTC timestamp without time zone, whatever the session's time zone is."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(c / 1000).cast("decimal(18,6)"))

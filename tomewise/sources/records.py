"""Bibliographic records out of search responses (RSS), as plain parsing and as an expression."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomewise.operators.lists import trimmed

#: Namespaces of responses, and patterns of what is taken from their text. Fixed values.
NAMESPACES = {
    "dc": "http://purl.org/dc/elements/1.1/",
    "openSearch": "http://a9.com/-/spec/opensearchrss/1.0/",
    "dcndl": "http://ndl.go.jp/dcndl/terms/",
    "dcmitype": "http://purl.org/dc/dcmitype/",
    "dcterms": "http://purl.org/dc/terms/",
    "xsi": "http://www.w3.org/2001/XMLSchema-instance",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
}
ITEM, SEE_ALSO, CLASS_TYPE = r"(?s)<item>.*?</item>", r"[ \t]*<rdfs:seeAlso\b[^>]*/>[ \t]*\r?\n?", r"^dcndl:NDC(\d*)$"
RECORD = (
    "id string, categories array<string>, title string, volume string, series array<string>, edition string, publishers array<string>, issued string, extent string, "
    "isbns array<string>, subjects array<string>, ndcs array<struct<edition:string,code:string>>, descriptions array<string>"
)
_TYPE = f"{{{NAMESPACES['xsi']}}}type"
_OPEN = "<rss " + " ".join(f'xmlns:{p}="{u}"' for p, u in NAMESPACES.items()) + ">"
#: For each field of ``RECORD`` but id, title and ndcs: the element that it is read from, the type that element must say (``None``: none, ``...``: any), and whether all are kept.
_FIELDS: dict[str, tuple[str, object, bool]] = {
    "categories": ("category", ..., True), "volume": ("dcndl:volume", ..., False), "series": ("dcndl:seriesTitle", ..., True), "edition": ("dcndl:edition", ..., False),
    "publishers": ("dc:publisher", ..., True), "issued": ("dcterms:issued", ..., False), "extent": ("dc:extent", ..., False), "isbns": ("dc:identifier", "dcndl:ISBN", True),
    "subjects": ("dc:subject", None, True), "descriptions": ("dc:description", ..., True),
}


class RecordError(ValueError):
    """A response or record that can't be read."""


def _qualified(tag: str) -> str:
    prefix, colon, name = tag.partition(":")
    return f"{{{NAMESPACES[prefix]}}}{name}" if colon else tag


def parse_record(xml: str) -> dict:
    """One ``<item>`` as a dict of the fields of ``RECORD``."""
    try:
        item = ElementTree.fromstring(f"{_OPEN}{xml}</rss>").find("item")
    except ElementTree.ParseError as e:
        raise RecordError(f"unreadable record: {e}") from e
    said: dict[str, list[tuple[str | None, str]]] = {}
    for e in item if item is not None else ():
        if text := (e.text or "").strip():
            said.setdefault(e.tag, []).append((e.get(_TYPE), text))

    def texts(tag: str, kind: object = ...) -> list[str]:
        return [text for k, text in said.get(_qualified(tag), ()) if kind is ... or k == kind]

    number = next(iter(texts("link")), "").rstrip("/").rpartition("/")[2]
    if not number:
        raise RecordError("the record has no <item> with a <link>")
    out: dict = {"id": number, "title": next(iter([*texts("dc:title"), *texts("title")]), "")}
    out |= {name: found if many else next(iter(found), None) for name, (tag, kind, many) in _FIELDS.items() for found in [texts(tag, kind)]}
    classes = ((re.match(CLASS_TYPE, kind or ""), text) for kind, text in said.get(_qualified("dc:subject"), ()))
    return out | {"ndcs": [{"edition": m[1], "code": text} for m, text in classes if m]}


def parse_response(text: str) -> tuple[int, list[str]]:
    """(number of results in all, items as they are stored) of a response."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise RecordError(f"unreadable response: {e}") from e
    total = (root.findtext("channel/openSearch:totalResults", namespaces=NAMESPACES) or "").strip()
    if not total.isdigit():
        raise RecordError("the response has no totalResults")
    return int(total), [re.sub(SEE_ALSO, "", m.group()) for m in re.finditer(ITEM, text)]


_TYPED = {tag for tag, kind, _ in _FIELDS.values() if kind is not ...}
#: What Spark's XML reader takes from an item: texts of elements, with their type where it matters.
_RAW = ", ".join(
    f"`{tag}` array<{'struct<_VALUE:string,`_xsi:type`:string>' if tag in _TYPED else 'string'}>" for tag in dict.fromkeys(["link", "dc:title", "title", *(tag for tag, _, _ in _FIELDS.values())])
)


def record_of(xml: str | Column) -> Column:
    """The same of a column of items, as a struct of ``RECORD`` without a Python worker. An unreadable item has a null id and empty lists.

    The element that Spark reads is bound to a name, so it is read once whatever number of fields is taken from it."""
    return F.get(F.transform(F.array(F.from_xml(xml, _RAW)), _fields_of), F.lit(0))


def _fields_of(raw: Column) -> Column:
    typed = "array<struct<_VALUE:string,`_xsi:type`:string>>"

    def texts(tag: str, kind: object = ...) -> Column:
        found = F.coalesce(raw[tag], F.expr("array()").cast(typed if tag in _TYPED else "array<string>"))
        if tag in _TYPED:
            found = F.transform(found if kind is ... else F.filter(found, lambda e: e["_xsi:type"].isNull() if kind is None else e["_xsi:type"] == kind), lambda e: e["_VALUE"])
        return F.filter(F.transform(found, trimmed), lambda x: x.isNotNull() & (x != ""))

    first = lambda tag: F.get(texts(tag), F.lit(0))
    classes = F.filter(F.coalesce(raw["dc:subject"], F.expr("array()").cast(typed)), lambda e: F.regexp_like(e["_xsi:type"], F.lit(CLASS_TYPE)) & (trimmed(e["_VALUE"]) != ""))
    out = {
        "id": F.nullif(F.element_at(F.split(F.rtrim(first("link"), F.lit("/")), "/"), -1), F.lit("")),
        "title": F.coalesce(first("dc:title"), first("title"), F.lit("")),
        "ndcs": F.transform(classes, lambda e: F.struct(F.regexp_extract(e["_xsi:type"], CLASS_TYPE, 1).alias("edition"), trimmed(e["_VALUE"]).alias("code"))),
        **{name: texts(tag, kind) if many else F.get(texts(tag, kind), F.lit(0)) for name, (tag, kind, many) in _FIELDS.items()},
    }
    return F.struct(*(out[name].alias(name) for name in (c.split(" ")[0] for c in re.split(r", (?![^<]*>)", RECORD))))

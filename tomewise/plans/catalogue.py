"""Registered queries of the library's own plans: sources, store, titles, matching, enrichment, review and gateway, run over
inputs that are made of the star-schema tables and held against SQL over those tables.

Those that need a store or a file keep it in a folder of ``spark.checkpoint.dir``, which driver and executors share.
"""

from __future__ import annotations

import csv
import json
import tempfile
import zipfile
from collections.abc import Callable, Iterable
from datetime import datetime
from itertools import chain
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomewise.functions import fields, udfs
from tomewise.plans import enrichment, guard, matching, review
from tomewise.plans.bindings import Tables, long, query
from tomewise.plans.gateway import Library
from tomewise.sources import archive, labels, library_json, overrides
from tomewise.sources.records import record_of
from tomewise.sources.store import Delta, Store

NOW = datetime(2020, 1, 1)


def folder(spark: SparkSession) -> Path:
    """A new folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not shared.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a mounted folder that the driver and all executors share")
    root = Path(shared.removeprefix("file://").removeprefix("file:")) if shared.startswith(("file:", "/")) else Path(tempfile.gettempdir())
    root.mkdir(parents=True, exist_ok=True)
    return Path(tempfile.mkdtemp(prefix="tomewise-", dir=root))


def text(*parts: str | Column) -> Column:
    """Literals and columns as one text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def c(name: str) -> Column:
    return F.col(name)


# Normalisation and titles


@query("SELECT o_orderkey, epoch_ms(o_orderkey * 86399999) AS at FROM orders")
def utc_of_millis(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", fields.utc_of_millis(c("o_orderkey") * 86399999).alias("at"))


@query("SELECT p_partkey, '<b>' || p_name || '</b> & ''' || p_type || '''' AS title FROM part")
def html_entities(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", udfs.unescape_html(text("&lt;b&gt;", c("p_name"), "&lt;/b&gt; &amp; &#39;", c("p_type"), "&#x27;")).alias("title"))


@query("""
SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Not Available' ELSE c_name END AS image, CASE WHEN c_nationkey % 4 > 1 THEN c_name END AS value FROM customer
""")
def null_markers(t: Tables) -> DataFrame:
    kind = c("c_nationkey") % 4
    given = F.when(kind == 0, " 　 ").when(kind == 1, " Not Available ").when(kind == 2, text("　", c("c_name"), "\t")).otherwise(c("c_name"))
    return t("customer").select("c_custkey", fields.blank_to_null(given).alias("image"), fields.null_marker(given).alias("value"))


_ASCII = "abcdefghijklmnopqrstuvwxyz "


@query("SELECT p_partkey, p_name AS plain, replace(p_name, ' ', '') AS key, replace(p_name, ' ', '') || '新装版' AS bare FROM part")
def title_keys(t: Tables) -> DataFrame:
    wide = F.translate("p_name", _ASCII, "".join(chr(ord(x) + 0xFEE0) for x in _ASCII[:-1]) + "　")
    return t("part").select("p_partkey", udfs.nfkc(wide).alias("plain"), udfs.title_key(text("《よみ》", wide, " 新装版 電子版ー!")).alias("key"), udfs.bare_key(text(wide, " 新装版!")).alias("bare"))


@query("SELECT p_partkey, p_size::VARCHAR AS counted, p_size::VARCHAR AS named, p_size::VARCHAR AS kanji, CASE WHEN p_size BETWEEN 11 AND 19 THEN p_size::VARCHAR END AS tens, ['下', '10', NULL] AS words FROM part")
def volume_words(t: Tables) -> DataFrame:
    size = c("p_size").cast("string")
    kanji = lambda x: F.translate(x.cast("string"), "0123456789", "〇一二三四五六七八九")
    tens = F.when(c("p_size").between(11, 19), text("十", kanji(c("p_size") - 10)))
    words = F.array(*(udfs.volume_of(text(w, F.substring("p_type", 1, 0))) for w in ("下 巻", "Ⅹ", "別巻")))
    return t("part").select("p_partkey", udfs.volume_of(text("第", size, "巻")).alias("counted"), udfs.volume_of(text("Vol. ", size)).alias("named"), udfs.volume_of(kanji(size)).alias("kanji"), udfs.volume_of(tens).alias("tens"), words.alias("words"))


@query("""
SELECT p_partkey, replace(p_name, ' ', '') AS key, p_size::VARCHAR AS volume, [p_brand] AS labels, ['新装版'] AS editions, p_name AS search_text, p_size % 2 = 0 AS split_edition FROM part
""")
def title_parts(t: Tables) -> DataFrame:
    title = text(c("p_name"), " ", c("p_size"), "巻【新装版】", F.when(c("p_size") % 2 == 0, "【分冊】").otherwise(""), " (", c("p_brand"), ")")
    read = t("part").select("p_partkey", udfs.read_title(title, F.lit(None).cast("string")).alias("t"))
    return read.select("p_partkey", *(f"t.{x}" for x in ("key", "volume", "labels", "editions", "search_text", "split_edition")))


@query("SELECT p_partkey, lower(replace(p_name || p_type, ' ', '')) AS repeated, replace(p_name, ' ', '') AS in_series, p_size::VARCHAR AS volume FROM part")
def title_tails(t: Tables) -> DataFrame:
    repeated, series = text(c("p_name"), " ", c("p_type"), " ", c("p_name")), text(c("p_name"), " ", c("p_size"), " ", c("p_type"), " Series")
    read = t("part").select("p_partkey", udfs.read_title(repeated, F.lit(None).cast("string")).alias("r"), udfs.read_title(series, text(c("p_type"), "・SERIES")).alias("s"))
    return read.select("p_partkey", c("r.key").alias("repeated"), c("s.key").alias("in_series"), c("s.volume").alias("volume"))


@query("SELECT p_partkey, p_name || ' ' || replace(p_brand, '#', ' ') AS words, p_brand || ' ' || p_type AS creator FROM part")
def search_terms(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", udfs.search_words(text("《よみ》", c("p_name"), ": ", c("p_brand"))).alias("words"), udfs.search_creator(text(c("p_brand"), "・", c("p_type"), "ほか, 他の人")).alias("creator"))


@query("""
WITH b AS (SELECT p_partkey, p_name AS w, p_name || ' ' || p_size AS v, p_brand AS a, p_type AS s, p_type || ' ' || p_size AS sv FROM part)
SELECT p_partkey, stage, step::BIGINT AS step, title, creator FROM (
  SELECT p_partkey, unnest(['title_creator', 'title_creator', 'title', 'title', 'title', 'series_creator', 'series_creator']) AS stage, unnest([0, 1, 0, 1, 2, 0, 1]) AS step,
    unnest([w, v, w, w, v, s, sv]) AS title, unnest([a, a, NULL, a, a, a, a]) AS creator FROM b)
""")
def search_plan(t: Tables) -> DataFrame:
    stages = udfs.search_stages(text(c("p_name"), " ", c("p_size"), "巻"), c("p_brand"), c("p_type"))
    rows = t("part").select("p_partkey", F.explode(stages).alias("s")).select("p_partkey", c("s.name").alias("stage"), F.posexplode(F.concat(F.array("s.params"), "s.refinements")).alias("step", "params"))
    return rows.select("p_partkey", "stage", long("step").alias("step"), c("params")["title"].alias("title"), c("params")["creator"].alias("creator"))


# Records and matching


def element(name: str, value: Column, attribute: str = "") -> Column:
    """An element around a value, nothing for null."""
    return F.coalesce(text(f"<{name}{attribute}>", value, f"</{name}>"), F.lit(""))


def item(number: Column, title: Column, *more: Column, provider: str | Column = "R100000002-I", paper: Column | None = None) -> Column:
    kinds = text("<category>図書</category>", "<category>紙</category>" if paper is None else F.when(paper, "<category>紙</category>").otherwise("<category>録音</category>"))
    return text("<item><link>https://example.com/books/", provider if isinstance(provider, str) else provider, number, "</link>", kinds, element("dc:title", title), *more, "</item>")


def isbn(value: Column) -> Column:
    return element("dc:identifier", value, ' xsi:type="dcndl:ISBN"')


@query("""
SELECT o_orderkey, 'R100000002-I' || o_orderkey AS id, o_orderpriority AS title, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS volume, ['s' || o_custkey, 't'] AS subjects, '10' AS ndc_edition, (o_custkey % 1000)::VARCHAR AS ndc, 1 AS ndcs,
  [o_orderkey::VARCHAR] AS isbns, ['図書', '紙'] AS categories, CAST([] AS VARCHAR[]) AS series FROM orders
""")
def record_fields(t: Tables) -> DataFrame:
    subjects = text(element("dc:subject", text("s", c("o_custkey"))), element("dc:subject", c("o_custkey") % 1000, ' xsi:type="dcndl:NDC10"'), element("dc:subject", F.lit("t")), element("dc:subject", F.lit("x"), ' xsi:type="dcndl:Other"'))
    xml = item(c("o_orderkey"), c("o_orderpriority"), element("dcndl:volume", F.when(c("o_orderstatus") != "F", c("o_orderstatus"))), subjects, isbn(c("o_orderkey")), element("dc:identifier", F.lit("no"), ' xsi:type="dcndl:JPNO"'))
    return t("orders").select("o_orderkey", record_of(xml).alias("r")).select("o_orderkey", *(f"r.{x}" for x in ("id", "title", "volume", "subjects", "isbns", "categories", "series")), c("r.ndcs")[0]["edition"].alias("ndc_edition"), c("r.ndcs")[0]["code"].alias("ndc"), F.size("r.ndcs").alias("ndcs"))


def _matched(t: Tables, title: Column, xml: Column, source: str = "title") -> DataFrame:
    """Customers as books, their orders as candidates by number."""
    books = t("customer").select(c("c_custkey").cast("string").alias("asin"), title.alias("title"), F.lit(None).cast("string").alias("series_title"), F.lit(source).alias("source"))
    orders = t("orders").join(t("customer").select(c("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    candidates = orders.select(c("o_custkey").cast("string").alias("asin"), c("o_orderkey").cast("string").alias("candidate_id"), rank.alias("search_rank"), xml.alias("item_xml"))
    return matching.match(books, candidates)


_CHECKED = "c || ((10 - (list_sum([substr(c, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END FOR i IN range(1, 13)]) % 10)) % 10)::INT::VARCHAR"


@query(f"""
WITH o AS (SELECT *, c_nationkey % 3 = o_orderkey % 3 AND o_orderstatus <> 'F' AS adopted, o_orderpriority[1] = '1' AS fits, '978' || lpad((o_custkey * 10 + o_orderkey % 5)::VARCHAR, 9, '0') AS c FROM orders JOIN customer ON c_custkey = o_custkey),
d AS (SELECT *, {_CHECKED} AS isbn FROM o WHERE adopted QUALIFY row_number() OVER (PARTITION BY o_custkey, c ORDER BY o_orderkey) = 1),
n AS (SELECT *, max(fits) OVER (PARTITION BY o_custkey) AS any_fits FROM d),
g AS (SELECT o_custkey, count(*) AS n, list('R100000002-I' || o_orderkey ORDER BY o_orderkey) AS ids, min(isbn) AS isbn, min(o_orderkey % 900 + 17) AS pages, min(o_orderkey % 7) AS c1, max(o_orderkey % 7) AS c2,
  min(o_orderstatus) AS s1, max(o_orderstatus) AS s2 FROM n WHERE fits OR NOT any_fits GROUP BY o_custkey)
SELECT c_custkey::VARCHAR AS asin, CASE WHEN n = 1 THEN 'edition' WHEN n > 1 THEN 'work' END AS method, ids AS candidate_ids, CASE WHEN n = 1 THEN isbn END AS isbn, CASE WHEN n = 1 THEN pages::INTEGER END AS pages,
  CASE WHEN c1 = c2 THEN c1::VARCHAR END AS ndc, CASE WHEN n IS NULL THEN NULL WHEN s1 = s2 THEN ['all', s1] ELSE ['all'] END AS subjects FROM customer LEFT JOIN g ON o_custkey = c_custkey
""")
def match_works(t: Tables) -> DataFrame:
    """Adoption by title and volume, one record per ISBN, narrowing by label, attributes of works and single editions."""
    name = text("Voyage n", c("o_custkey"), "k")
    title = F.when(c("o_orderstatus") == "F", text("Other n", c("o_custkey"), "k")).otherwise(name)
    more = text(
        element("dcndl:volume", c("o_orderkey") % 3 + 1), isbn(text(F.lpad((c("o_custkey") * 10 + c("o_orderkey") % 5).cast("string"), 9, "0"), "X")), element("dcndl:seriesTitle", F.when(c("o_orderpriority").startswith("1"), "Harbor ; 4")),
        element("dc:extent", text(c("o_orderkey") % 900 + 17, "p ; 19cm")), element("dc:subject", F.lit("all")), element("dc:subject", c("o_orderstatus")), element("dc:subject", c("o_orderkey") % 7, ' xsi:type="dcndl:NDC9"'),
    )
    found = _matched(t, text("Voyage n", c("c_custkey"), "k ", c("c_nationkey") % 3 + 1, "巻 (Harbor Books)"), item(c("o_orderkey"), title, more))
    return found.select("asin", "method", "candidate_ids", "isbn", "pages", "ndc", "subjects")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, c_nationkey % 2 = 0 AS wants, o_orderkey % 3 = 1 AS fits, o_orderstatus = 'P' AS special FROM orders JOIN customer ON c_custkey = o_custkey),
n AS (SELECT *, max(fits) OVER (PARTITION BY o_custkey) AS any_fits FROM o),
g AS (SELECT o_custkey, count(*) AS n, list('R100000002-I' || o_orderkey ORDER BY o_orderkey) AS ids, bool_and(CASE WHEN wants THEN any_fits ELSE NOT special END) AS known_, bool_and(special) AS all_special, any_value(wants) AS wants, any_value(any_fits) AS any_fits
  FROM n WHERE NOT wants OR fits OR NOT any_fits GROUP BY o_custkey)
SELECT c_custkey::VARCHAR AS asin, CASE WHEN n = 1 AND (CASE WHEN wants THEN any_fits ELSE NOT all_special END) THEN 'edition' WHEN n >= 1 THEN 'work' END AS method, ids AS candidate_ids FROM customer LEFT JOIN g ON o_custkey = c_custkey
""")
def match_editions(t: Tables) -> DataFrame:
    """Narrowing by edition; a wanted edition that no record has, and special editions alone, leave the edition unknown."""
    edition = element("dcndl:edition", F.when(c("c_nationkey") % 2 == 0, text("第 ", c("o_orderkey") % 3 + 1, " 版")).when(c("o_orderstatus") == "P", "限定版"))
    title = text("Chart n", c("c_custkey"), "k", F.when(c("c_nationkey") % 2 == 0, " 第2版").otherwise(""))
    return _matched(t, title, item(c("o_orderkey"), text("Chart n", c("o_custkey"), "k"), edition)).select("asin", "method", "candidate_ids")


@query("""
WITH g AS (SELECT o_custkey, count(*) AS n, list('R100000002-I' || o_orderkey ORDER BY o_orderkey) AS ids FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 25 = c_nationkey GROUP BY o_custkey)
SELECT c_custkey::VARCHAR AS asin, CASE WHEN n = 1 THEN 'edition' WHEN n > 1 THEN 'work' END AS method, ids AS candidate_ids FROM customer LEFT JOIN g ON o_custkey = c_custkey
""")
def match_second_reading(t: Tables) -> DataFrame:
    """A number at the end of a title that belongs to it, where no record has it as a volume."""
    return _matched(t, text("Deck n", c("c_custkey"), "k ", c("c_nationkey")), item(c("o_orderkey"), text("Deck n", c("o_custkey"), "k ", c("o_orderkey") % 25))).select("asin", "method", "candidate_ids")


@query("""
WITH g AS (SELECT o_custkey, count(*) AS n, list('R100000002-I' || o_orderkey ORDER BY o_orderkey) AS ids, min(strftime(o_orderdate, '%Y-%m')) AS issued FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority[1] <> '5' GROUP BY o_custkey)
SELECT c_custkey::VARCHAR AS asin, CASE WHEN n > 0 THEN 'isbn' END AS method, ids AS candidate_ids, CASE WHEN n = 1 THEN issued END AS paper_issued FROM customer LEFT JOIN g ON o_custkey = c_custkey
""")
def match_by_isbn(t: Tables) -> DataFrame:
    """Books that were looked up by ISBN take any paper edition of the library's own records."""
    provider = F.when(c("o_orderpriority").startswith("5"), "R100000001-I").otherwise("R100000002-I")
    issued = element("dcterms:issued", text("[", F.year("o_orderdate"), ".", F.month("o_orderdate"), "]"))
    xml = item(c("o_orderkey"), text("Title ", c("o_orderkey")), issued, provider=provider, paper=c("o_orderstatus") != "O")
    return _matched(t, text("Something else ", c("c_custkey")), xml, "isbn").select("asin", "method", "candidate_ids", "paper_issued")


@query("""
WITH o AS (SELECT o_custkey, o_orderpriority AS stage, o_orderkey % 5 = c_nationkey % 5 AS hit FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT o_custkey::VARCHAR AS asin, stage, bool_or(hit) AS adoptable FROM o GROUP BY ALL
""")
def adoptable_stages(t: Tables) -> DataFrame:
    """Which searches of a book have a record to adopt."""
    orders = t("orders").join(t("customer").select(c("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    books = t("customer").select(c("c_custkey").cast("string").alias("asin"), text("Cove n", c("c_custkey"), "k ", c("c_nationkey") % 5 + 1, "巻").alias("title"), F.lit(None).cast("string").alias("series_title"))
    xml = item(c("o_orderkey"), text("Cove n", c("o_custkey"), "k"), element("dcndl:volume", c("o_orderkey") % 5 + 1))
    return matching.adoptable(books, orders.select(c("o_custkey").cast("string").alias("asin"), c("o_orderpriority").alias("stage"), xml.alias("item_xml")), ["asin", "stage"])


# Enrichment and review


@query("""
WITH r AS (SELECT user_id, event_type, event_id, (value * 10)::INT AS total FROM events),
s AS (SELECT user_id, event_type, min(event_id) AS ref_no FROM r WHERE total <= 500 GROUP BY ALL)
SELECT user_id::VARCHAR AS asin, event_type AS stage_no, ref_no FROM s
""")
def resolved_stages(t: Tables) -> DataFrame:
    """Per stage the first search with few enough results."""
    rows = t("events").select(c("user_id").cast("string").alias("asin"), c("event_type").alias("stage_no"), c("event_id").alias("ref_no"), F.rint(c("value") * 10).cast("int").alias("total"))  # halves to the even number, as the SQL's cast
    return enrichment.resolve(rows)


def _documents_library(t: Tables) -> Callable[[str], DataFrame]:
    """Documents as books, labels as the state of their enrichment and as corrections."""
    asin = F.lpad(c("doc_id").cast("string"), 10, "0").alias("asin")
    none = F.lit(None).cast("string")
    state = F.when((c("quality") == 1) & (c("toxic") == 0), "found").when(c("quality") == 1, "error").when(c("toxic") == 1, "incomplete").when(c("quality") == 0, "not_found")
    known = t("labels").select(asin, state.alias("status"), "quality", "toxic")
    books = t("documents").select(asin, c("source").alias("title"), c("lang").alias("authors_text"), "n_chars").join(known, "asin", "left")
    isbn13 = F.when(c("quality") == 1, "9780000000002")
    match = F.when(c("status") == "found", F.when(c("n_chars") > 2000, "edition").when(c("n_chars") > 500, "work"))
    views = {
        "v_books": books.select("asin", "title", "authors_text", none.alias("series_title"), c("status").alias("bib_status"), match.alias("bib_match"), none.alias("isbn"), F.array("title").alias("genres"), F.when(c("n_chars") % 2 == 0, "726.1").alias("ndc")),
        "bib_overrides": known.where("toxic = 1").select("asin", isbn13.alias("isbn")),
        "bib_fetches": known.select("asin", "status", F.when(c("quality") == 0, "isbn").otherwise("title").alias("source")),
    }
    return views.__getitem__


_DOCUMENTS = """
k AS (SELECT lpad(doc_id::VARCHAR, 10, '0') AS asin, quality, toxic, CASE WHEN quality = 1 AND toxic = 0 THEN 'found' WHEN quality = 1 THEN 'error' WHEN toxic = 1 THEN 'incomplete' WHEN quality = 0 THEN 'not_found' END AS status FROM labels),
b AS (SELECT lpad(doc_id::VARCHAR, 10, '0') AS asin, source AS title, lang AS authors_text, n_chars FROM documents)
"""


@query(f"""
WITH {_DOCUMENTS}
SELECT asin, title, status, CASE WHEN toxic = 1 AND quality = 1 THEN '9780000000002' END AS isbn FROM b LEFT JOIN k USING (asin)
WHERE authors_text <> 'en' AND NOT coalesce(toxic = 1 AND quality = 0, false) AND (status IS NULL OR status IN ('error', 'not_found', 'incomplete')) AND asin NOT IN (SELECT lpad(user_id::VARCHAR, 10, '0') FROM events)
""")
def enrichment_targets(t: Tables) -> DataFrame:
    """Books to fetch: never those whose correction forbids it, missing ones again if asked for, done ones of this run no more."""
    done = t("events").select(F.lpad(c("user_id").cast("string"), 10, "0").alias("asin"))
    return enrichment.targets(_documents_library(t), "authors_text <> 'en'", retry_missing=True, done=done).select("asin", "title", "status", "isbn")


_LABEL = "CASE WHEN status IS NULL THEN 'unfetched' WHEN status = 'found' THEN CASE WHEN n_chars > 2000 THEN 'edition' WHEN n_chars > 500 THEN 'work' ELSE 'unmatched' END WHEN status = 'not_found' AND quality = 0 THEN 'not_in_ndl' ELSE status END"


@query(f"WITH {_DOCUMENTS} SELECT asin, {_LABEL} AS label FROM b LEFT JOIN k USING (asin)")
def review_labels(t: Tables) -> DataFrame:
    read = _documents_library(t)
    rows = read("v_books").join(read("bib_fetches").select("asin", "source"), "asin", "left")
    return rows.select("asin", review.label_of(c("bib_status"), c("bib_match"), c("source")).alias("label"))


@query(f"""
WITH {_DOCUMENTS},
l AS (SELECT asin, title, authors_text AS authors, {_LABEL} AS label, coalesce(toxic = 1, false) AS pending FROM b LEFT JOIN k USING (asin) WHERE n_chars % 2 = 1),
v AS (SELECT * FROM l WHERE label IN ('not_found', 'incomplete', 'work', 'unmatched') OR pending)
SELECT *, (SELECT count(*) FROM v) AS total FROM v ORDER BY title, asin LIMIT 500
""")
def review_list(t: Tables) -> DataFrame:
    """The review: its labels, and corrections that aren't applied (here all that are, since the file has none), without comics."""
    found = review.list_books(_documents_library(t), {}, "review", exclude_comics=True)
    rows = [(b["asin"], b["title"], b["authors"], b["label"], b["pending"], found["total"]) for b in found["books"]]
    return t("documents").sparkSession.createDataFrame(rows, "asin string, title string, authors string, label string, pending boolean, total long")


class _Shelf:
    """A search service that has a paper edition of books whose number isn't divisible by 3, too many results for those divisible by 5, and fails for 7."""

    def search(self, params: dict[str, str]) -> tuple[int, list[str]]:
        number = int("".join(filter(str.isdigit, params["title"])))
        if number == 7:
            from tomewise.sources.search_api import SearchError

            raise SearchError("down")
        if number % 5 == 0:
            return 900, []
        xml = f"<item><link>https://example.com/books/R100000002-I{number}</link><category>図書</category><category>紙</category><dc:title>{params['title']}</dc:title></item>"
        return (0, []) if number % 3 == 0 else (1, [xml])


@query("""
SELECT 'N' || lpad(n_nationkey::VARCHAR, 9, '0') AS asin, CASE WHEN n_nationkey = 7 THEN 'error' WHEN n_nationkey % 5 = 0 THEN 'incomplete' WHEN n_nationkey % 3 = 0 THEN 'not_found' ELSE 'found' END AS status,
  CASE WHEN n_nationkey <> 7 AND n_nationkey % 5 > 0 AND n_nationkey % 3 > 0 THEN 'edition' END AS method FROM nation
""")
def enrichment_run(t: Tables) -> DataFrame:
    """A whole run over a small store: targets, searches, states, commits of 20 books, matches."""
    spark = t("nation").sparkSession
    root = folder(spark)
    rows = [{"asin": f"N{r['n_nationkey']:09d}", "title": f"Isle k{r['n_nationkey']}z", "authors": r["n_name"], "acquiredTime": r["n_nationkey"], "readStatus": "READ"} for r in t("nation").collect()]
    (root / "books.json").write_text(json.dumps(rows), encoding="utf-8")
    store = Store(root / "library")
    library_json.import_library(spark, store, root / "books.json", NOW)
    enrichment.enrich(spark, store, _Shelf(), lambda: NOW)
    return store.read(spark, "bib_fetches").join(store.read(spark, "bib_matches").select("asin", "method"), "asin", "left").select("asin", "status", "method")


# Sources and store


def _write_json(path: Path, rows: Iterable[dict]) -> None:
    """A JSON array, row by row."""
    with path.open("w", encoding="utf-8") as f:
        f.write("[")
        for n, row in enumerate(rows):
            f.write(("," if n else "") + json.dumps(row, ensure_ascii=False))
        f.write("]")


def _customers_library(t: Tables) -> tuple[SparkSession, Store]:
    """Customers as an imported catalogue, their orders' priorities as genres of an imported archive."""
    customers = t("customer")
    spark = customers.sparkSession
    root = folder(spark)
    rows = customers.orderBy("c_custkey").toLocalIterator()
    _write_json(root / "books.json", ({"asin": f"C{r['c_custkey']:09d}", "title": f"{r['c_name']} &amp; Co", "authors": f"{r['c_mktsegment']}, N{r['c_nationkey']}, ", "acquiredTime": r["c_custkey"] * 1_000_000, "readStatus": "READ" if r["c_acctbal"] > 0 else "UNKNOWN", "productImage": " "} for r in rows))
    store = Store(root / "library")
    library_json.import_library(spark, store, root / "books.json", NOW)
    return spark, store


_BOOKS = "SELECT 'C' || lpad(c_custkey::VARCHAR, 9, '0') AS asin, c_name || ' & Co' AS title, [c_mktsegment, 'N' || c_nationkey] AS authors, epoch_ms(c_custkey * 1000000) AS acquired_at, CASE WHEN c_acctbal > 0 THEN 'READ' ELSE 'UNKNOWN' END AS read_status FROM customer"


@query(_BOOKS)
def imported_books(t: Tables) -> DataFrame:
    """The main view over an imported catalogue."""
    spark, store = _customers_library(t)
    return Library(spark, store).read("v_books").select("asin", "title", "authors", "acquired_at", "read_status")


@query("""
WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, 'ASIN C' || c_custkey || ': ' AS l FROM customer)
SELECT pos::INTEGER AS pos, CASE c_nationkey % 6 WHEN 0 THEN [l || 'missing or empty required key ''title'''] WHEN 1 THEN [l || '''title'' must be str', l || '''acquiredTime'' must be int epoch milliseconds']
  WHEN 2 THEN [l || '''acquiredTime'' must satisfy 0 <= acquiredTime < 4102444800000'] WHEN 3 THEN ['index ' || pos || ': missing or empty required key ''asin'''] WHEN 4 THEN ['index ' || pos || ': each item must be an object'] ELSE CAST([] AS VARCHAR[]) END AS errors,
  CASE c_nationkey % 6 WHEN 5 THEN ['alpha', 'zeta'] ELSE CAST([] AS VARCHAR[]) END AS unknown FROM c
""")
def export_problems(t: Tables) -> DataFrame:
    """All that is wrong with each item of an export."""
    spark = t("customer").sparkSession
    path = folder(spark) / "books.json"

    def row(r) -> object:
        good = {"asin": f"C{r['c_custkey']}", "title": "t", "authors": "a", "acquiredTime": 5, "readStatus": "READ"}
        flaws = ({"title": " "}, {"title": 3, "acquiredTime": True}, {"acquiredTime": -1}, {"asin": None}, None, {"zeta": 1, "alpha": []})
        flaw = flaws[r["c_nationkey"] % 6]
        return r["c_name"] if flaw is None else good | flaw

    _write_json(path, map(row, t("customer").orderBy("c_custkey").toLocalIterator()))
    return library_json.problems(library_json.read_items(spark, path)).select("pos", "errors", "unknown")


@query("""
WITH gone AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0),
g AS (SELECT DISTINCT user_id AS k, event_type AS a FROM events WHERE event_type <> 'view'),
s AS (SELECT c_custkey AS k, c_mktsegment AS a, 'B' || lpad(c_nationkey::VARCHAR, 9, '0') AS b, c_nationkey AS n FROM customer),
i AS (SELECT conv_id AS k, role AS a, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS n FROM conversations GROUP BY conv_id, role),
u AS (SELECT 'genres' AS of, k, a, NULL AS b, NULL AS n FROM g UNION ALL SELECT 'series', k, a, b, n FROM s UNION ALL SELECT 'ids', k, a, NULL, n FROM i UNION ALL SELECT 'names', k, upper(a), NULL, n FROM i)
SELECT of, k::VARCHAR AS asin, a, b, n::INTEGER AS n FROM u WHERE k NOT IN (SELECT k FROM gone)
""")
def archive_tables(t: Tables) -> DataFrame:
    """The tables of an official archive: markers cleaned, ids split off, deleted books gone, first rows and first occurrences."""
    spark = t("customer").sparkSession
    root = folder(spark)
    customers, turns = t("customer").orderBy("c_custkey"), t("conversations").select("conv_id", "turn", "role").orderBy("conv_id", "turn")
    relations = ([r["c_custkey"], f"{r['c_mktsegment']} B{r['c_nationkey']:09d}", r["c_name"], r["c_nationkey"], "PRIMARY", "Yes" if r["c_acctbal"] < 0 else "No"] for r in customers.toLocalIterator())
    again = ([r["c_custkey"], f"later B{r['c_nationkey']:09d}", "Not Available", "x", "PRIMARY", "No"] for r in customers.toLocalIterator())
    events = t("events").select("user_id", "event_type").toLocalIterator()
    sets = {
        "genres": (["ASIN", "Genre"], ([r["user_id"], " Not Available " if r["event_type"] == "view" else f" {r['event_type']}"] for r in events)),
        "relationships": (["ASIN", "Series Title", "Series Author", "Position In Collection", "Relation Type", "Deleted By Customer"], chain(relations, again)),
        "author_ids": (["ASIN", "Author ID"], ([r["conv_id"], r["role"]] for r in turns.toLocalIterator())),
        "author_names": (["ASIN", "Author Name"], ([r["conv_id"], r["role"].upper()] for r in turns.toLocalIterator())),
    }
    with zipfile.ZipFile(root / "archive.zip", "w") as z:
        for name, (header, rows) in sets.items():
            set_name = archive.SETS[name][0]
            with (root / "set.csv").open("w", encoding="utf-8-sig", newline="") as f:
                csv.writer(f).writerows(chain([header], rows))
            z.write(root / "set.csv", f"{archive.BASE}/{set_name}/{set_name}.csv")
    store = Store(root / "library")
    archive.import_archive(spark, store, root / "archive.zip", NOW)
    none = F.lit(None).cast("string").alias("b")
    parts = [
        store.read(spark, "book_genres").select(F.lit("genres").alias("of"), "asin", c("genre").alias("a"), none, F.lit(None).cast("int").alias("n")),
        store.read(spark, "book_series").select(F.lit("series"), "asin", "series_title", "series_asin", "position_in_collection"),
        store.read(spark, "book_author_ids").select(F.lit("ids"), "asin", "author_id", none, "author_order"), store.read(spark, "book_author_names").select(F.lit("names"), "asin", "author_name", none, "author_order"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("SELECT 'tsv' AS kind, (100 + n_nationkey)::VARCHAR AS ndc3, n_name AS label FROM nation UNION ALL SELECT 'turtle', (100 + n_nationkey)::VARCHAR, n_name || ' class' FROM nation WHERE n_regionkey > 0")
def label_sources(t: Tables) -> DataFrame:
    """Class labels of a TSV, and those that a Turtle file has for three-digit classes that aren't variants."""
    nations = t("nation").orderBy("n_nationkey").collect()  # 25 rows
    spark = t("nation").sparkSession
    root = folder(spark)
    (root / "labels.tsv").write_text("# classes\n\n" + "".join(f"{100 + r['n_nationkey']}\t{r['n_name']}\n" for r in nations), encoding="utf-8")
    block = 'ndc9:{n} a ndcv:{kind} ;\n  skos:notation "{n}" ;\n  skos:prefLabel "{name}"@ja , "x"@en'
    made = [block.format(n=100 + r["n_nationkey"], kind="Section" if r["n_regionkey"] else "Section, ndcv:Variant", name=f"{r['n_name']} class") for r in nations] + [block.format(n="10", kind="Division", name="two digits")]
    (root / "labels.ttl").write_text("@prefix ndc9: <x>\n.\n" + "\n.\n".join(made) + "\n.\n", encoding="utf-8")
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), "ndc3", "label")
    return kind(labels.read_labels(spark, root / "labels.tsv"), "tsv").union(kind(labels.labels_of_turtle(spark, root / "labels.ttl"), "turtle"))


@query(f"SELECT asin, CASE WHEN p_size % 5 > 0 THEN {_CHECKED} END AS isbn FROM (SELECT lpad(p_partkey::VARCHAR, 10, '0') AS asin, p_size, '978' || lpad(p_partkey::VARCHAR, 9, '0') AS c FROM part)")
def corrections_file(t: Tables) -> DataFrame:
    """Corrections written to a file and read back."""
    spark = t("part").sparkSession
    path = folder(spark) / "overrides.csv"
    own = fields.isbn13(text(F.lpad(c("p_partkey").cast("string"), 9, "0"), "X"))
    rows = t("part").select(F.lpad(c("p_partkey").cast("string"), 10, "0").alias("asin"), F.when(c("p_size") % 5 > 0, own).alias("isbn")).toLocalIterator()
    overrides.write_overrides(path, {r["asin"]: r["isbn"] for r in rows})  # a file kept by hand
    return overrides.overrides_frame(spark, overrides.read_overrides(spark, path))


@query("""
SELECT lpad(doc_id::VARCHAR, 10, '0') AS asin, CASE WHEN toxic = 1 THEN 'second' ELSE 'first' END AS isbn FROM labels WHERE quality = 1 OR toxic = 1
UNION ALL SELECT 'new' || s_suppkey, 'third' FROM supplier
""")
def store_deltas(t: Tables) -> DataFrame:
    """A table of a store after a whole commit, a delta that replaces and one that removes rows, and one that adds some; then compacted."""
    spark = t("labels").sparkSession
    store = Store(folder(spark) / "library")
    rows = t("labels").select(F.lpad(c("doc_id").cast("string"), 10, "0").alias("asin"), "quality", "toxic")
    store.commit({"bib_overrides": rows.select("asin", F.lit("first").alias("isbn"))}, {"bib_metadata": {"last_rematch_books": 1}})
    toxic, poor = rows.where("toxic = 1"), rows.where("quality = 0 and toxic = 0")
    store.commit({"bib_overrides": Delta(toxic.select("asin", F.lit("second").alias("isbn")), toxic)})
    store.commit({"bib_overrides": Delta(poor.select("asin", F.lit(None).alias("isbn")).limit(0), poor)})
    added = t("supplier").select(text("new", c("s_suppkey")).alias("asin"), F.lit("third").alias("isbn"))
    store.commit({"bib_overrides": Delta(added, added)})
    store.compact(spark)
    return store.read(spark, "bib_overrides")


# Gateway


#: Statements, and whether they may run.
STATEMENTS = {
    "SELECT asin FROM books LIMIT 10": True, "select title from v_books order by title limit 5 offset 20": True, "SELECT asin FROM books": False, "SELECT asin FROM books LIMIT 3;": True, "SELECT 1 LIMIT 1; SELECT 2 LIMIT 1": False,
    "SELECT count(*) FROM books": True, "SELECT count(*), asin FROM books": False, "SELECT max(title) AS last, min(title) first FROM v_books": True, "SELECT count(*) FROM books GROUP BY title": False, "SELECT sum(length(title)) FROM books": False,
    "WITH a AS (SELECT asin FROM books) SELECT * FROM a LIMIT 2": True, "WITH a AS (SELECT asin FROM books LIMIT 2) SELECT * FROM a": False, "SELECT asin FROM books UNION SELECT asin FROM book_genres LIMIT 4": True, "SHOW TABLES": True, "DESCRIBE books": True,
    "DROP VIEW books": False, "INSERT INTO books SELECT * FROM books LIMIT 1": False, "SELECT asin FROM books -- LIMIT 4": False, "SELECT 'x LIMIT 4'": False, "PRAGMA table_info('books')": True, "SELECT * FROM csv.`/etc/hosts` LIMIT 1": False,
    "SELECT reflect('java.lang.System', 'nanoTime') LIMIT 1": False, "WITH a AS (SELECT 1 AS x) INSERT INTO books SELECT * FROM a LIMIT 1": False, "EXPLAIN SELECT asin FROM books": True, "SELECT asin FROM books LIMIT 1 + 1": False,
}


@query("SELECT * FROM (VALUES " + ", ".join("('{}', {})".format(s.replace("'", "''"), str(ok).lower()) for s, ok in STATEMENTS.items()) + ") t(statement, allowed)")
def guard_decisions(t: Tables) -> DataFrame:
    """Which statements the gateway lets through."""
    spark = t("region").sparkSession

    def allowed(sql: str) -> bool:
        try:
            guard.check(spark, sql, relations=["books", "v_books", "book_genres"])
        except guard.GuardError:
            return False
        return True

    return spark.createDataFrame([(s, allowed(s)) for s in STATEMENTS], "statement string, allowed boolean")


@query(f"""
WITH v AS ({_BOOKS}) SELECT asin, title, year(acquired_at + INTERVAL 9 HOUR)::BIGINT AS year FROM v WHERE list_contains(authors, 'MACHINERY') OR array_to_string(authors, ' ') ILIKE '%furniture n7%' ORDER BY title, asin LIMIT 40 OFFSET 10
""")
def gateway_query(t: Tables) -> DataFrame:
    """A statement of a user, with names of list functions that the gateway adds."""
    spark, store = _customers_library(t)
    sql = "SELECT asin, title, cast(year(acquired_at + INTERVAL 9 HOUR) AS bigint) AS year FROM v_books WHERE list_contains(authors, 'MACHINERY') OR array_to_string(authors, ' ') ILIKE '%furniture n7%' ORDER BY title, asin LIMIT 40 OFFSET 10"
    return Library(spark, store).query(sql)


@query(f"""
WITH v AS ({_BOOKS}), f AS (SELECT * FROM v WHERE title ILIKE '%automobile%' OR array_to_string(authors, ', ') ILIKE '%automobile%' OR asin ILIKE '%automobile%' OR read_status ILIKE '%automobile%'),
a AS (SELECT author_name, count(*) AS n FROM (SELECT DISTINCT asin, unnest(authors) AS author_name FROM v) GROUP BY 1)
SELECT 'search' AS page, title AS name, (SELECT count(*) FROM f) AS n FROM (SELECT * FROM f ORDER BY title, asin LIMIT 30)
UNION ALL SELECT 'authors', author_name, n FROM (SELECT * FROM a ORDER BY n DESC, author_name LIMIT 8) UNION ALL SELECT 'recent', title, NULL FROM (SELECT * FROM v ORDER BY acquired_at DESC, asin DESC LIMIT 5)
""")
def library_pages(t: Tables) -> DataFrame:
    """Search, authors and recent books of a library."""
    library = Library(*_customers_library(t))
    found, total = library.search("AUTOmobile", 30)
    authors, _ = library.authors(8)
    return (
        found.select(F.lit("search").alias("page"), c("title").alias("name"), F.lit(total).cast("long").alias("n"))
        .union(authors.select(F.lit("authors"), "author_name", long("book_count"))).union(library.recent(5).select(F.lit("recent"), "title", F.lit(None).cast("long")))
    )


@query("""
SELECT 'Books' AS item, count(*)::VARCHAR AS value FROM customer UNION ALL SELECT 'Authors', (count(DISTINCT c_mktsegment) + count(DISTINCT c_nationkey))::VARCHAR FROM customer
UNION ALL SELECT 'Read status: ' || CASE WHEN c_acctbal > 0 THEN 'READ' ELSE 'UNKNOWN' END, count(*)::VARCHAR FROM customer GROUP BY 1 UNION ALL SELECT 'With image URL', '0' UNION ALL SELECT 'Bib not fetched', count(*)::VARCHAR FROM customer
""")
def library_status(t: Tables) -> DataFrame:
    spark, store = _customers_library(t)
    rows = [(item, value) for item, value in Library(spark, store).status() if item not in ("Last import", "Source", "Source type", "Database")]
    return spark.createDataFrame(rows, "item string, value string")

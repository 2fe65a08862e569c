"""Import, store, views and the read commands."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from library_data import BOOKS, SETS, write_json, write_zip
from tomewise.plans import gateway, guard, views
from tomewise.plans.gateway import Library
from tomewise.sources import archive, labels, library_json
from tomewise.sources.store import Store, StoreLocked

NOW = datetime(2026, 1, 2, 3, 4, 5)


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("library")
    store = Store(folder / "db")
    assert library_json.import_library(spark, store, write_json(folder / "books.json"), NOW) == 6
    told = archive.import_archive(spark, store, write_zip(folder / "official.zip"), NOW)
    assert told == {"genres_count": 5, "series_count": 4, "author_ids_count": 5, "author_names_count": 3, "distinct_asin_count": 5}
    return Library(spark, store)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_books_are_normalised(library):
    books = {r["asin"][-1]: r for r in library.read("books").collect()}
    assert books["1"]["acquired_at"] == datetime(2021, 2, 3, 9, 47, 58) and books["2"]["title"] == "Salt & Tide '93"
    assert {k for k, r in books.items() if r["product_image_url"] is not None} == {"1", "5"}
    assert rows(library.read("book_authors").where("asin = 'B0TOME0002'")) == [("B0TOME0002", "Ida Moor", 1), ("B0TOME0002", "Tom Quill", 2), ("B0TOME0002", "Wren Ash", 3)]


def test_views(library):
    v = {r["asin"][-1]: r for r in library.read("v_books").collect()}
    assert len(v) == 6 and library.read("v_books").columns == views.BOOK_COLUMNS
    assert (v["1"]["authors"], v["1"]["genres"], v["1"]["author_ids"], v["1"]["author_names_official"]) == (["海野渚", "丘田実"], ["Essays", "Sea"], ["P1", "P2"], ["海野, 渚", "丘田実"])
    assert {k: (r["series_title"], r["series_asin"], r["series_position"]) for k, r in v.items() if r["series_title"]} == {"1": ("Almanac", None, 1), "2": ("Loose Series", None, None)}
    assert v["6"]["authors"] is None and v["3"]["genres"] == v["6"]["subjects"] == []
    assert rows(library.read("v_genre_counts")) == [("Craft", 1), ("Essays", 1), ("Sea", 2)]
    assert rows(library.read("v_series_counts")) == [("B0SERIES01", "Coast Notes", 1), (None, "Almanac", 1), (None, "Loose Series", 1)]
    assert ("海野渚", 2) in rows(library.read("v_author_counts")) and library.read("v_author_counts").count() == 7
    assert rows(library.read("v_author_id_counts")) == [("P1", "Nora Fleece", 3), ("P2", "丘田実", 1), ("P3", "(unknown)", 1)]
    assert len(rows(library.read("v_book_authors_official"))) == 5 and library.read("v_book_series").count() == library.read("v_book_genres").count() == 4


def test_search_and_pages(library):
    for term, found in (("100%_w", "4"), ("c:\\maps", "5"), ("海野", "13"), ("%", "4"), ("tide", "2"), ("nothing", "")):
        page, total = library.search(term)
        assert sorted(r["asin"][-1] for r in page.collect()) == list(found) and total == len(found)
    page, total = library.search("book", limit=1)
    assert [r["title"] for r in page.collect()] == ["Book of Rain"] and total == 2
    assert [r["asin"][-1] for r in library.recent(2).collect()] == ["2", "5"]
    top, total = library.authors(1)
    assert [tuple(r) for r in top.collect()] == [("海野渚", 2)] and total == 7
    status = dict(library.status())
    assert status["Books"] == "6" and status["Read status: UNKNOWN"] == "3" and status["Bib not fetched"] == "6" and status["Genres (rows)"] == "5"


def test_queries(library):
    assert library.query("SELECT count(*) AS n FROM v_books").first()["n"] == 6
    assert library.query("SELECT asin FROM v_books WHERE list_contains(genres, 'Essays') LIMIT 5").count() == 1
    assert library.query("SELECT asin FROM v_books WHERE list_has_any(genres, array('Craft', 'x')) ORDER BY asin LIMIT 3;").count() == 1
    assert library.query("WITH g AS (SELECT genre FROM v_book_genres) SELECT * FROM g LIMIT 10 OFFSET 1").count() == 3
    assert library.query("SELECT title FROM books b WHERE EXISTS (SELECT 1 FROM book_genres g WHERE g.asin = b.asin) AND asin IN (SELECT asin FROM v_books) LIMIT 9").count() == 3
    assert library.query("PRAGMA table_info('books')").count() == 7 and library.query("PRAGMA database_list").count() == 1
    assert library.query("DESCRIBE books").count() == 7 and library.query("SHOW TABLES").count() > 20 and library.query("EXPLAIN SELECT 1").count() == 1
    assert json.loads(gateway.as_json(library.query("SELECT title, series_title FROM v_books WHERE asin = 'B0TOME0005' LIMIT 1"))) == [{"title": "C:\\Maps\\Book of Roads", "series_title": None}]
    assert gateway.as_json(library.query("SELECT title FROM books LIMIT 0")) == "[]"
    outside = ("SELECT * FROM csv.`/etc/passwd` LIMIT 5", "SELECT 1 AS a WHERE EXISTS (SELECT 1 FROM text.`/etc/hosts`) LIMIT 1", "WITH c AS (SELECT * FROM parquet.`/x`) SELECT * FROM c LIMIT 1", "SELECT * FROM nowhere LIMIT 1")
    called = ("SELECT reflect('java.lang.System', 'exit', 0) LIMIT 1", "SELECT 1 + length(java_method('java.lang.System', 'getenv', 'HOME')) AS n FROM books LIMIT 1", "SELECT (SELECT max(try_reflect('a', 'b')) FROM books) AS x LIMIT 1")
    for bad in (*outside, *called):
        with pytest.raises(guard.GuardError):
            library.query(bad)
    for bad in ("WITH c AS (SELECT 1) INSERT INTO books SELECT * FROM c LIMIT 1", "SELECT a b c d FROM x LIMIT 5", "PRAGMA nothing"):
        with pytest.raises(guard.GuardError):
            library.query(bad)


ACCEPTED = [
    "SELECT asin FROM books LIMIT 10", "select asin from books limit 10 offset 5", "SELECT asin FROM books LIMIT 1;", "SELECT count(*) FROM books", "SELECT count(distinct asin) AS n, max(title) t FROM v_books WHERE title = 'a;b'",
    "WITH x AS (SELECT 1) SELECT * FROM x LIMIT 3 -- end", "SHOW TABLES", "DESCRIBE books", "PRAGMA table_info('books')", "SELECT min(a) FROM (SELECT a FROM b GROUP BY a)", "SELECT 'union' FROM b LIMIT 1", "SELECT avg(x) FROM t ORDER BY 1",
]
REJECTED = [
    "DELETE FROM books", "INSERT INTO books VALUES (1)", "SELECT asin FROM books", "SELECT asin FROM books -- LIMIT 10", "SELECT asin FROM books /* LIMIT 10 */", "SELECT * FROM (SELECT * FROM v_books LIMIT 10) t",
    "SELECT asin FROM books FETCH FIRST 10 ROWS ONLY", "SELECT asin FROM books OFFSET 10", "SELECT asin FROM books LIMIT ALL", "SELECT 'LIMIT 10'", "SELECT 1; SELECT 2", "SELECT count(*) FROM a GROUP BY b", "SELECT count(*), asin FROM a",
    "SELECT count(*) FROM a UNION SELECT count(*) FROM b", "SELECT sum(abs(x)) FROM a", "SELECT count(*)", "-- c\nSELECT 1 LIMIT 1", "SELECT asin FROM books LIMIT 2+3", "",
]


@pytest.mark.parametrize("sql", ACCEPTED)
def test_accepted_texts(sql):
    guard.check_text(sql)


@pytest.mark.parametrize("sql", REJECTED)
def test_rejected_texts(sql):
    with pytest.raises(guard.GuardError):
        guard.check_text(sql)
    if sql.startswith("SELECT asin FROM books") and "ALL" not in sql:
        guard.check_text(sql, allow_unlimited=True)


@pytest.mark.parametrize("sql", ["CREATE TABLE x AS SELECT 1", "DROP VIEW books", "SET a = b", "INSERT INTO books SELECT 1", "CACHE TABLE books", "WITH c AS (SELECT 1 a) INSERT OVERWRITE books SELECT * FROM c"])
def test_plans_that_write_are_rejected(spark, sql):
    with pytest.raises(guard.GuardError):
        guard.check_plan(spark, sql)


def test_escaped_terms():
    assert guard.escape_like("50%_\\") == "50\\%\\_\\\\"


BAD = {
    "{}": "must be an array", "[": "Invalid JSON", "[1]": "index 0: each item must be an object", '[{"asin": "A"}]': "ASIN A: missing or empty required key 'acquiredTime'; ASIN A: missing or empty required key 'authors'",
    '[{"asin": " ", "title": "t", "authors": "a", "readStatus": "R", "acquiredTime": 1}]': "index 0: missing or empty required key 'asin'",
    '[{"asin": "A", "title": 5, "authors": "a", "readStatus": "R", "acquiredTime": true}]': "ASIN A: 'title' must be str; ASIN A: 'acquiredTime' must be int epoch milliseconds",
    '[{"asin": "A", "title": "t", "authors": "a", "readStatus": "R", "acquiredTime": 1.0}]': "must be int epoch milliseconds", '[{"asin": "A", "title": "t", "authors": "a", "readStatus": "R", "acquiredTime": -1}]': "must satisfy 0 <=",
    '[{"asin": "A", "title": "t", "authors": "a", "readStatus": "R", "acquiredTime": 4102444800000, "productImage": 4}]': "'productImage' must be str or null; ASIN A: 'acquiredTime' must satisfy",
    '[{"asin": "A", "title": "t", "authors": "a", "readStatus": "R", "acquiredTime": 1}, {"asin": "A", "title": "t", "authors": "a", "readStatus": "R", "acquiredTime": 1}]': "Duplicate ASIN values: A",
}


@pytest.mark.parametrize("text", BAD)
def test_bad_exports_change_nothing(spark, tmp_path, text):
    store = Store(tmp_path / "db")
    with pytest.raises(ValueError) as e:
        library_json.import_library(spark, store, write_json(tmp_path / "x.json", text), NOW)
    assert BAD[text] in str(e.value) and not store.exists


def test_unknown_keys_are_told(spark, tmp_path):
    told = []
    library_json.validate(library_json.read_items(spark, write_json(tmp_path / "x.json", [BOOKS[0] | {"zeta": 1, "alpha": 2}])), told.append)
    assert told == ["ASIN B0TOME0001: ignoring unknown keys: alpha, zeta"]


def test_bad_archives(spark, tmp_path):
    store = Store(tmp_path / "db")
    for sets, message in (({k: v for k, v in SETS.items() if k != "CustomerGenres_FE"}, "missing: Kindle.UnifiedLibraryIndex.CustomerGenres_FE"), (SETS | {"CustomerGenres_FE": ["Product Name,ASIN", "x,y"]}, "missing Genre; actual columns: Product Name, ASIN")):
        with pytest.raises(ValueError, match=message):
            archive.import_archive(spark, store, write_zip(tmp_path / "a.zip", sets), NOW)
    (tmp_path / "no.zip").write_text("x")
    with pytest.raises(ValueError, match="Not a zip file"):
        archive.import_archive(spark, store, tmp_path / "no.zip", NOW)
    with pytest.raises(FileNotFoundError):
        archive.import_archive(spark, store, tmp_path / "none.zip", NOW)


def test_store_is_atomic(spark, tmp_path):
    store = Store(tmp_path / "db")
    one = spark.createDataFrame([("B1", "x")], "asin string, genre string")
    store.commit({"book_genres": one})
    with pytest.raises(ValueError, match="repeated"):
        store.commit({"bib_refetch_done": one.select("asin"), "book_genres": one.union(one)})
    assert store.read(spark, "book_genres").count() == 1 and store.read(spark, "bib_refetch_done").count() == 0 and store.manifest()["version"] == 1
    with store.lock(), pytest.raises(StoreLocked):
        store.commit({"book_genres": one})
    for _ in range(3):
        store.commit({"book_genres": store.read(spark, "book_genres")})
    assert store.vacuum() and store.read(spark, "book_genres").count() == 1
    store.delete()
    with pytest.raises(FileNotFoundError):
        store.delete()
    with pytest.raises(ValueError):
        Store(" ")


def test_labels(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("# c\n\n336\t経営管理\n007\t\"情報\"\n", encoding="utf-8")
    assert rows(labels.read_labels(spark, tmp_path / "l.tsv")) == [("007", '"情報"'), ("336", "経営管理")]
    block = 'ndc9:{0} a {2} ;\n    skos:notation "{1}" ;\n    skos:prefLabel "{3}"@ja ;\n    skos:x "y" ;'
    text = "\n.\n".join(["@prefix x: <y>", block.format("336", "336", "ndcv:Section", "経営管理"), block.format("33", "33", "ndcv:Division", "経済"), block.format("841", "841", "ndcv:Variant", "別法"), block.format("007", "007", "skos:Concept", "情報"), ""])
    (tmp_path / "l.ttl").write_text(text, encoding="utf-8")
    assert [tuple(r) for r in labels.labels_of_turtle(spark, tmp_path / "l.ttl").collect()] == [("007", "情報"), ("336", "経営管理")]
    (tmp_path / "l.ttl").write_text(text + text, encoding="utf-8")
    with pytest.raises(ValueError, match="007, 336"):
        labels.labels_of_turtle(spark, tmp_path / "l.ttl")


def test_fields(spark):
    from tomewise.functions import fields

    cases = {
        fields.isbn13: {"4-8222-5085-0": "9784822250850", "978-4-8222-5085-0": "9784822250850", "x": None, "４８２２２５０８５０": "9784822250850", "080442957X": "9780804429573", None: None},
        fields.isbn_ok: {"4822250857": True, "9784822250850": True, "9784822250851": False, "080442957X": True, "0804429571": False, "": False, None: False},
        fields.issued: {"2015.4": "2015-04", "[2020]": "2020", "2020.13": None, "2020.3.5": "2020-03-05", "２０１５．１２": "2015-12", "c2015": None, "2020.3.32": None, None: None},
        fields.pages: {"389p": 389, "209, 13p 図版16枚 ; 19cm": 209, "ページ付なし": None, "1冊": None, "xi, 20 pages": 20, "12ページ": 12, None: None},
        fields.safe_int: {" 12 ": 12, "１２": 12, "1_000": 1000, "-3": -3, "1.0": None, "": None, "99999999999": None},
        fields.null_marker: {"　a ": "a", "Not Available": None, " ": None},
    }
    for f, values in cases.items():
        got = spark.createDataFrame([(k,) for k in values], "x string").select("x", f(F.col("x")).alias("y")).collect()
        assert {r["x"]: r["y"] for r in got} == values, f.__name__

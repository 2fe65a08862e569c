"""Matching, the enrichment state machine, corrections, rematching and review, with a fake search service."""

import http.client
import urllib.error
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from library_data import item, response, write_json
from tomewise.functions import titles
from tomewise.plans import enrichment, matching, review
from tomewise.plans.views import reader
from tomewise.sources import library_json, overrides, records, search_api
from tomewise.sources.labels import no_labels
from tomewise.sources.search_api import RetryLater, SearchError
from tomewise.sources.store import Store

NOW = datetime(2026, 1, 2, 3, 4, 5)
BOOK = "asin string, title string, series_title string, source string"
CANDIDATE = "asin string, candidate_id string, search_rank int, item_xml string"


def matched(spark, cases):
    """Match {asin: (title, series, source, [items])}."""
    books = spark.createDataFrame([(a, t, s, src) for a, (t, s, src, _) in cases.items()], BOOK)
    rows = [(a, records.parse_record(x)["id"], n, x) for a, (_, _, _, items) in cases.items() for n, x in enumerate(items, 1)]
    return {r["asin"]: r for r in matching.match(books, spark.createDataFrame(rows, CANDIDATE)).collect()}


def test_matches(spark):
    full = dict(volume="10", series=("Beam comix ; 3",), isbns=("4-8222-5085-0", "bad"), issued="2015.4", extent="389p ; 19cm", publishers=("A", "B"), subjects=("漫画", "歴史"), ndcs=(("9", "726.1"), ("10", "726.101")), descriptions=("注記", "2015", "注記", "出版"))
    later = dict(edition="新版")
    cases = {
        "edition": ("エマ 10巻 (HARTA COMIX)", None, "title", [item(1, "エマ", **full), item(2, "エマ", volume="9"), item(3, "別の本", volume="10")]),
        "work": ("本の題", None, "title", [item(1, "本の題", subjects=("a", "b"), isbns=("9784822250850",), ndcs=(("9", "336"),)), item(2, "本の題", subjects=("b", "a"), ndcs=(("10", "336"),))]),
        "same isbn": ("本の題", None, "title", [item(1, "本の題", isbns=("9784822250850", "9784822250867")), item(2, "本の題", isbns=("9784822250867",)), item(3, "本の題", isbns=("4822250857",))]),
        "label": ("本の題 (ハヤカワ文庫JA)", None, "title", [item(1, "本の題", series=("ハヤカワ文庫 ; 1",)), item(2, "本の題")]),
        "later by label": ("本の題 (ハヤカワ文庫JA)", None, "title", [item(1, "本の題", series=("ハヤカワ文庫 ; 1",), **later), item(2, "本の題")]),
        "wanted edition": ("本の題 新版", None, "title", [item(1, "本の題", **later), item(2, "本の題", edition="改訂新版")]),
        "no such edition": ("本の題 第3版", None, "title", [item(1, "本の題", edition="第2版")]),
        "special only": ("蟲師", None, "title", [item(1, "蟲師 : 愛蔵版")]),
        "second reading": ("アート・オブ Fallout 4", None, "title", [item(1, "アート・オブ Fallout 4")]),
        "other provider": ("本の題", None, "title", [item(1, "本の題", prefix="R100000001-I"), item(2, "本の題", categories=("図書", "録音資料"))]),
        "isbn": ("何でも", None, "isbn", [item(1, "別の題", issued="2020"), item(2, "別の題", categories=("図書",))]),
        "none": ("本の題", None, "title", []),
    }
    got = matched(spark, cases)
    one = got["edition"]
    assert (one["method"], one["candidate_ids"], one["isbn"], one["paper_issued"], one["publisher"], one["pages"], one["bib_series"]) == ("edition", ["R100000002-I1"], "9784822250850", "2015-04", "A, B", 389, "Beam comix ; 3")
    assert (one["ndc"], one["ndc_edition"], one["subjects"], one["notes"]) == ("726.101", "10", ["漫画", "歴史"], ["注記"])
    two = got["work"]
    assert (two["method"], two["isbn"], two["subjects"], two["ndc"], two["ndc_edition"], two["notes"]) == ("work", None, ["a", "b"], "336", None, [])
    told = {a: (r["method"], [int(i.rpartition("I")[2]) for i in r["candidate_ids"] or []]) for a, r in got.items()}
    assert told == {
        "edition": ("edition", [1]), "work": ("work", [1, 2]), "same isbn": ("edition", [1]), "label": ("edition", [1]), "later by label": ("work", [1]), "wanted edition": ("edition", [1]), "no such edition": ("work", [1]),
        "special only": ("work", [1]), "second reading": ("edition", [1]), "other provider": (None, []), "isbn": ("isbn", [1]), "none": (None, []),
    }


def test_records():
    r = records.parse_record(item(7, " T ", volume="2", ndcs=(("9", "336"), ("", "33"), ("X", "no")), subjects=("s",)))
    assert r["id"] == "R100000002-I7" and r["title"] == "T" and r["ndcs"] == [{"edition": "9", "code": "336"}, {"edition": "", "code": "33"}] and r["subjects"] == ["s"] and r["edition"] is None
    total, items = records.parse_response(response([item(1, "a"), item(2, "b")], total=700))
    assert total == 700 and len(items) == 2 and "seeAlso" not in items[0]
    for bad in ("<rss>", "<rss><channel/></rss>"):
        with pytest.raises(records.RecordError):
            records.parse_response(bad)
    for bad in ("<item></item>", "<item>", "<x/>"):
        with pytest.raises(records.RecordError):
            records.parse_record(bad)


def test_the_expression_reads_records_as_the_parser_does(spark):
    items = [
        item(7, " T &amp; U ", volume="02", series=("a ; 1", "b"), isbns=("97", "X"), edition="新版", issued="2015.4", extent="3p", publishers=("A", "B"), subjects=("s", "2020"), ndcs=(("9", "336.0"), ("", "33"), ("X", "no")), descriptions=("n", " ")),
        "<item><link>https://x/I1/</link><title>only</title><dc:title xml:lang='ja'> first </dc:title><dc:title>second</dc:title><dc:subject/><dc:identifier>5</dc:identifier></item>", "<item><link>I2</link></item>",
    ]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(items)], "n int, xml string").select("n", records.record_of("xml").alias("r")).orderBy("n").collect()
    assert [r["r"].asDict(recursive=True) for r in rows] == [records.parse_record(x) for x in items]
    broken = spark.createDataFrame([("<item><link>x</link>",), ("",), (None,), ("<item/>",)], "xml string").select(records.record_of("xml").alias("r")).collect()
    assert [(r["r"]["id"], r["r"]["title"], r["r"]["series"]) for r in broken] == [(None, "", [])] * 4


class Fake:
    """Answers by parameters; what isn't registered has no results."""

    def __init__(self, answers=None):
        self.answers, self.calls = answers or {}, []

    def search(self, params):
        self.calls.append(params)
        found = self.answers.get(tuple(sorted(params.items())), (0, []))
        if isinstance(found, BaseException):
            raise found
        return found


def params(**p):
    return tuple(sorted(p.items()))


LIBRARY = [{"asin": f"B00000000{k}", "title": t, "authors": a, "acquiredTime": 1705314600000 + k, "readStatus": "READ"} for k, (t, a) in enumerate([("本の題", "著者"), ("別の題 2", "著者"), ("分冊版の本 分冊版", "著者"), ("広い題", "著者")])]


@pytest.fixture
def store(spark, tmp_path):
    store = Store(tmp_path / "db")
    library_json.import_library(spark, store, write_json(tmp_path / "x.json", LIBRARY), NOW)
    return store


def state(spark, store):
    return {r["asin"][-1]: r["status"] for r in store.read(spark, "bib_fetches").collect()}


def answers():
    return {params(title="本の題", creator="著者"): (1, [item(1, "本の題", isbns=("9784822250850",), subjects=("s", "t"), descriptions=("n",))]), params(title="広い題", creator="著者"): (501, []), params(title="広い題"): (900, []), params(isbn="9784822250850"): (1, [item(9, "別の題", volume="2")])}


def test_enrich_and_its_states(spark, store):
    fake = Fake(answers())
    s = enrichment.enrich(spark, store, fake, lambda: NOW)
    assert s.counts == {"found": 1, "not_found": 2, "incomplete": 1} and state(spark, store) == {"0": "found", "1": "not_found", "2": "not_found", "3": "incomplete"}
    assert params(title="広い題", creator="著者") in map(lambda c: tuple(sorted(c.items())), fake.calls) and len(fake.calls) == 5
    read = reader(spark, store, no_labels(spark))
    book = read("v_books").where("asin = 'B000000000'").first()
    assert (book["bib_status"], book["bib_match"], book["isbn"], book["subjects"], book["bib_notes"]) == ("found", "edition", "9784822250850", ["s", "t"], ["n"])
    assert enrichment.enrich(spark, store, Fake(), lambda: NOW).targets == 0
    # A failed refresh keeps what there was; a missing book becomes an error and is tried again.
    failing = Fake({params(title="本の題", creator="著者"): SearchError("down")})
    s = enrichment.enrich(spark, store, failing, lambda: NOW, where="asin = 'B000000000'", refresh=True)
    assert s.counts == {"error": 1} and state(spark, store)["0"] == "found"
    pending = store.read(spark, "bib_refetch_pending").first()
    assert (pending["mode"], pending["where_clause"]) == ("refresh", "asin = 'B000000000'")
    s = enrichment.enrich(spark, store, Fake(answers()), lambda: NOW, where="asin = 'B000000000'", refresh=True)
    assert s.targets == 1 and store.read(spark, "bib_refetch_pending").count() == 0 and store.read(spark, "bib_refetch_done").count() == 0
    assert enrichment.enrich(spark, store, Fake(), lambda: NOW, retry_missing=True, limit=2).truncated
    with pytest.raises(ValueError, match="Invalid --where"):
        enrichment.enrich(spark, store, Fake(), lambda: NOW, where="no_such_column = 1")


def test_errors_stop_a_run_and_it_resumes(spark, store):
    down = Fake({params(title="本の題", creator="著者"): SearchError("x"), params(title="別の題", creator="著者"): RetryLater(900)})
    s = enrichment.enrich(spark, store, down, lambda: NOW)
    assert s.aborted == "retry_later" and state(spark, store) == {"0": "error"}
    assert enrichment.enrich(spark, store, Fake(answers()), lambda: NOW).targets == 4


def broken_item():
    return "<item><link>x/R100000002-I5</link><category>図書</category"


def test_one_unreadable_record_is_one_book_s_error(spark, store):
    fake = Fake(answers() | {params(title="本の題", creator="著者"): (1, [broken_item()])})
    s = enrichment.enrich(spark, store, fake, lambda: NOW)
    assert s.aborted is None and state(spark, store) == {"0": "error", "1": "not_found", "2": "not_found", "3": "incomplete"}
    assert "unreadable record" in store.read(spark, "bib_fetches").where("status = 'error'").first()["error"]


def test_results_are_kept_however_a_run_ends(spark, store):
    class Bug(Exception):
        pass

    with pytest.raises(Bug):
        enrichment.enrich(spark, store, Fake(answers() | {params(title="広い題"): Bug()}), lambda: NOW)
    assert state(spark, store) == {"0": "found", "1": "not_found", "2": "not_found"}
    s = enrichment.enrich(spark, store, Fake(answers() | {params(title="広い題"): KeyboardInterrupt()}), lambda: NOW)
    assert s.aborted == "interrupt" and s.targets == 1


def test_failures_in_a_row_end_a_run():
    class Down:
        def search(self, _):
            raise SearchError("down")

    rows = [Row(asin=str(k), title="砂の城", authors_text="岸辺", series_title=None, isbn=None) for k in range(9)]
    summary = enrichment.RunSummary()
    assert len(list(enrichment.fetched(Down(), iter(rows), summary))) == enrichment.FAILURES and summary.aborted == "network"


def test_a_locked_store_is_tried_again_after_as_many_books():
    tries, locked = [], [True]

    def write(batch, taken):
        tries.append(len(batch))
        if locked[0]:
            raise enrichment.StoreLocked("held")

    committer = enrichment.Committer(write, lambda _: None)
    for k in range(50):
        committer.add(enrichment.Fetched(str(k), "found", "title"))
    assert set(tries) == {20, 40} and len(committer.batch) == 50
    locked[0] = False
    committer.flush(0)
    assert tries[-1] == 50 and not committer.batch and committer.taken == 50


def test_verdicts_are_a_function_of_the_answers():
    plan = titles.search_stages("砂の城 3巻", "岸辺", "砂")
    first, second, third = (enrichment.asked(s.params) for s in plan)
    narrow = [enrichment.asked(p) for p in plan[0].refinements]
    verdict = lambda known, hits=(): enrichment.verdict(plan, known, lambda k: k in hits)
    assert verdict({}).params == plan[0].params and verdict({first: (501, [])}).params == plan[0].refinements[0]
    assert verdict({first: (501, []), narrow[0]: (3, [])}, {narrow[0]}) == ("found", narrow[0])
    known = {first: (501, []), narrow[0]: (502, []), second: (9, []), third: (0, [])}
    assert verdict(known) == ("incomplete", None) and verdict(known, {third}) == ("found", third) and verdict(known, {third, second}) == ("found", second)
    assert verdict({first: (1, []), second: (2, []), third: (0, [])}) == ("not_found", None) == enrichment.verdict([], {}, bool)
    assert [x["total"] for x in enrichment.steps_taken(plan, known, None)] == [501, 502, 9, 0] and [x["total"] for x in enrichment.steps_taken(plan, known, second)] == [501, 502, 9]


def written(store, name):
    return sum(f.stat().st_size for f in (store.root / name).rglob("*.parquet"))


def test_commits_write_their_own_rows_only(spark, store, monkeypatch):
    many = spark.range(200_000).selectExpr("cast(id as string) as asin", "'found' as status", "'title' as source", "repeat(md5(cast(id as string)), 2) as stages", "null as error", "timestamp_ntz'2020-01-01 00:00:00' as fetched_at")
    store.commit({"bib_fetches": many})
    before = written(store, "bib_fetches")
    monkeypatch.setattr(enrichment, "FLUSH", 2)
    sizes = []
    monkeypatch.setattr(Store, "compact", lambda self, spark: sizes.append((self.deltas(), written(self, "bib_fetches"))))
    enrichment.enrich(spark, store, Fake(answers()), lambda: NOW)
    assert sizes[0][0] == 2 and sizes[0][1] - before < 20_000
    assert {r["asin"]: r["status"] for r in store.read(spark, "bib_fetches").where("length(asin) = 10").collect()} == {"B000000000": "found", "B000000001": "not_found", "B000000002": "not_found", "B000000003": "incomplete"}
    monkeypatch.undo()
    store.compact(spark)
    assert store.deltas() == 0 and store.read(spark, "bib_fetches").count() == 200_004


def test_a_store_of_another_schema_is_rewritten(spark, store):
    import json

    path = store.root / "manifest.json"
    manifest = json.loads(path.read_text())
    folder = store.root / manifest["tables"]["books"]
    spark.read.parquet(f"file://{folder}").drop("product_image_url").withColumn("gone", F.lit(1)).write.parquet(f"file://{folder}-old")
    manifest["tables"]["books"] += "-old"
    path.write_text(json.dumps(manifest | {"schema_hash": "another"}))
    assert store.upgrade(spark) and not store.upgrade(spark)
    assert store.read(spark, "books").where("product_image_url is null").count() == 4 and store.manifest()["schema_hash"] != "another"


def test_broken_connections_are_search_errors():
    for failure in (http.client.IncompleteRead(b""), http.client.RemoteDisconnected("x"), UnicodeDecodeError("utf-8", b"", 0, 1, "x"), TimeoutError()):
        def fetch(_, failure=failure):
            raise failure

        with pytest.raises(SearchError):
            search_api.Client(fetch, lambda: 0.0, lambda _: None).search({"title": "q"})


def test_flushes_wait_for_the_store(spark, store):
    slept = []
    with store.lock(), pytest.raises(enrichment.StoreLocked):
        enrichment.patiently(lambda: store.commit({}), 30, slept.append)
    assert slept == [1, 2, 4, 8, 10, 5]
    held = store.lock()
    held.__enter__()

    def sleep(seconds):
        slept.append(seconds)
        held.__exit__(None, None, None)

    assert enrichment.enrich(spark, store, Fake(answers()), lambda: NOW, where="asin = 'B000000000'", sleep=sleep).counts == {"found": 1} and slept[-1] == 1
    assert state(spark, store) == {"0": "found"}


def test_overrides(spark, store, tmp_path):
    enrichment.enrich(spark, store, Fake(answers()), lambda: NOW)
    path = tmp_path / "overrides.csv"
    path.write_text("﻿ASIN,isbn\nB000000001,978-4-8222-5085-0\n\nB000000000,\nB00000000X,\n", encoding="utf-8")
    given = overrides.read_overrides(spark, path)
    assert given == {"B000000001": "9784822250850", "B000000000": None, "B00000000X": None}
    s = enrichment.enrich(spark, store, Fake(answers()), lambda: NOW, overrides=given, overrides_path=path)
    assert (s.overrides.reset, s.overrides.excluded, s.overrides.unknown, s.overrides.total) == (["B000000001"], ["B000000000", "B00000000X"], ["B00000000X"], 3)
    assert state(spark, store) == {"0": "excluded", "1": "found", "2": "not_found", "3": "incomplete", "X": "excluded"}
    read = reader(spark, store, no_labels(spark))
    assert read("bib_matches").first()["method"] == "isbn"
    labels = {v: [b["label"] for b in review.list_books(read, given, v)["books"]] for v in review.VIEWS}
    assert labels == {"review": ["not_found", "incomplete"], "corrected": ["isbn"], "excluded": ["excluded"], "all": ["not_found", "isbn", "incomplete", "excluded"]}
    assert review.list_books(read, {}, "review")["total"] == 4 and review.list_books(read, given, "review", staged=("B000000001",))["total"] == 3
    assert [b["asin"] for b in review.list_books(read, given, "all", query="別の")["books"]] == ["B000000001"]
    detail = review.book_detail(read, "B000000001", given)
    assert detail["book"]["label"] == "isbn" and detail["book"]["override"] == {"isbn": "9784822250850", "excluded": False} and not detail["book"]["pending"]
    assert [(c["id"], c["matched"], c["volume"]) for c in detail["candidates"]] == [("R100000002-I9", True, "2")]
    with pytest.raises(LookupError):
        review.book_detail(read, "B999999999", given)
    changed = review.merged_overrides(read, given, [{"asin": "B000000001", "action": "clear"}, {"asin": "B000000002", "action": "isbn", "isbn": "4822250857"}, {"asin": "B000000003", "action": "exclude"}])
    assert changed == {"B000000000": None, "B00000000X": None, "B000000002": "9784822250850", "B000000003": None}
    with pytest.raises(ValueError, match="Invalid ISBN for B000000001.*; No book"):
        review.merged_overrides(read, given, [{"asin": "B000000001", "action": "isbn", "isbn": "1"}, {"asin": "B999999999", "action": "exclude"}])
    overrides.write_overrides(path, changed)
    assert overrides.read_overrides(spark, path) == changed
    wrong = r"line 2 \(A\): it has other than two columns; line 3 \(no id\): the id is missing, the ISBN's form.* is wrong; line 5 \(A\): the id was given before; line 6 \(B\): the ISBN's form"
    for text, message in (("", "must name the columns"), ("a,b\n", "must name the columns asin and isbn, not a, b"), ("asin,isbn\nA,1,2\n,5\nA,\nA,\nB,123\n", wrong)):
        path.write_text(text, encoding="utf-8")
        with pytest.raises(ValueError, match=message):
            overrides.read_overrides(spark, path)


def test_rematch(spark, store):
    enrichment.enrich(spark, store, Fake(answers()), lambda: NOW)
    s = enrichment.rematch(spark, store, NOW)
    assert (s.books, s.changed, s.lost) == (1, 0, 0)
    store.commit({"bib_candidates": store.read(spark, "bib_candidates").withColumn("item_xml", F.lit(item(1, "違う題")))})
    s = enrichment.rematch(spark, store, NOW)
    assert (s.books, s.changed, s.lost) == (1, 1, 1) and store.read(spark, "bib_matches").count() == 0 and state(spark, store)["0"] == "found"
    read = reader(spark, store, no_labels(spark))
    assert "unmatched" in [b["label"] for b in review.list_books(read, {}, "review")["books"]]


def test_resolution_of_stages(spark):
    rows = [("a", 0, 0, 900), ("a", 0, 1, 300), ("a", 0, 2, 10), ("a", 1, 0, 700), ("b", 0, 0, 500)]
    got = enrichment.resolve(spark.createDataFrame(rows, "asin string, stage_no int, ref_no int, total int")).collect()
    assert sorted(map(tuple, got)) == [("a", 0, 1), ("b", 0, 0)]


def test_client_paces_and_retries():
    now, slept, texts = [0.0], [], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    def fetch(address):
        texts.append(address)
        if isinstance(out := replies.pop(0), Exception):
            raise out
        return out

    busy = lambda after=None: urllib.error.HTTPError("x", 429, "busy", {"Retry-After": after} if after else {}, None)
    client = search_api.Client(fetch, lambda: now[0], sleep)
    replies = [response([item(1, "a")]), busy(), busy("30"), response([])]
    assert client.search({"title": "x y"})[0] == 1 and client.search({"title": "z"}) == (0, [])
    assert "title=x+y" in texts[0] and slept == [3.0, 60.0, 30.0]
    replies = [busy("601")]
    with pytest.raises(RetryLater):
        client.search({"title": "q"})
    replies = [urllib.error.HTTPError("x", 500, "no", {}, None)]
    with pytest.raises(SearchError):
        client.search({"title": "q"})
    replies = [busy(), busy(), busy(), busy("601")]
    with pytest.raises(RetryLater):
        client.search({"title": "q"})
    replies = [busy()] * 4
    with pytest.raises(SearchError):
        client.search({"title": "q"})

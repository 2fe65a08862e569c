"""Commands, correction API, streamed results, and the driver's contract."""

import json
import threading
import urllib.error
import urllib.request
from datetime import datetime

import pytest

import __spark_entry__
from library_data import item, write_json, write_zip
from tomewise import cli
from tomewise.plans import bindings, gateway
from tomewise.server import FixServer
from tomewise.sources import library_json
from tomewise.sources.store import Store
from tomewise.streaming.results import merge_stream

NOW = datetime(2026, 1, 2, 3, 4, 5)


class Silent:
    def search(self, params):
        return (1, [item(1, "灯台の手帖")]) if params.get("title") == "灯台の手帖" else (0, [])


def test_commands(spark, tmp_path):
    said = []
    run = lambda *a, **k: cli.run(["--db", str(tmp_path / "db"), *a], said.append, Silent(), **k)
    assert run("status") == 1 and "import a library first" in said[-1]
    assert run("import", str(write_json(tmp_path / "x.json"))) == 0 and said[-1] == "Imported 6 books."
    assert run("import-official", str(write_zip(tmp_path / "x.zip"))) == 0
    assert run("search", "book", "-n", "1") == 0 and said[-1] == "Showing 1 of 2 results."
    assert run("search", "nothing") == 0 and said[-1] == "No results found."
    assert run("query", "SELECT asin FROM books") == 1 and "LIMIT" in said[-1]
    assert run("query", "SELECT asin, acquired_at FROM books ORDER BY asin LIMIT 1") == 0 and json.loads("\n".join(said[said.index("[") :])) == [{"asin": "B0TOME0001", "acquired_at": "2021-02-03 09:47:58"}]
    assert run("query", "SELECT no_such_column FROM books LIMIT 1") == 1 and said[-1].startswith("Error: [UNRESOLVED_COLUMN") and "\n" not in said[-1]
    assert run("query", "SELECT cast(title AS int) AS n FROM books LIMIT 1") == 1 and said[-1].startswith("Error: [CAST_INVALID_INPUT]")
    assert run("query", "-t", "SELECT asin, genres FROM v_books ORDER BY asin LIMIT 2") == 0 and "Essays, Sea" in said[-1]
    assert run("enrich", "--where", "asin = 'B0TOME0001'") == 0 and said[-1] == "1 books: found 1"
    assert run("rematch") == 0 and said[-1] == "Rematched 1 books: 0 changed, 0 without a match."
    assert run("status") == 0 and "Bib match: edition" in said[-1] and run("authors") == 0 and run("recent", "-n", "2") == 0
    assert run("delete", ask=lambda _: "n") == 0 and (tmp_path / "db").exists()
    assert run("delete", "-y") == 0 and not (tmp_path / "db").exists() and run("delete", "-y") == 1
    with pytest.raises(SystemExit):
        cli.run(["--db", "", "status"])


def test_log_files(tmp_path, capsys):
    said = []
    cli.route_log(False, str(tmp_path / "a.log"), said.append)
    cli.log.info("kept from the screen", extra={"file_only": True})
    cli.log.warning("on both")
    text = (tmp_path / "a.log").read_text()
    assert "kept from the screen" in text and "on both" in text and capsys.readouterr().err == "on both\n" and not said
    cli.route_log(True, str(tmp_path / "missing" / "a.log"), said.append)
    cli.log.warning("once")
    cli.log.warning("twice")
    assert len(said) == 1 and "can't write" in said[0]


def test_tables_fold_by_cells():
    text = gateway.as_table(["a", "title"], [(1, "灯" * 40), (None, ["x", "y"])])
    lines = text.split("\n")
    assert lines[0] == "a  title" and lines[1] == "1  " + "灯" * 30 and lines[2] == "   " + "灯" * 10 and lines[3] == "   x, y"


def test_correction_api(spark, tmp_path):
    store = Store(tmp_path / "db")
    library_json.import_library(spark, store, write_json(tmp_path / "x.json"), NOW)
    path = tmp_path / "overrides.csv"
    with FixServer(spark, store, path, Silent()) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()

        def call(url, body=None, token=server.token, host=None, kind="application/json"):
            headers = {"X-Tomewise-Token": token, "Content-Type": kind} | ({"Host": host} if host else {})
            request = urllib.request.Request(f"http://127.0.0.1:{server.port}{url}", json.dumps(body).encode() if body is not None else None, headers)
            try:
                with urllib.request.urlopen(request, timeout=120) as r:
                    return r.status, json.load(r)
            except urllib.error.HTTPError as e:
                return e.code, json.load(e)

        assert call("/api/state", token="x")[0] == 403 and call("/api/state", host="evil.example")[0] == 403 and call("/nothing")[0] == 404
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"http://127.0.0.1:{server.port}/")
        with urllib.request.urlopen(f"http://127.0.0.1:{server.port}/?token={server.token}") as r:
            page = r.read().decode()
            assert r.headers["Content-Type"] == "text/html; charset=utf-8" and r.headers["X-Frame-Options"] == "DENY" and server.token in page and "/api/books" in page
        assert call("/api/state")[1] == {"db": str(store.root), "overrides_path": str(path), "overrides_exists": False, "overrides": {}, "pending": []}
        assert call("/api/books?view=all")[1]["total"] == 6 and call("/api/books?view=x")[0] == 400 and call("/api/books/B999999999")[0] == 404
        assert call("/api/apply", {"changes": [{"asin": "B0TOME0002", "action": "exclude"}]})[1] == {"targets": 0, "counts": {}, "aborted": None}
        assert call("/api/apply", {"changes": 3})[0] == 400 and call("/api/apply", {}, kind="text/plain")[0] == 400
        assert call("/api/books?view=excluded")[1]["books"][0]["asin"] == "B0TOME0002" and path.read_text() == "asin,isbn\nB0TOME0002,\n"
        server.shutdown()


def test_streamed_results(spark, tmp_path):
    store = Store(tmp_path / "db")
    library_json.import_library(spark, store, write_json(tmp_path / "x.json"), NOW)
    incoming = tmp_path / "in"
    incoming.mkdir()

    def arrive(name, *rows):
        (incoming / name).write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
        merge_stream(spark, store, incoming, tmp_path / "checkpoint", lambda: NOW).awaitTermination()

    good = {"asin": "B0TOME0001", "status": "found", "source": "title", "candidates": [{"candidate_id": "R100000002-I1", "search_rank": 1, "item_xml": item(1, "灯台の手帖")}]}
    arrive("1.json", good, {"asin": "B0TOME0002", "status": "error", "error": "x"}, {"asin": "B0TOME0001", "status": "not_found"})
    assert {r["asin"]: r["status"] for r in store.read(spark, "bib_fetches").collect()} == {"B0TOME0001": "found", "B0TOME0002": "error"}
    assert store.read(spark, "bib_matches").first()["method"] == "edition"
    arrive("2.json", {"asin": "B0TOME0001", "status": "error"}, {"asin": "B0TOME0002", "status": "not_found"})
    assert {r["asin"]: r["status"] for r in store.read(spark, "bib_fetches").collect()} == {"B0TOME0001": "found", "B0TOME0002": "not_found"}
    assert store.read(spark, "bib_candidates").count() == 1


def test_driver_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(bindings.QUERIES) <= set(queries) and set(sql) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0

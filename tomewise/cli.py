"""Commands over a library store."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tomewise.plans import enrichment, gateway
from tomewise.plans.guard import GuardError
from tomewise.sources import archive, labels, library_json, overrides
from tomewise.sources.search_api import Client
from tomewise.sources.store import Store, StoreLocked

DEFAULT_STORE = "~/.tomewise/library"
log = logging.getLogger("tomewise")


def now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None, microsecond=0)


def session() -> SparkSession:
    return SparkSession.builder.appName("tomewise").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _path(value: str) -> str:
    if not value.strip():
        raise argparse.ArgumentTypeError("must not be empty (is the shell variable holding the path set?)")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tomewise", description="A library's catalogue on Spark.")
    p.add_argument("--db", type=_path, help=f"store folder (default: TOMEWISE_DB or {DEFAULT_STORE})")
    p.add_argument("--labels", type=_path, help="TSV of class labels")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--log-file", type=_path)
    sub = p.add_subparsers(dest="command", required=True)
    for name, told in (("import", "replace the catalogue by a JSON export"), ("import-official", "replace the official tables by a zip")):
        sub.add_parser(name, help=told).add_argument("file", type=_path)
    sub.add_parser("status", help="what the store holds")
    s = sub.add_parser("search", help="books by title, authors, id, status or subject")
    s.add_argument("term")
    for name, most in (("search", 50), ("authors", 50), ("recent", 20)):
        c = s if name == "search" else sub.add_parser(name)
        c.add_argument("-n", "--limit", type=int, default=most, help="rows to show, 0 for all")
    q = sub.add_parser("query", help="one reading SQL statement")
    q.add_argument("sql")
    q.add_argument("-t", "--table", action="store_true")
    q.add_argument("--allow-unlimited", action="store_true")
    e = sub.add_parser("enrich", help="fetch and match books")
    e.add_argument("--where")
    e.add_argument("--retry-missing", action="store_true")
    e.add_argument("--refresh", action="store_true")
    e.add_argument("-n", "--limit", type=int, default=0)
    e.add_argument("--overrides", type=_path)
    sub.add_parser("rematch", help="match stored candidates again")
    f = sub.add_parser("fix", help="serve the correction API on this machine")
    f.add_argument("--port", type=int, default=0)
    f.add_argument("--overrides", type=_path)
    sub.add_parser("delete", help="remove the store").add_argument("-y", "--yes", action="store_true")
    return p


def store_of(given: str | None) -> Store:
    return Store(given or os.environ.get("TOMEWISE_DB") or DEFAULT_STORE)


def _page(say: Callable[[str], None], page, total: int | None, noun: str) -> None:
    rows = [tuple(r) for r in page.collect()]
    say(gateway.as_table(page.columns, rows))
    if total is not None and len(rows) < total:
        say(f"Showing {len(rows)} of {total} {noun}.")


class _LogFile(logging.FileHandler):
    """A log file that tells once if it can't be written, and lets the command go on."""

    def __init__(self, path: str, say: Callable[[str], None]):
        super().__init__(path, encoding="utf-8", delay=True)
        self.say, self.told = say, False
        self.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))

    def emit(self, record: logging.LogRecord) -> None:
        try:
            super().emit(record)
        except OSError:
            self.handleError(record)

    def handleError(self, record: logging.LogRecord) -> None:
        if not self.told:
            self.told = True
            self.say(f"Warning: can't write the log file {self.baseFilename}")


def route_log(verbose: bool, path: str | None, say: Callable[[str], None]) -> None:
    """Records go to standard error, those marked ``file_only`` to the log file alone, which takes all of them."""
    log.setLevel(logging.INFO if verbose or path else logging.WARNING)
    log.propagate = False
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    screen = logging.StreamHandler(sys.stderr)
    screen.setLevel(logging.INFO if verbose else logging.WARNING)
    screen.addFilter(lambda r: not getattr(r, "file_only", False))
    log.addHandler(screen)
    if path:
        log.addHandler(_LogFile(path, say))
    log.info("started", extra={"file_only": True})


def run(argv: list[str], say: Callable[[str], None] = print, client=None, ask: Callable[[str], str] = input) -> int:
    """Run one command. 0 for success, 1 for an error that is told, 130 after an interrupt."""
    a = parser().parse_args(argv)
    route_log(a.verbose, a.log_file, say)
    store = store_of(a.db)
    try:
        return _command(a, store, say, client, ask)
    except KeyboardInterrupt:
        return 130
    except (ValueError, OSError, StoreLocked, GuardError) as e:
        say(f"Error: {e}")
        return 1
    except PySparkException as e:  # an unknown column, a value that can't be cast
        say(f"Error: {str(e).strip().splitlines()[0]}")
        return 1


def _command(a: argparse.Namespace, store: Store, say: Callable[[str], None], client, ask: Callable[[str], str]) -> int:
    if a.command == "delete":
        if not store.exists:
            raise FileNotFoundError(f"No store at {store.root}")
        if a.yes or ask(f"Delete {store.root}? [y/N] ").strip().lower() in ("y", "yes"):
            store.delete()
            say(f"Deleted {store.root}")
        return 0
    spark = session()
    if a.command == "import":
        say(f"Imported {library_json.import_library(spark, store, a.file, now(), lambda w: say(f'Warning: {w}'))} books.")
        return 0
    if a.command == "import-official":
        say("Imported " + ", ".join(f"{k} {v}" for k, v in archive.import_archive(spark, store, a.file, now()).items()))
        return 0
    library = gateway.Library(spark, store, labels.read_labels(spark, a.labels) if a.labels else None)
    if a.command == "status":
        say(gateway.as_table(["Item", "Value"], library.status()))
    elif a.command == "search":
        page, total = library.search(a.term, a.limit)
        _page(say, page, total, "results") if total else say("No results found.")
    elif a.command == "authors":
        _page(say, *library.authors(a.limit), "authors")
    elif a.command == "recent":
        _page(say, library.recent(a.limit), None, "books")
    elif a.command == "query":
        df = library.query(a.sql, a.allow_unlimited)
        if a.table:
            _page(say, df, None, "rows")
        else:
            for line in gateway.json_lines(df):
                say(line)
    elif a.command == "rematch":
        s = enrichment.rematch(spark, store, now())
        say(f"Rematched {s.books} books: {s.changed} changed, {s.lost} without a match.")
    elif a.command == "enrich":
        given = overrides.read_overrides(spark, a.overrides) if a.overrides else None
        s = enrichment.enrich(spark, store, client or Client(), now, a.where, a.retry_missing, a.refresh, a.limit, given, a.overrides or "overrides.csv", labels=library.labels)
        if s.overrides and s.overrides.unknown:
            say(f"Warning: corrections of books that aren't in the library: {', '.join(s.overrides.unknown)}")
        say(f"{s.targets} books: " + ", ".join(f"{k} {v}" for k, v in sorted(s.counts.items())) + (" (more are left)" if s.truncated else ""))
        if s.counts.get("error"):
            say("Warning: some books failed; the next run tries them again.")
        if s.aborted:
            say(f"Stopped: {s.aborted}")
            return 130 if s.aborted == "interrupt" else 1
    elif a.command == "fix":
        from tomewise.server import FixServer

        server = FixServer(spark, store, enrichment.overrides_path(spark, store, Path(a.overrides) if a.overrides else None), client or Client(), a.port, library.labels)
        say(f"Serving http://127.0.0.1:{server.port}/?token={server.token}; Ctrl-C stops.")
        with server:
            server.serve_forever()
    return 0


def main() -> int:
    return run(sys.argv[1:])


if __name__ == "__main__":
    raise SystemExit(main())

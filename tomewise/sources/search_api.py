"""Client of the search service: one request at a time, spaced out, retried when asked to wait. Never distributed."""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from tomewise.sources.records import RecordError, parse_response

#: Address, fixed parameters, results in one response, and the pacing that the service asks for. Fixed values.
ADDRESS, FIXED, MOST, INTERVAL, RETRIES, PATIENCE = "https://ndlsearch.ndl.go.jp/api/opensearch", {"dpid": "iss-ndl-opac", "cnt": "500"}, 500, 3.0, 3, 600.0


class SearchError(Exception):
    """One search failed."""


class RetryLater(Exception):
    """The service asks to wait longer than a run should."""

    def __init__(self, seconds: float):
        super().__init__(f"the search service asked to wait {seconds:.0f} seconds")
        self.seconds = seconds


@dataclass
class Client:
    """``fetch`` takes an address and returns the text, raising ``urllib.error.HTTPError``; clock and sleep can be replaced."""

    fetch: Callable[[str], str] | None = None
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: float | None = None

    def _fetched(self, address: str) -> str:
        if self.fetch is not None:
            return self.fetch(address)
        with urllib.request.urlopen(urllib.request.Request(address, headers={"User-Agent": "tomewise"}), timeout=60) as r:
            return r.read().decode("utf-8")

    @staticmethod
    def _pause(e: urllib.error.HTTPError, attempt: int) -> float:
        """Seconds that a busy service asks for, or our own guess."""
        asked = e.headers.get("Retry-After") if e.headers else None
        return float(asked) if asked and asked.isdigit() else 60.0 * (attempt + 1)

    def search(self, params: dict[str, str]) -> tuple[int, list[str]]:
        """(number of results in all, items)."""
        address = f"{ADDRESS}?{urllib.parse.urlencode({**FIXED, **params})}"
        for attempt in range(RETRIES + 1):
            if self.last is not None and (wait := self.last + INTERVAL - self.clock()) > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                return parse_response(self._fetched(address))
            except urllib.error.HTTPError as e:
                pause = self._pause(e, attempt) if e.code == 429 else None
                if pause is not None and pause > PATIENCE:
                    raise RetryLater(pause) from e
                if pause is None or attempt == RETRIES:
                    raise SearchError(f"HTTP {e.code}") from e
                self.sleep(pause)
            except (OSError, http.client.HTTPException, UnicodeDecodeError, RecordError) as e:
                raise SearchError(f"{type(e).__name__}: {e}") from e
        raise AssertionError("unreachable")

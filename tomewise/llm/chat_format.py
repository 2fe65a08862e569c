"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: ``message`` opens a message of a turn, ``delta`` appends to it, ``edit`` replaces its
text, ``regenerate`` discards its text so that later deltas build it anew. The log is partitioned by conversation and sorted
by (turn, seq); a streaming fold then holds one message at a time, whatever the length of a conversation, and renders each
final message as a segment. A conversation's text is its segments in order of ``place``. Digests over a whole conversation are
sequential by nature, so a conversation is read by one task, in a stream.

Template: ``### role``, newline, text, ``</turn>``, newline. A backslash goes before every backslash, before ``</turn>`` and before
each ``#`` of three or more in a row (in a role also before a newline), so texts can't forge control strings and unescaping is exact.

Defined results: null text is empty, null role is the empty role; null conversation ids are one conversation; a delta, edit
or regenerate whose turn has no message opens one; events that tie on (turn, seq) are taken by kind (message first), role, text; two
``message`` events of one turn are two messages, and later events go to the second; an unknown kind raises ``ValueError``; an
empty log gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewise.llm.common import bounded

KINDS = ("message", "delta", "edit", "regenerate")
_CONTROL = re.compile(r"\\|</turn>|#{3,}")
_TURN = re.compile(r"### ((?:\\.|[^\\\n]++)*+)\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
_ROWS = 2_000


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m.group().replace("#", "\\#") if m.group()[0] == "#" else "\\" + m.group(), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text starts and ends in it."""
    head = "### " + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn starts at character {at}")
        yield unescape(m.group(1)), unescape(m.group(2))
        at = m.end()


def _messages(events: Iterator[tuple]) -> Iterator[tuple]:
    """Fold (conv_id, turn, kind, role, text) events, in order, into (conv_id, turn, role, text) messages."""
    current, pieces = None, []
    for conv, turn, kind, role, text in events:
        if kind not in KINDS:
            raise ValueError(f"unknown event kind {kind!r}")
        same = current is not None and current[:2] == (conv, turn)
        if kind == "message" or not same:
            if current is not None:
                yield *current, "".join(pieces)
            current, pieces = (conv, turn, role), [] if kind == "regenerate" else [text]
        elif kind == "delta":
            pieces.append(text)
        else:
            pieces = [text] if kind == "edit" else []
    if current is not None:
        yield *current, "".join(pieces)


def format_log(log: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Segments (conv_id, turn, place, role, formatted, loss_start, loss_end) of a log (conv_id, turn, seq, kind, role, text).

    Partitions hold whole conversations, in order of (conv_id, place). ``loss_start`` and ``loss_end`` are code points of ``formatted``, null outside the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def events() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        names = ["conv_id", "turn", "place", "role", "formatted", "loss_start", "loss_end"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        rows, place, last, held = [], -1, object(), 0
        for conv, turn, role, text in _messages(events()):
            place, last = (place + 1 if conv == last else 0), conv
            formatted, start, end = render(role, text)
            rows.append((conv, turn, place, role, formatted, *((start, end) if role in loss_roles else (None, None))))
            held += len(formatted)
            if len(rows) >= _ROWS or held > 1 << 22:
                yield flush(rows)
                rows, held = [], 0
        if rows:
            yield flush(rows)

    kind = F.col("kind").cast("string")
    known = bounded(log).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), kind.alias("kind"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("seq").cast("long").alias("seq"))
    ordered = known.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", F.col("kind") != "message", "kind", "role", "text")
    return ordered.select("conv_id", "turn", "kind", "role", "text").mapInArrow(run, "conv_id long, turn long, place long, role string, formatted string, loss_start long, loss_end long")


def log_of_messages(conversations: DataFrame) -> DataFrame:
    """A log in which each row of a table (conv_id, turn, role, text) is a finished message."""
    return conversations.select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def digests(segments: DataFrame) -> DataFrame:
    """Read formatted conversations back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    ``segments`` comes straight from ``format_log``, whose partitions hold whole conversations in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        last, state, done = object(), None, []

        def close() -> None:
            if state:
                done.append((last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end")]
            for conv, formatted, start, end in zip(*columns, strict=True):
                if conv != last:
                    close()
                    last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = unescape(formatted[start:end])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(formatted)
            if len(done) >= _ROWS:
                yield out()
                done = []
        close()
        if done:
            yield out()

    return segments.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

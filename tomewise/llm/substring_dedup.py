"""Substring deduplication by content-defined units.

Of each ``WINDOW`` neighbouring places of a text the one with the smallest gear hash of the 16 bytes from there (the first of equal
ones, never inside a character) is an anchor, and the ``UNIT`` bytes from an anchor are a unit. Anchors depend on nearby content
alone and no stretch is without one, periodic text included, so texts that share ``UNIT + WINDOW - 1`` = 101 bytes, the least that
51 words take, share a unit whole. Units are compared by a 64-bit digest; a digest in several documents is a repeat, and stays in
the document with the smallest id. Two different units with one digest are no passage by themselves: a unit alone is short, and its
windows, hashed anew, would have to agree as well. Overlapping units join into passages.

A joined passage of under ``2 * least`` bytes is then held against the text: all windows of ``least`` bytes, from ``WINDOW``
bytes before its units on, that begin with a word are compared likewise, and those that other documents have take its place. So a
short passage counts if, and as far as, ``least`` bytes in one piece repeat from the start of a word. A longer one is reported from its first to its last unit, up to ``WINDOW - 1`` bytes
short at either end; each of its bytes lies in a unit that repeats in one piece.

Only fixed-size rows (digest, id, place) travel, and the texts of documents once, to meet their short passages. Digests are combined
before the shuffle (minimum and maximum id), and the join that marks the units of repeats salts frequent ones.

Defined results: null text counts as empty and has no units; repeats inside one document only are none; rows that repeat an id
count once; rows with null id are ignored (``remove_repeats`` keeps them as they are); of equal whole texts the one with the
smallest id keeps its passages; an empty table gives an empty result; extra columns are kept by ``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewise.llm.common import WORD_BYTE, fresh, id_text, join_salted, materialize, mixed, slices, utf8

#: Mean and largest chunk, and the shortest passage that counts, in bytes.
MEAN, LONGEST, LEAST = 28, 2048, 90
#: Bytes of a unit, places of which one is an anchor, and bytes of the hash that chooses it.
UNIT, WINDOW, GRAM = 62, 40, 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
_GEAR = (mixed(np.arange(1001, 1257, dtype=np.uint64) * _STEP) >> np.uint64(24)).astype(np.uint16)
_POWERS = np.cumprod(np.full(LONGEST, _STEP, np.uint64))
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def gear(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte, ``h = (h << 1) + GEAR[byte]`` modulo 2**16 from each text's start, by doubling the window four times."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        before = np.zeros_like(h)
        before[width:] = h[:-width]
        for k in range(width):
            at = starts + k
            before[at[at < len(h)]] = 0
        h = h + (before << np.uint16(width))
    return h


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in the text, size, digest) of each chunk of texts cut where the gear hash is small; passages are found by units instead."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sizes = np.diff(offsets)
    starts = offsets[:-1][sizes > 0]
    ends = gear(data, starts) < np.uint16(65536 // MEAN)
    ends[:-1] &= (data[1:] & 0xC0) != 0x80
    ends[starts[1:] - 1] = True
    ends[-1] = True
    stops = np.flatnonzero(ends) + 1
    begins = np.concatenate([[0], stops[:-1]])
    long = np.flatnonzero(stops - begins > LONGEST)
    if len(long):  # cut what has no cut of its own, from its start, between characters
        more = []
        for i in long:
            at = begins[i] + LONGEST
            while at < stops[i]:
                while (data[at] & 0xC0) == 0x80:
                    at -= 1
                more.append(at)
                at += LONGEST
        stops = np.union1d(stops, more)
        begins = np.concatenate([[0], stops[:-1]])
    size = stops - begins
    place = np.arange(len(data)) - np.repeat(begins, size)
    digest = mixed(np.add.reduceat(_CODE[data] * _POWERS[place], begins) + size.astype(np.uint64))
    text = np.searchsorted(offsets, begins, side="right") - 1
    return text, begins - offsets[text], size, digest


def digests(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A digest of the content of each range of bytes, from prefix sums."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[data] * np.cumprod(np.full(len(data), _STEP, np.uint64)), dtype=np.uint64)])
    back = np.cumprod(np.full(len(data), _BACK, np.uint64))
    return mixed((total[stops] - total[starts]) * back[starts] + (stops - starts).astype(np.uint64))


def _inside(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a cut at a place, at most its text's end, would split a character."""
    return (at < ends) & ((data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80)


def _joined(text: np.ndarray, start: np.ndarray, stop: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours that overlap and are equal (periodic text) as one range."""
    new = np.ones(len(text), bool)
    new[1:] = (digest[1:] != digest[:-1]) | (text[1:] != text[:-1]) | (start[1:] > stop[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text)) - 1
    return text[first], start[first], stop[last], digest[first]


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start and stop in the text, digest) of each unit, those of periodic stretches joined."""
    none = np.zeros(0, np.int64)
    if len(data) < UNIT:
        return none, none, none, none.astype(np.uint64)
    sizes, at = np.diff(offsets), np.arange(len(data))
    ends = np.repeat(offsets[1:], sizes)
    key = np.full(len(data), 1 << 16, np.uint64)
    key[: 1 - GRAM] = gear(data, offsets[:-1][sizes > 0])[GRAM - 1 :]
    key[((data & 0xC0) == 0x80) | (at + GRAM > ends)] = 1 << 16
    least = key << np.uint64(32) | at.astype(np.uint64)
    seen = 1
    while seen < WINDOW:
        step = min(seen, WINDOW - seen)
        least = np.minimum(least[:-step], least[step:])
        seen += step
    start = (least[at[: len(least)] + WINDOW <= ends[: len(least)]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = start[np.diff(start, prepend=-1) != 0]
    start = start[(start + UNIT <= ends[start]) & (key[start] < 1 << 16)]
    stop = start + UNIT
    for _ in range(3):
        stop = stop - _inside(data, stop, ends[start])
    text = np.searchsorted(offsets, start, side="right") - 1
    text, start, stop, digest = _joined(text, start, stop, digests(data, start, stop))
    return text, start - offsets[text], stop - offsets[text], digest


def windows(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, start: np.ndarray, stop: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like ``units``: the windows of ``size`` bytes (more where a character would be split) that begin with a word near the units given."""
    low, high = np.maximum(offsets[text], offsets[text] + start - WINDOW), offsets[text] + stop - UNIT + 4
    n = np.maximum(0, high - low)
    first = np.unique(np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    text = np.searchsorted(offsets, first, side="right") - 1
    ends = offsets[text + 1]
    last = first + size
    for _ in range(3):
        last = last + _inside(data, last, ends)
    word = WORD_BYTE[data] > 0
    ok = (last <= ends) & word[first] & ((first == offsets[text]) | ~word[first - 1])
    text, first, last = text[ok], first[ok], last[ok]
    text, first, last, digest = _joined(text, first, last, digests(data, first, last))
    return text, first - offsets[text], last - offsets[text], digest


_ROWS = "doc_id long, start int, stop int, digest long"


def _rows(ids: pa.Array, text: np.ndarray, start: np.ndarray, stop: np.ndarray, digest: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(text)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(digest.view(np.int64))], ["doc_id", "start", "stop", "digest"])


def unit_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, stop and digest of each unit of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _rows(part.column("doc_id"), *units(*utf8(part.column("text"))))

    return id_text(df, id_col, text_col).where("doc_id is not null").mapInArrow(run, _ROWS)


def _window_rows(df: DataFrame, passages: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """The same of all windows of ``size`` bytes of passages (doc_id, start, stop)."""
    per_doc = passages.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    texts = id_text(df, id_col, text_col)
    joined = texts.join(per_doc, texts.doc_id == per_doc.of).select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                spans = [(k, s["start"], s["stop"]) for k, of in enumerate(part.column("spans").to_pylist()) for s in of if s["stop"] <= offsets[k + 1] - offsets[k]]
                # A repeated id may bring spans of another text; what is compared are contents, so they do no harm.
                text, start, stop = np.array(spans, np.int64).reshape(-1, 3).T
                yield _rows(part.column("doc_id"), *windows(data, offsets, text, start, stop, size))

    return joined.mapInArrow(run, _ROWS)


def _repeated(rows: DataFrame, kind: str) -> DataFrame:
    """doc_id, start, stop and keep_id of the rows whose digest other documents have too."""
    repeats = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n")).where("keep_id < last_id")
    return join_salted(rows, materialize(repeats.select("digest", "keep_id", "n"), kind), ["digest"], "n").select("doc_id", "start", "stop", "digest", "keep_id")


def _runs(found: DataFrame, *also: str) -> DataFrame:
    """Ranges (doc_id, start, stop, keep_id), one row for each, with the number of the run of overlapping ones that they are in."""
    one = found.repartition("doc_id").groupBy("doc_id", "start", "stop", *also).agg(F.min("keep_id").alias("keep_id"))
    order = Window.partitionBy("doc_id").orderBy("start", "stop")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    removable = F.max(F.when(F.col("keep_id") < F.col("doc_id"), F.col("stop"))).over(before)
    fresh_bytes = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(removable, F.lit(0))))
    return one.select(
        "*", F.coalesce(F.col("start") > F.max("stop").over(before), F.lit(True)).cast("long").alias("new"), F.when(F.col("keep_id") < F.col("doc_id"), fresh_bytes).otherwise(0).alias("removable")
    ).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _passages(found: DataFrame, least: int) -> DataFrame:
    """Overlapping ranges (doc_id, start, stop, keep_id) joined into passages of at least ``least`` bytes."""
    return (
        _runs(found).groupBy("doc_id", "run")
        .agg(F.min("start").cast("long").alias("start"), F.max("stop").cast("long").alias("stop"), F.sum("removable").alias("removable_bytes"), F.min("keep_id").alias("keep_id"))
        .where(F.col("stop") - F.col("start") >= least)
        .select("doc_id", "start", "stop", "removable_bytes", "keep_id")
    )


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, start, stop and keep_id of what other documents have too: units of long passages, windows of ``least`` bytes of short ones."""
    found = _repeated(unit_rows(df, id_col, text_col), "repeats")
    whole = Window.partitionBy("doc_id", "run")
    size = F.max("stop").over(whole) - F.min("start").over(whole)
    placed = materialize(_runs(found, "digest").select("doc_id", "start", "stop", "digest", "keep_id", (size >= 2 * least).alias("long")), "placed")
    # A short passage is compared with all places of its units, long passages included.
    short = placed.where("not long").select("digest").distinct()
    own = _repeated(_window_rows(df, placed.join(short, "digest", "left_semi").select("doc_id", "start", "stop"), least, id_col, text_col), "windows")
    return placed.where("long").select("doc_id", "start", "stop", "keep_id").unionByName(own.select("doc_id", "start", "stop", "keep_id"))


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Passages that repeat across documents: doc_id, start, stop (bytes of the text in UTF-8), removable_bytes, keep_id.

    ``keep_id`` is the smallest id of a document that keeps a part of the passage, ``removable_bytes`` what other documents keep."""
    return _passages(repeats(df, id_col, text_col, least), least)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``df`` with those passages cut out of ``text_col`` all of whose units other documents with smaller ids keep."""
    spans, key = fresh(df, "spans"), fresh(df, "span_id")
    passages = _passages(repeats(df, id_col, text_col, least).where("keep_id < doc_id"), least)
    per_doc = passages.groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(spans))
    place, index = df.columns.index(text_col), len(df.columns)

    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = batch.column(place).cast(pa.string()).to_pylist(), batch.column(index).to_pylist()
            for i, c in enumerate(cuts):
                if c:
                    raw, at, kept = texts[i].encode(), 0, []
                    for s in c:
                        kept.append(raw[at : s["start"]])
                        at = s["stop"]
                    texts[i] = b"".join([*kept, raw[at:]]).decode()
            columns = [*batch.columns[:place], pa.array(texts, pa.string()), *batch.columns[place + 1 : index]]
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = df.join(per_doc, df[id_col].cast("long") == per_doc[key], "left").drop(key)
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType, True) for f in df.schema.fields])
    return joined.mapInArrow(run, schema)

"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and items become words: bytes lower-cased (A-Z only), cut at ASCII characters that are neither letter nor digit. Each
run of ``WINDOW`` words of an item is a pattern; an item of fewer words, but not none, is one pattern. The automaton's letters are words,
numbered as the benchmark has them, so it has a node for a word of a pattern rather than for a byte. Every text is scanned once in its
normalised form; a match is a run of word numbers, mapped back to character offsets of the original text.

The benchmark's size is checked before it is collected, and its patterns' before they are broadcast; a Python worker builds the
automaton once and keeps it for its next tasks. A benchmark of more than ``NODES`` nodes (about 400,000 windows) is scanned in several
passes, each by the automaton of one part, written in between, so a worker holds one automaton at a time and no item is dropped.

Defined results: null text or item has no words; an item without words never matches; of repeated item ids all windows count
for the one id; items with null id count as one item, which isn't listed; items with equal windows are all reported; repeated rows give repeated results; an empty documents table
gives an empty result, an empty benchmark gives no hits; extra columns are kept by ``keep_clean`` and ignored by ``scan``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewise.llm.common import WORD_BYTE, bounded, id_text, materialize, slices, word_spans

WINDOW = 10
#: Nodes of an automaton at most (about 60 bytes each), and bytes of a benchmark that may be collected.
NODES, BENCHMARK_BYTES = 4_000_000, 256 << 20
_TO_WORDS = bytes(int(b) or 32 for b in WORD_BYTE)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


Part = list[tuple[str | None, bytes]]


def parts(items: list[tuple[str | None, str]], size: int = WINDOW, nodes: int | None = None) -> Iterator[Part]:
    """Items (None for those without id) with their words joined by spaces, in parts whose patterns have ``nodes`` words at most.

    An item of more patterns than that is cut into pieces that overlap by ``size - 1`` words."""
    nodes = nodes or NODES
    part, held, step = [], 0, max(1, nodes // size)
    for item, text in sorted(items, key=lambda x: (x[0] is not None, x)):
        words = words_of(text.encode())
        for k in range(0, max(1, len(words) - size + 1) if words else 0, step):
            piece = words[k : k + step + size - 1]
            cost = max(1, len(piece) - size + 1) * min(size, len(piece))
            if part and held + cost > nodes:
                yield part
                part, held = [], 0
            part.append((item, b" ".join(piece)))
            held += cost
    if part:
        yield part


class Scanner:
    """The automaton of one part of a benchmark."""

    def __init__(self, part: Part, size: int = WINDOW):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.number: dict[bytes, int] = {}
        self.sizes: list[int] = []
        self.owners: list[list[str | None]] = []
        for item, joined in part:
            words = tuple(self.number.setdefault(w, len(self.number) + 1) for w in joined.split(b" "))
            n = min(size, len(words))
            for k in range(len(words) - n + 1):
                key = words[k : k + n]
                at = self.automaton.get(key, -1)
                if at < 0:
                    self.automaton.add_word(key, len(self.sizes))
                    self.sizes.append(n)
                    self.owners.append([item])
                elif self.owners[at][-1] != item:
                    self.owners[at].append(item)
        if part:
            self.automaton.make_automaton()
            self.stretches = re.compile(rb"\x01{%d,}" % min(self.sizes))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Runs of words (first, one past the last) inside matches, and the items that match.

        A word that no pattern has takes the automaton back to its root, so only stretches of known words are given to it, and of these
        only such as could hold the shortest pattern."""
        if not self.sizes:
            return [], set()
        look, sizes = self.number.get, self.sizes
        numbers = [look(w, 0) for w in words]
        runs, found = [], set()
        for stretch in self.stretches.finditer(bytes(map(bool, numbers))):
            first = stretch.start()
            for end, at in self.automaton.iter(tuple(numbers[first : stretch.end()])):
                end += first + 1
                runs.append((end - sizes[at], end))
                found.add(at)
        return merged(runs), {i for at in found for i in self.owners[at]}


_HELD: dict[str, Scanner] = {}


def _scanner(name: str, part: Part, size: int) -> Scanner:
    """The scanner of that name, built at its first use in this Python worker; the one before goes."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Scanner(part, size)
    return _HELD[name]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of runs, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def char_spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Character offsets in the original text of runs of words."""
    if not runs:
        return []
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(data, np.array([0, len(data)]))
    before = np.cumsum((data & 0xC0) != 0x80)  # characters begun up to each byte
    return [{"start": int(before[starts[a]]) - 1, "end": int(before[ends[b - 1] - 1])} for a, b in runs]


def collect_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> list[tuple[str | None, str]]:
    """The test set; one of more than ``BENCHMARK_BYTES`` raises ``ValueError`` before anything is collected."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    if size > BENCHMARK_BYTES:
        raise ValueError(f"a benchmark of {size} bytes can't be held by the driver (at most {BENCHMARK_BYTES}); scan against parts of it")
    return [(r["item"], r["text"]) for r in rows.collect()]


_FOUND = "n_words long, runs array<struct<first:int,last:int>>, items array<string>"


def _scanned(rows: DataFrame, text_col: str, benchmark: DataFrame, window: int) -> DataFrame:
    """``rows`` (whose text is never null) with n_words, runs and items."""
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in rows.schema.fields), *T._parse_datatype_string(_FOUND).fields])
    context = rows.sparkSession.sparkContext
    for k, part in enumerate(list(parts(collect_items(benchmark), window)) or [[]]):
        shared, name = context.broadcast(part), uuid.uuid4().hex  # at most NODES words

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name, later=k > 0) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(name, shared.value, window)
            for batch in batches:
                for part in slices(batch, text_col):
                    own = part.select(part.schema.names[:-3]) if later else part
                    so_far = zip(part.column("runs").to_pylist(), part.column("items").to_pylist(), strict=True) if later else (((), ()) for _ in range(part.num_rows))
                    n_words, all_runs, all_items = [], [], []
                    for text, (runs, items) in zip(part.column(text_col).cast(pa.binary()).to_pylist(), so_far, strict=True):
                        words = words_of(text)
                        new, more = scanner.hits(words)
                        n_words.append(len(words))
                        all_runs.append([{"first": a, "last": b} for a, b in merged([*((r["first"], r["last"]) for r in runs), *new])])
                        all_items.append(sorted({*items, *more}, key=lambda x: (x is not None, x or "")))
                    found = [pa.array(n_words, pa.int64()), pa.array(all_runs, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(all_items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*own.columns, *found], [*own.schema.names, "n_words", "runs", "items"])

        rows = (materialize(rows, "pass") if k else rows).mapInArrow(run, schema)
    return rows


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted ids) and spans (character offsets) of each row."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            runs, found = part.column("runs").to_pylist(), part.column("items").to_pylist()
            items = [[i for i in ids if i is not None] for ids in found]
            # Only the texts of rows with hits are looked at.
            spans = [char_spans(part.column("text")[i].as_py().encode(), [(r["first"], r["last"]) for r in rs]) if rs else [] for i, rs in enumerate(runs)]
            n_hit = [sum(r["last"] - r["first"] for r in rs) for rs in runs]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(hashlib.sha256(",".join(x).encode()).hexdigest() for x in items),
                 pa.array([n > 0 for n in n_hit], pa.bool_()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
            )

    found = _scanned(id_text(docs, id_col, text_col), "text", benchmark, window)
    return found.mapInArrow(finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:long,end:long>>")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows without a match, with all their columns."""
    # Own names for all columns, so that none clashes with what the scan adds.
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    read = bounded(docs).select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text_read"))
    found = _scanned(read, "text_read", benchmark, window)
    return found.where(F.size("runs") == 0).select(*(F.col(n).alias(c) for c, n in names.items()))

"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of order 0 to 3. A byte seen in the longest context that the tree has costs
-log2(count / (total + distinct)); otherwise an escape of probability distinct / (total + distinct) leads to the next
shorter context, whose distribution is renormalised over the bytes not yet excluded, down to a uniform one over all 256. With frozen
statistics all costs can be worked out once. They are kept for what was seen only: hash tables hold the cost of each byte after
each context that some language has, and the cost of the escape from each such context, for all languages side by side. A text's code
length per language is a few look-ups a byte; the shortest code wins. No byte value and no context is left out or merged with others.

Fitting takes at most ``PER_LANGUAGE`` documents of each language (those with the smallest hash of their id, a bounded
sample), whole texts; their 4-grams are counted on the executors. A model holds one number for each language and each string of up to four bytes
that was seen; one of more than ``CELLS`` numbers raises ``ValueError`` (learn from fewer documents or bytes, or in groups of languages), since
it is broadcast. Nothing is cut to fit.

Defined results: null text, empty text and text without a letter give ``und`` with score 0; so does every text if there is
nothing to learn from; of equal code lengths the first language by name wins; repeated rows give repeated results; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomewise.llm.common import id_text, mixed, slices, utf8

#: Bounds of the model: documents learned from for each language, and numbers in its tables.
PER_LANGUAGE, CELLS = 500, 1 << 26
#: Bytes of text that count as full evidence in a score.
EVIDENCE, ORDER = 32, 3


class Table:
    """A hash table from 32-bit codes to their places in the array that it was made of, looked up for whole arrays at once."""

    def __init__(self, codes: np.ndarray):
        self.mask = (1 << max(4, int(4 * len(codes)).bit_length())) - 1
        self.code, self.place = np.zeros(self.mask + 1, np.uint32), np.full(self.mask + 1, -1, np.int32)
        left, slot = np.arange(len(codes)), self._slots(codes)
        while len(left):
            free = self.place[slot] < 0
            _, one = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[one]
            self.code[slot[chosen]], self.place[slot[chosen]] = codes[left[chosen]], left[chosen]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, slot = left[rest], slot[rest] + 1 & self.mask

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return (mixed(codes.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Places of codes, -1 for those that aren't there."""
        out, slot = np.full(len(codes), -1, np.int32), self._slots(codes)
        left = np.arange(len(codes))
        while len(left):
            place = self.place[slot]
            hit = (place >= 0) & (self.code[slot] == codes[left])
            out[left[hit]] = place[hit]
            on = ~hit & (place >= 0)
            left, slot = left[on], slot[on] + 1 & self.mask
        return out


@dataclass
class ContextTrees:
    """``zero``: bits [byte, language] without context. For each order from 1: strings of a context and a byte with their bits, and contexts with the bits of their escapes."""

    languages: list[str]
    zero: np.ndarray
    strings: list[Table]
    bits: list[np.ndarray]
    contexts: list[Table]
    escapes: list[np.ndarray]


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def _shifted(s: np.ndarray, starts: np.ndarray, by: int) -> np.ndarray:
    """For each byte the one ``by`` places before it in the same text, else 0."""
    out = np.zeros_like(s)
    out[by:] = s[:-by]
    for k in range(by):
        at = starts + k
        out[at[at < len(s)]] = 0
    return out


def _starts(offsets: np.ndarray) -> np.ndarray:
    return offsets[:-1][offsets[1:] > offsets[:-1]]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            own = batch.filter(pa.array([x == lang for x in langs]))
            for part in slices(own):
                data, offsets = utf8(part.column("text"))
                starts = _starts(offsets)
                wide = data.astype(np.uint32)
                # Short texts could make a shifted byte reach over two borders; each border is cleared for every distance.
                grams = _shifted(wide, starts, 3) << 24 | _shifted(wide, starts, 2) << 16 | _shifted(wide, starts, 1) << 8 | wide
                codes, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> ContextTrees | None:
    """Learn from the rows of ``df`` with a language; None if there are none."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null and doc_id is not null")
    # A draw by hash first leaves somewhat more rows of each language than are wanted, so that no task orders all rows of a frequent one.
    drawn = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash"))
    share = F.pmod("hash", F.lit(1 << 40)) < F.lit((per_language + 10 * per_language**0.5 + 20) * (1 << 40)) / F.col("of")
    drawn = drawn.join(F.broadcast(drawn.groupBy("lang").agg(F.count("*").alias("of"))), "lang").where(share)
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    chosen = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language).select("doc_id", "lang").distinct()
    ids = [tuple(r) for r in chosen.collect()]  # at most per_language for each language
    if not ids:
        return None
    sample = rows.join(F.broadcast(df.sparkSession.createDataFrame(ids, "doc_id long, lang string")), ["doc_id", "lang"], "left_semi")
    counts = sample.select("lang", "text").mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    return trees(sorted({lang for _, lang in ids}), counts.column("lang").to_pylist(), counts.column("gram").to_numpy(), counts.column("n").to_numpy())


def trees(languages: list[str], lang: list[str], grams: np.ndarray, n: np.ndarray, cells: int | None = None) -> ContextTrees | None:
    """Cost tables from counts of 4-grams (three bytes of context, then the byte itself)."""
    if not len(grams):
        return None
    number, count = {x: i for i, x in enumerate(languages)}, len(languages)
    of, grams = np.array([number[x] for x in lang]), grams.astype(np.int64)
    strings = [np.unique(grams & (1 << 8 * (k + 1)) - 1) for k in range(1, ORDER + 1)]
    if (size := 2 * sum(map(len, strings)) * count) > (cells or CELLS):
        raise ValueError(f"{size} numbers are too many for one model of {count} languages; learn from less, or in groups of languages")

    def counts(codes: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount(codes * count + of, weights=n, minlength=rows * count).reshape(rows, count)

    def step(seen: np.ndarray, context: np.ndarray, rows: int, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of strings, given their counts, the number of their context, and those of the strings without their first byte; factors of escapes."""
        total, distinct, mass = (np.zeros((rows, count)) for _ in range(3))
        np.add.at(total, context, seen)
        np.add.at(distinct, context, seen > 0)
        np.add.at(mass, context, np.where(seen > 0, shorter, 0))
        rest = np.maximum(1 - mass, 0)
        all_seen = rest < 1e-12  # nothing to escape to
        escape = np.where(all_seen, 0, distinct / np.maximum(total + distinct, 1))
        factor = np.where(total > 0, escape / np.maximum(rest, 1e-12), 1.0)
        known = seen / np.maximum(total, 1)[context] * (1 - escape)[context]
        return np.where(seen > 0, known, factor[context] * shorter), factor

    zero, _ = step(counts(grams & 255, 256), np.zeros(256, np.int64), 1, np.full((256, count), 1 / 256))
    bits = lambda p: -np.log2(np.maximum(p, 1e-30)).astype(np.float32)
    tables, costs, contexts, escapes, shorter, known = [], [], [], [], zero, np.arange(256)
    for k, keys in enumerate(strings, 1):
        befores, context = np.unique(keys >> 8, return_inverse=True)
        tail = shorter[np.searchsorted(known, keys & (1 << 8 * k) - 1)]
        shorter, factor = step(counts(np.searchsorted(keys, grams & (1 << 8 * (k + 1)) - 1), len(keys)), context, len(befores), tail)
        known = keys
        tables.append(Table(keys.astype(np.uint32)))
        costs.append(bits(shorter))
        contexts.append(Table(befores.astype(np.uint32)))
        escapes.append(bits(factor))
    return ContextTrees(languages, bits(zero), tables, costs, contexts, escapes)


def _bits(model: ContextTrees, grams: np.ndarray) -> np.ndarray:
    """Bits [place, language] of the last byte of each 4-gram after the others."""
    out = np.zeros((len(grams), len(model.languages)), np.float32)
    left = np.arange(len(grams))
    for k in range(ORDER, 0, -1):
        own = grams[left] if k == ORDER else grams[left] & np.uint32((1 << 8 * (k + 1)) - 1)
        place = model.strings[k - 1].find(own)
        hit = place >= 0
        if k == ORDER:
            out[hit] = model.bits[k - 1][place[hit]]
        else:
            out[left[hit]] += model.bits[k - 1][place[hit]]
        left, own = left[~hit], own[~hit]
        context = model.contexts[k - 1].find(own >> np.uint32(8))
        there = context >= 0
        out[left[there]] += model.escapes[k - 1][context[there]]
    out[left] += model.zero[grams[left] & np.uint32(255)]
    return out


def code_lengths(model: ContextTrees, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text under each language, [text, language]."""
    langs = len(model.languages)
    out = np.zeros((len(offsets) - 1, langs))
    step = max(1 << 14, (1 << 21) // langs)
    starts = _starts(offsets)
    for low in range(0, len(data), step):
        high, lead = min(len(data), low + step), min(low, ORDER)
        s = data[low - lead : high].astype(np.uint32)
        near = starts[(starts > low - lead - ORDER) & (starts < high)] - (low - lead)
        near = near[near >= 0]
        grams = (_shifted(s, near, 3) << 24 | _shifted(s, near, 2) << 16 | _shifted(s, near, 1) << 8 | s)[lead:]
        bits = _bits(model, grams)
        first, last = np.searchsorted(offsets, low, side="right") - 1, np.searchsorted(offsets, high, side="left")
        edges = np.clip(offsets[first:last], low, high) - low
        full = np.flatnonzero(np.diff(np.append(edges, high - low)) > 0)
        out[first + full] += np.add.reduceat(bits, edges[full], axis=0, dtype=np.float64)
    return out


def _letters(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = data | 0x20
    at = np.flatnonzero((low >= 97) & (low <= 122))
    has = np.searchsorted(at, offsets[1:]) > np.searchsorted(at, offsets[:-1])
    for i in np.flatnonzero(~has & (offsets[1:] > offsets[:-1])):
        has[i] = any(map(str.isalpha, part.column("text")[int(i)].as_py()))
    return has


def predict(df: DataFrame, model: ContextTrees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most CELLS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                names, scores = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if model is not None:
                    data, offsets = utf8(part.column("text"))
                    bits, has = code_lengths(model, data, offsets), _letters(part, data, offsets)
                    best = bits.argmin(1)
                    size = np.maximum(np.diff(offsets), 1)[:, None]
                    weight = np.exp2((bits.min(1, keepdims=True) - bits) * np.minimum(1, EVIDENCE / size))
                    scores = np.where(has, 1 / weight.sum(1), 0.0)
                    names = [model.languages[b] if h else "und" for b, h in zip(best, has, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")

"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after another (later one pair after another), each time fitting a tree of at most four
leaves to the current residuals of the logistic loss and adding a fraction of it to that feature's lookup table. Scoring
bins the features and adds table entries: one per feature and one per pair.

Features are counts over the whole text: shares of byte classes, of repeated words, word pairs and lines, and the length of sentences. Fitting takes at most ``FIT_ROWS`` labelled rows (those with the smallest
hash of their id), collected as feature vectors, never as text.

Defined results: null text counts as empty; an empty text has all-zero features and a score like any other; rows without a
label aren't learned from; of several labels of one id the largest counts; with no label, or labels of one kind, the score
is their share (0.5 if there is none) for every text; repeated rows give repeated results; an empty table gives an empty
result; extra columns are kept by ``keep_good`` and ignored by ``scores``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewise.llm.common import bounded, fresh, id_text, mixed, slices, utf8, word_hashes, word_spans

#: Labelled rows that a model is fitted on, at most.
FIT_ROWS = 20_000
BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 6, 120, 60, 0.15

_ODD = np.uint64(0x9E3779B97F4A7C15)

#: Byte classes; every byte is in one. What isn't listed is "other".
CLASSES = ["upper", "lower", "digit", "space", "newline", "stop", "bang", "bar", "symbol", "high", "other"]
_CLASS = np.full(256, CLASSES.index("other"), np.int64)
for _name, _bytes in {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": b" \t", "newline": b"\r\n", "stop": b".,;:?'\"()-",
    "bang": b"!", "bar": b"|", "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "high": range(128, 256),
}.items():
    _CLASS[list(_bytes)] = CLASSES.index(_name)
FEATURES = ["log_bytes", "upper_share", "digits", "spaces", "newlines", "stops", "bangs", "bars", "symbols", "high_bytes", "word_bytes", "distinct_shares", "echoes", "distinct_words", "distinct_pairs", "repeated_lines", "sentence_words"]


def _distinct(of: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Share of different codes among those of each text; 1 for a text without any."""
    order = np.lexsort((codes, of))
    of, codes = of[order], codes[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (codes[1:] != codes[:-1])
    count = np.bincount(of, minlength=n)
    return np.where(count > 0, np.bincount(of[new], minlength=n) / np.maximum(count, 1), 1.0)


def features(column: pa.Array) -> np.ndarray:
    """[text, feature] of a string column."""
    data, offsets = utf8(column)
    n, k, sizes = len(column), len(CLASSES), np.diff(offsets)
    kind = _CLASS[data]
    row = np.repeat(np.arange(n), sizes)
    count = np.bincount(row * k + kind, minlength=n * k).reshape(n, k).astype(float)
    of = dict(zip(CLASSES, count.T, strict=True))
    starts, ends = word_spans(data, offsets)
    of_word, hashes = row[starts], word_hashes(data, starts, ends)
    words = np.bincount(of_word, minlength=n)
    # Words that repeat the one before.
    echoes = np.bincount(of_word[1:][(hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])], minlength=n) if len(starts) else np.zeros(n)
    follows = of_word[1:] == of_word[:-1]
    pairs = mixed(hashes[:-1] * _ODD + hashes[1:])[follows] if len(starts) else hashes
    # Lines by the words that they have, in order; those without a word aren't counted.
    line = np.searchsorted(np.flatnonzero(kind == CLASSES.index("newline")), starts)
    first = np.flatnonzero(np.diff(line, prepend=-1) | np.diff(of_word, prepend=-1))
    place = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts)))) + 1
    lines = np.add.reduceat(mixed(hashes + place.astype(np.uint64) * _ODD), first) if len(first) else hashes
    ends_of = np.bincount(row[(data == 46) | (data == 33) | (data == 63)], minlength=n)  # . ! ?
    size, share = np.maximum(sizes, 1), count / np.maximum(sizes, 1)[:, None]
    return np.stack(
        [np.log1p(sizes), of["upper"] / np.maximum(of["upper"] + of["lower"], 1), of["digit"] / size, of["space"] / size, of["newline"] / size, of["stop"] / size,
         of["bang"] / size, of["bar"] / size, of["symbol"] / size, of["high"] / size, (of["upper"] + of["lower"] + of["digit"] + of["high"]) / np.maximum(words, 1), (share**2).sum(1),
         echoes / np.maximum(words, 1), _distinct(of_word, hashes, n), _distinct(of_word[1:][follows], pairs, n), 1 - _distinct(of_word[first], lines, n), words / (ends_of + 1)], 1,
    )


@dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, total = self.bins(x), np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best cut of a run of bins by gain of squared gradient over curvature: (gain, bins to the left)."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of at most four leaves over one feature's bins, as a value for each bin."""
    leaves = [(0, len(g))]
    for _ in range(3):
        cuts = [(*_cut(g[a:b], h[a:b]), a, b) for a, b in leaves]
        gain, at, a, b = max(cuts)
        if gain <= 1e-9:
            break
        leaves.remove((a, b))
        leaves += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut of the first feature and one of the second on either side, the best of all such trees: (gain, value for each cell)."""
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    total_g, total_h = g.cumsum(0), h.cumsum(0)
    sides = [(total_g[:-1], total_h[:-1]), (total_g[-1] - total_g[:-1], total_h[-1] - total_h[:-1])]
    gains, cuts = 0.0, []
    for side_g, side_h in sides:  # [cut of the first feature, bin of the second]
        left_g, left_h = side_g.cumsum(1), side_h.cumsum(1)
        rest_g, rest_h = left_g[:, -1:] - left_g[:, :-1], left_h[:, -1:] - left_h[:, :-1]
        gain = left_g[:, :-1] ** 2 / (left_h[:, :-1] + 1) + rest_g**2 / (rest_h + 1)
        cuts.append(gain.argmax(1) + 1)
        gains = gains + gain.max(1)
    at = int(gains.argmax())
    out = np.zeros(g.shape)
    for rows, cut in ((slice(0, at + 1), cuts[0][at]), (slice(at + 1, len(g)), cuts[1][at])):
        for cols in (slice(0, cut), slice(cut, g.shape[1])):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1)
    return float(gains[at]) - g.sum() ** 2 / (h.sum() + 1), out


def fit_features(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fit to feature vectors and 0/1 labels."""
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        return AdditiveModel(float(np.log(max(p, 1e-6) / max(1 - p, 1e-6))))
    model = AdditiveModel(float(np.log(y.mean() / (1 - y.mean()))))
    model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    b = model.bins(x)
    size = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in size]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, s in enumerate(size):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[:, j], weights=g, minlength=s), np.bincount(b[:, j], weights=h, minlength=s))
            model.tables[j] += step
            total += step[b[:, j]]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        at = b[:, i] * size[j] + b[:, j]
        return tuple(np.bincount(at, weights=v, minlength=size[i] * size[j]).reshape(size[i], size[j]) for v in (g, h))

    gains = {(i, j): _pair_tree(*cells(i, j))[0] for i, j in combinations(range(len(size)), 2)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pair_tables = [np.zeros((size[i], size[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for t, (i, j) in zip(model.pair_tables, model.pairs, strict=True):
            step = RATE * _pair_tree(*cells(i, j))[1]
            t += step
            total += step[b[:, i], b[:, j]]
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x = features(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def learnable(id_col: str = "doc_id"):
    """Rows that may be learned from: crc32 of the id as text, modulo 3, isn't 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> AdditiveModel:
    """Fit to the labelled rows of ``docs`` that may be learned from."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(learnable("doc_id") & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").mapInArrow(_feature_rows, "doc_id long, label int, x array<double>")
    # Repeated documents are learned from once.
    got = sorted(rows.dropDuplicates(["doc_id"]).collect(), key=lambda r: r["doc_id"])
    return fit_features(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([float(r["label"] > 0) for r in got]))


def scores(df: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(features(part.column("text"))))], ["doc_id", "score"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_good(df: DataFrame, model: AdditiveModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose score is at least ``least``, with all their columns."""
    read = fresh(df, "text_read")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, read):
                kept = part.filter(pa.array(model.score(features(part.column(read))) >= least))
                yield kept.select(kept.schema.names[:-1])

    with_text = bounded(df).withColumn(read, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return with_text.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields]))

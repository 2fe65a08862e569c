"""BPE encoding and decoding with a contiguous rank array.

A short word is held as its part boundaries and an array with the rank of each two adjacent parts, looked up by the bytes between their
boundaries. The array is scanned for its minimum, the boundary between those two parts is deleted, and the ranks of the two
neighbouring pairs are refreshed, until no pair has a rank; ids are read off the boundaries last. The scan is quadratic, so
words of more than ``SHORT`` bytes take the heap of ``token_counts``.

Defined results: null counts as empty and gives no ids; special strings inside a text give their own ids; ids that the
vocabulary lacks raise ``KeyError`` in decoding, bytes that aren't UTF-8 become U+FFFD; repeated rows give repeated
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tomewise.llm.common import id_text, slices
from tomewise.llm.pretokens import Remembered, Vocabulary, load_vocabulary, remembered, stretches, words
from tomewise.llm.token_counts import run_merges

SHORT = 200
_NONE = 1 << 60


def merge_word(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of one word."""
    if len(word) > SHORT:
        symbols = [vocabulary.byte_ids[b] for b in word]
        run_merges(symbols, vocabulary.pairs)
        return [s for s in symbols if s >= 0]
    look, none = vocabulary.merges.get, (_NONE, 0)
    bounds = list(range(len(word) + 1))
    # The rank of the parts on either side of each inner boundary; written out below, since a call would take as long as the look-up.
    ranks = [look(word[i : i + 2], none)[0] for i in range(len(word) - 1)]
    while ranks and (least := min(ranks)) != _NONE:
        i = ranks.index(least)
        del bounds[i + 1], ranks[i]
        start, middle = bounds[i], bounds[i + 1]
        if i < len(ranks):
            found, left = look(word[start : bounds[i + 2]], none)
            ranks[i] = found if left == middle - start else _NONE
        if i:
            before = bounds[i - 1]
            found, left = look(word[before:middle], none)
            ranks[i - 1] = found if left == start - before else _NONE
    return [vocabulary.ids[word[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]


class _Encoded(Remembered):
    """Word to its ids as little-endian 32-bit integers."""

    def work_out(self, word: str) -> bytes:
        return np.array(merge_word(word.encode(), self.vocabulary), "<u4").tobytes()


def encode_text(text: str, vocabulary: Vocabulary, memo: dict[str, bytes]) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers."""
    out = []
    for part in stretches(text, vocabulary):
        if isinstance(part, int):
            out.append(part.to_bytes(4, "little"))
        else:
            out.extend(b"".join(map(memo.__getitem__, run)) for run in words(part))
    return b"".join(out)


def decode_ids(ids: Iterable[int], vocabulary: Vocabulary) -> str:
    return b"".join(map(vocabulary.pieces.__getitem__, ids)).decode("utf-8", errors="replace")


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers, as binary) of each row. ``tokenizer``: a path that every executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, memo = load_vocabulary(tokenizer), remembered(_Encoded, tokenizer)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array((encode_text(t, vocabulary, memo) for t in part.column("text").to_pylist()), pa.binary())], ["doc_id", "ids"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(df: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and text of rows as ``encode`` returns them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(tokenizer)
        for batch in batches:
            for part in slices(batch, "ids"):
                texts = (decode_ids(np.frombuffer(b or b"", "<u4").tolist(), vocabulary) for b in part.column("ids").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and the text that these decode to, of each row: ``encode`` and ``decode`` in one Python worker instead of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, memo = load_vocabulary(tokenizer), remembered(_Encoded, tokenizer)
        for batch in batches:
            for part in slices(batch):
                ids = [encode_text(t, vocabulary, memo) for t in part.column("text").to_pylist()]
                texts = [decode_ids(np.frombuffer(b, "<u4").tolist(), vocabulary) for b in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, text string")

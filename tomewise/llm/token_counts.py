"""Token counts by heap-and-linked-list byte-pair merging.

Each distinct word keeps its symbols in a doubly linked list (two index arrays) and the ranks of adjacent pairs in a heap.
The lowest rank is popped again and again; an entry whose symbols have changed since is stale and skipped. The count of a
word is its number of bytes minus the number of merges: identifiers are never emitted. A word costs O(n log n), so a word
of a million letters is no trouble.

Defined results: null counts as empty and has 0 tokens; each special string inside a text counts as one token; repeated
rows give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tomewise.llm.common import id_text, slices
from tomewise.llm.pretokens import Remembered, Vocabulary, load_vocabulary, remembered, stretches, words


def run_merges(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> int:
    """Merge the symbols of one word in place: a merged one takes the place of its left part, its right part becomes -1. The number of merges."""
    size, look = len(symbols), pairs.get
    before, after = list(range(-1, size - 1)), list(range(1, size + 1))
    # Of equal ranks the leftmost goes first.
    heap = [(hit[0], i, hit[1]) for i in range(size - 1) if (hit := look(symbols[i] << 20 | symbols[i + 1]))]
    heapify(heap)
    merges = 0
    while heap:
        rank, i, new = heappop(heap)
        j = after[i]
        # Stale if a symbol is gone or is another one by now.
        if symbols[i] < 0 or j >= size or look(symbols[i] << 20 | symbols[j]) != (rank, new):
            continue
        symbols[i], symbols[j] = new, -1
        merges += 1
        k = after[i] = after[j]
        if k < size:
            before[k] = i
            if hit := look(new << 20 | symbols[k]):
                heappush(heap, (hit[0], i, hit[1]))
        h = before[i]
        if h >= 0 and (hit := look(symbols[h] << 20 | new)):
            heappush(heap, (hit[0], h, hit[1]))
    return merges


def merged_count(word: bytes, vocabulary: Vocabulary) -> int:
    """Tokens of one word: its bytes minus its merges."""
    return len(word) - run_merges([vocabulary.byte_ids[b] for b in word], vocabulary.pairs)


class _Counts(Remembered):
    """Word to its number of tokens."""

    def work_out(self, word: str) -> int:
        return merged_count(word.encode(), self.vocabulary)


def count_tokens(text: str, vocabulary: Vocabulary, counts: dict[str, int]) -> int:
    total = 0
    for part in stretches(text, vocabulary):
        total += 1 if isinstance(part, int) else sum(sum(map(counts.__getitem__, run)) for run in words(part))
    return total


def token_counts(df: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than ``limit``) of each row. ``tokenizer``: a path that every executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = load_vocabulary(tokenizer), remembered(_Counts, tokenizer)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                n = [count_tokens(t, vocabulary, counts) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.binary_length(part.column("text")).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

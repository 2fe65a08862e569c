"""Vocabulary files of byte-level BPE tokenizers and the split of text into words before any merge."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import regex

#: Unicode White_Space, spelled out because libraries differ on what ``\s`` means. Fixed values.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The split that byte-level BPE vocabularies of this family are made with. Fixed value.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: The same for ASCII texts, where it is about twice as fast.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Words of a long text that are held at once.
_RUN = 1 << 16


@dataclass(frozen=True)
class Vocabulary:
    """Merge ranks and ids. ``pairs`` maps ``left id << 20 | right id`` to (rank, merged id), ``merges`` the bytes of a merged token to (rank, size of its left part)."""

    byte_ids: tuple[int, ...]
    pairs: dict[int, tuple[int, int]]
    merges: dict[bytes, tuple[int, int]]
    ids: dict[bytes, int]
    pieces: dict[int, bytes]
    special: dict[str, int]
    special_split: regex.Pattern | None = field(default=None)


def _printable() -> dict[str, int]:
    """Characters that stand for bytes in such files: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def _refuse(spec: dict) -> None:
    """Raise on anything in a file that the code here doesn't do, rather than give other ids than the library."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"dropout": None, "continuing_subword_prefix": "", "end_of_word_suffix": "", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "unk_token": None}
    odd = [k for k, v in plain.items() if (model.get(k) or v) != v]
    odd += ["model type"] * (model.get("type", "BPE") != "BPE") + ["normalizer"] * bool(spec.get("normalizer"))
    odd += ["pre_tokenizer"] * (split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True))
    odd += [f"added token {t['content']!r}" for t in spec.get("added_tokens", []) if any(t.get(k) for k in ("single_word", "lstrip", "rstrip"))]
    if odd:
        raise ValueError(f"this vocabulary needs what isn't supported: {', '.join(odd)}")


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE file of the tokenizers library (``.json``); one that asks for more than byte-level BPE raises ``ValueError``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    _refuse(spec)
    to_byte, vocab = _printable(), spec["model"]["vocab"]
    raw = lambda token: bytes(to_byte[c] for c in token)
    byte_ids = [0] * 256
    for char, byte in to_byte.items():
        byte_ids[byte] = vocab[char]
    pairs, merges = {}, {}
    for rank, merge in enumerate(spec["model"]["merges"]):
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        pairs.setdefault(vocab[left] << 20 | vocab[right], (rank, vocab[left + right]))
        if merges.setdefault(raw(left + right), (rank, len(left)))[0] != rank:
            raise ValueError(f"two merges give {left + right!r}")
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    pieces = {i: raw(token) for token, i in vocab.items() if token not in special}
    ids = {p: i for i, p in pieces.items()}
    pieces |= {i: s.encode() for s, i in special.items()}
    split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    return Vocabulary(tuple(byte_ids), pairs, merges, ids, pieces, special, split)


def stretches(text: str, vocabulary: Vocabulary) -> Iterator[str | int]:
    """The text between special tokens, and the ids of those."""
    if vocabulary.special_split is None or not vocabulary.special_split.search(text):
        yield text
        return
    at = 0
    for m in vocabulary.special_split.finditer(text):
        if m.start() > at:
            yield text[at : m.start()]
        yield vocabulary.special[m.group()]
        at = m.end()
    if at < len(text):
        yield text[at:]


def words(text: str) -> Iterator[list[str]]:
    """Words of a text, in lists of bounded length."""
    pattern = ASCII_WORDS if text.isascii() else WORDS
    if len(text) <= 4 * _RUN:
        yield pattern.findall(text)
        return
    found = pattern.finditer(text)
    while run := [m.group() for m in islice(found, _RUN)]:
        yield run


class Remembered(dict):
    """What a word comes to, worked out at first sight. Two generations of about ``MOST_BYTES``: the older one is dropped when the newer one is full."""

    MOST_BYTES, LONG = 40 << 20, 64

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older, self.held = vocabulary, {}, 0

    def __missing__(self, word: str):
        if len(word) > self.LONG:
            return self.work_out(word)
        out = self.older.get(word)
        if out is None:
            out = self.work_out(word)
        if self.held >= self.MOST_BYTES:
            self.older, self.held = dict(self), 0
            self.clear()
        self[word] = out
        self.held += 200 + 2 * len(word)  # a dict entry, a string and a small result
        return out


@lru_cache(maxsize=2)
def remembered(kind: type[Remembered], path: str) -> Remembered:
    """The memo of this Python worker, which its next tasks go on with."""
    return kind(load_vocabulary(path))

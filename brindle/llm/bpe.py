"""Byte-level BPE encoding and decoding with a contiguous rank array.

A short word is held as an array of part ids beside an array of the ranks of
adjacent pairs.  The smallest rank is found by scanning, its boundary deleted and
the two neighbouring ranks refreshed; with so few parts that beats any heap.  Words
of over ``SCAN_LIMIT`` parts use the same arrays as a linked list with a heap, as
repeated scans would be quadratic.  Encoded words are kept in a bounded cache.

Null texts count as empty; an empty text has no tokens.  Very long texts are encoded
whole, piece by piece.  Ties take the leftmost pair.  Spark's batches are worked through in
parts, so that a worker holds the ids of a few texts at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._session import arrow, id_type

#: Parts up to which a word's ranks are scanned.
SCAN_LIMIT = 96
#: Words whose encoding a worker keeps, twice at most: when the young words reach this
#: number they become the old ones, and old words that come again become young.  They go
#: when a partition ends, as idle workers stay beside the stages that follow.
CACHE = 300_000
#: Bytes of text whose results a worker holds at once, besides those of one more text.
PART = 1 << 19
NONE = 1 << 60
SHIFT = 20
MASK = (1 << SHIFT) - 1


@lru_cache(4)
def _pattern(limit: int) -> re.Pattern:
    """The byte-level split pattern for texts of code points below ``limit``, with the Unicode
    classes spelled out, as re lacks them.  Small limits make small, fast character sets."""
    import regex

    every = "".join(map(chr, [*range(min(limit, 0xD800)), *range(0xE000, limit)]))

    def spans(prop: str) -> str:
        runs = [run for found in regex.findall(rf"\p{{{prop}}}+", every) for run in _runs(found)]
        return "".join(f"{run[0]}-{run[-1]}" for run in runs)

    letter, number = spans("L"), spans("N")
    space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def _runs(chars: str) -> Iterator[str]:
    """Split where code points are not adjacent (matches may span the surrogate gap)."""
    start = 0
    for i in range(1, len(chars) + 1):
        if i == len(chars) or ord(chars[i]) != ord(chars[i - 1]) + 1:
            yield chars[start:i]
            start = i


def _split(text: str) -> list[str]:
    if text.isascii():
        return _pattern(0x80).findall(text)
    top = ord(max(text))
    return _pattern(0x100 if top < 0x100 else 0x10000 if top < 0x10000 else 0x110000).findall(text)


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(kept)]
    return {chr(c): b for b, c in [*((b, b) for b in kept), *((b, 256 + i) for i, b in enumerate(other))]}


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_chars()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: bytes(map(to_byte.__getitem__, s)) for s, i in vocab.items() if s not in self.special}
        self.token |= {i: s.encode() for s, i in self.special.items()}
        single = {v: k for k, v in self.token.items() if len(v) == 1}
        self.single = [single[bytes([b])] for b in range(256)]
        #: left id and right id in one number -> rank and merged id in one number
        self.pair: dict[int, int] = {}
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pair.setdefault(vocab[left] << SHIFT | vocab[right], rank << SHIFT | vocab[left + right])
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.by_name = {str(i): b for i, b in self.token.items()}
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        parts = [self.single[b] for b in word]
        if len(parts) > SCAN_LIMIT:
            return self._merge_long(parts)
        get = self.pair.get
        ranks = [get(a << SHIFT | b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) != NONE:
            i = ranks.index(low)
            parts[i] = low & MASK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << SHIFT | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] << SHIFT | parts[i + 1], NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        pair, n = self.pair, len(parts)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(pair[p], i, p) for i, p in enumerate(a << SHIFT | b for a, b in zip(parts, parts[1:], strict=False)) if p in pair]
        heapq.heapify(heap)
        while heap:
            found, i, both = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] < 0 or parts[i] << SHIFT | parts[j] != both:
                continue
            parts[i], parts[j], after[i] = found & MASK, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := parts[a] << SHIFT | parts[b]) in pair:
                    heapq.heappush(heap, (pair[p], a, p))
        return [p for p in parts if p >= 0]

    def _word(self, word: str) -> str:
        ids = self.old.get(word) or ",".join(map(str, self.merge(word.encode())))
        if len(word) <= 64:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def ids(self, text: str) -> str:
        """The decimal ids of a text joined by commas."""
        if self.split_special and self.split_special.search(text):
            parts = self.split_special.split(text)
            return ",".join([str(self.special[p]) if p in self.special else self._plain(p) for p in parts if p])
        return self._plain(text)

    def _plain(self, text: str) -> str:
        get, word = self.young.get, self._word
        return ",".join([get(w) or word(w) for w in _split(text)])

    def text(self, ids: str) -> str:
        """What decimal ids joined by commas decode to.  Special tokens are not skipped;
        bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.by_name.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.ids(text).split(",")] if text else []

    def decode(self, ids: list[int]) -> str:
        return self.text(",".join(map(str, ids)))


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _parts(batches: Iterator[pa.RecordBatch], own: Codec) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of about ``PART`` bytes of text (the second column).
    Words that ``own`` keeps go at the end."""
    try:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            turn = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // PART)) + 1
            for lo, hi in itertools.pairwise([0, *turn.tolist(), len(batch)]):
                yield batch.slice(lo, hi - lo)
    finally:
        own.young, own.old = {}, {}


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its ids (array<int>).  ``vocabulary`` is a path every executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in _parts(batches, own):
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return arrow(docs.select(id_col, text_col), run, f"{id_col} {id_type(docs, id_col)}, ids array<int>")


def digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every text; return token counts and SHA-256 of the decimal ids
    joined by commas and of the decoded text, and the ids too if ``with_ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in _parts(batches, own):
            count, of_ids, of_text, all_ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.ids(text or "")
                count.append(ids.count(",") + 1 if ids else 0)
                of_ids.append(hashlib.sha256(ids.encode()).hexdigest())
                of_text.append(hashlib.sha256(own.text(ids).encode()).hexdigest())
                if with_ids:
                    all_ids.append(np.fromstring(ids, np.int32, sep=",") if ids else np.empty(0, np.int32))
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.record_batch([*columns, pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else columns, names=names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    return arrow(docs.select(id_col, text_col), run, f"{id_col} {id_type(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)

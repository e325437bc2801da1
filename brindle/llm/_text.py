"""Shared numpy helpers over UTF-8 texts.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which for valid
UTF-8 is exactly ``[^\\x20\\x09-\\x0D]+`` over characters.  Everything here works
on bounded chunks of an Arrow batch, so memory follows the chunk and the longest
single text, never the partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that start a character (all but UTF-8 continuation bytes).
LEAD = (np.arange(256) & 0xC0) != 0x80

_MULT = np.uint64(0x9E3779B97F4A7C15)
_HORNER = np.uint64(0x100000001B3)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Words longer than this are hashed with blake2b, so that loops stay short.
_LONG = 40


def utf8(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as bytes; nulls stay None."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist() if not pa.types.is_binary(column.type) else column.to_pylist()


def chunks(texts: list[bytes | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``limit`` bytes; a longer text is a chunk of its own."""
    start = held = 0
    for i, text in enumerate(texts):
        size = len(text or b"") + 1
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Word boundaries of some texts laid out in one buffer."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        joined = b"\n".join(t or b"" for t in texts) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        self.raw = raw
        self.buf = LOWER[raw] if lower else raw
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        self.text_at = np.concatenate(([0], np.cumsum(sizes)))
        gap = SPACE[raw]
        inside = ~gap
        before = np.concatenate(([True], gap[:-1]))
        self.start = np.flatnonzero(inside & before)
        self.end = np.flatnonzero(gap & ~before)
        #: words[first[i]:first[i + 1]] belong to text i
        self.first = np.searchsorted(self.start, self.text_at)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A mixed 64-bit hash of each word."""
        size = self.end - self.start
        out = np.full(len(size), 1469598103934665603, np.uint64)
        alive = np.flatnonzero(size <= _LONG)
        at, k = self.start[alive], 0
        while len(alive):
            out[alive] = (out[alive] ^ self.buf[at]) * _HORNER
            out[alive] ^= out[alive] >> np.uint64(29)
            k += 1
            more = size[alive] > k
            alive, at = alive[more], at[more] + 1
        for i in np.flatnonzero(size > _LONG):
            word = self.buf[self.start[i] : self.end[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return mix(out + size.astype(np.uint64) * _MULT)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive word hashes."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.full(count, n, np.uint64) * _MULT
    for k in range(n):
        out = (out ^ hashes[k : k + count]) * _STEP
        out ^= out >> np.uint64(32)
    return mix(out)


def shingle_sets(texts: list[bytes | None], n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``n``-word shingles, with A-Z
    lower-cased; of fewer words, one shingle of all; none without words."""
    for lo, hi in chunks(texts):
        words = Words(texts[lo:hi], lower=True)
        hashes = words.hashes()
        full = windows(hashes, n)
        for i in range(hi - lo):
            a, b = words.first[i], words.first[i + 1]
            if b - a >= n:
                yield np.unique(full[a : b - n + 1])
            else:
                yield windows(hashes[a:b], int(b - a)) if b > a else np.empty(0, np.uint64)

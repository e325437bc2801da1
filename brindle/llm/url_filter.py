"""URL filters by a bit-parallel wildcard automaton.

Glob rules (``*`` any run, ``?`` one byte, ``\\`` takes the next literally) are packed
into one row of 64-bit words.  A pattern of m symbols has m + 1 states; the state after
symbol j loops where a ``*`` follows it.  Shift-And runs over all patterns, and over all
URLs of a block, at once: ``D = ((D << 1) & B[c]) | (D & S)`` with the carry between words.

A URL is judged in canonical form, ``host#path?query``: A-Z of the host lower-cased, no
scheme, no fragment.  ``#`` cannot occur in either part, so a rule on hosts never reaches
into a path.  Null URLs and URLs without ``://`` have an empty host and path, which the
default rules block.  Very long URLs take a pass over their own length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._session import arrow, id_type
from ._text import utf8

#: (rule, allow): a host, taken with all subdomains, and the beginning of a path.
PATH_RULES = (("org/", True), ("example.org/es/", False), ("example.org/en/1", False), ("com/fr/", True), ("com/de/", False))
#: Globs over ``host#path?query`` that block where no path rule fits.
BLOCK_GLOBS = ("#*", "*spam*#*", "*casino*#*", "*#*/wp-admin/*", "*#*/login*", "*#*.exe?*", "*#*.zip?*", "*\\?*sessionid=*", "*\\?*utm_source=*")


def split_url(url: bytes | None) -> tuple[bytes, bytes, bytes]:
    """Host, path and query."""
    _, sign, rest = (url or b"").partition(b"://")
    if not sign:
        return b"", b"", b""
    rest = rest.partition(b"#")[0]
    before, mark, query = rest.partition(b"?")
    host, slash, path = before.partition(b"/")
    return host.lower(), slash + path, mark + query


def canonical(url: bytes | None) -> bytes:
    host, path, query = split_url(url)
    return host + b"#" + path + (query or b"?")


@dataclass(frozen=True)
class Automaton:
    """``match`` gives, for each text, which of the globs fit all of it."""

    symbol: np.ndarray  # [256, words]: states that a byte leads to
    loop: np.ndarray  # [words]
    start: np.ndarray
    accept: np.ndarray  # state number of each glob

    @staticmethod
    def of(globs: Sequence[str]) -> Automaton:
        masks: list[int] = [0] * 256
        loop = start = at = 0
        accept = []
        for glob in globs:
            start |= 1 << at
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i : i + 1] == b"*":
                    loop |= 1 << at
                else:
                    every = raw[i : i + 1] == b"?"
                    i += raw[i : i + 1] == b"\\" and i + 1 < len(raw)
                    at += 1
                    for byte in range(256) if every else (raw[i],):
                        masks[byte] |= 1 << at
                i += 1
            accept.append(at)
            at += 1
        n = max(1, -(-at // 64))
        words = lambda x: np.array([x >> 64 * k & (1 << 64) - 1 for k in range(n)], np.uint64)
        return Automaton(np.array([words(m) for m in masks]), words(loop), words(start), np.array(accept, np.int64))

    def match(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.accept)), bool)
        order = np.argsort([-len(t) for t in texts], kind="stable")
        size = np.array([len(texts[i]) for i in order], np.int64)
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begin = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        for k in range(int(size[0]) if len(size) else 0):
            alive = int(np.searchsorted(-size, -k, "left"))  # sizes descend: the first ones go on
            now = state[:alive]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= self.symbol[flat[begin[:alive] + k]]
            moved |= now & self.loop
            state[:alive] = moved
        bits = state[:, self.accept // 64] >> (self.accept % 64).astype(np.uint64) & np.uint64(1)
        out[order] = bits.astype(bool)
        return out


def _escape(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def host_globs(rule: str) -> tuple[str, str]:
    """Globs over ``host#path?query`` for a rule's host and for its subdomains."""
    host, slash, path = rule.partition("/")
    glob = f"{_escape(host)}#{_escape(slash + path)}*"
    return glob, f"*.{glob}"


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", path_rules: Sequence[tuple[str, bool]] = PATH_RULES, block_globs: Sequence[str] = BLOCK_GLOBS) -> DataFrame:
    """Host, path, the longest fitting path rule, and the verdict: that rule's or, where none
    fits, block if any of ``block_globs`` fits and allow otherwise."""
    # longest first; of equal length the first given
    ranked = sorted(path_rules, key=lambda r: -len(r[0]))
    globs = [g for rule, _ in ranked for g in host_globs(rule)] + list(block_globs)
    automaton, n = Automaton.of(globs), len(ranked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = utf8(batch.column(1))
            for lo in range(0, len(urls), 2048):
                some = urls[lo : lo + 2048]
                parts = [split_url(u) for u in some]
                fits = automaton.match([h + b"#" + p + (q or b"?") for h, p, q in parts])
                by_rule = fits[:, : 2 * n].reshape(len(some), n, 2).any(axis=2)
                blocked = fits[:, 2 * n :].any(axis=1)
                first = np.where(by_rule.any(axis=1), by_rule.argmax(axis=1), -1) if n else np.full(len(some), -1)
                rule = [ranked[i][0] if i >= 0 else None for i in first]
                verdict = ["allow" if (ranked[i][1] if i >= 0 else not bad) else "block" for i, bad in zip(first, blocked, strict=True)]
                text = lambda k: pa.array([p[k].decode("utf-8", "replace") for p in parts], pa.string())  # noqa: B023, E731
                yield pa.record_batch([batch.column(0).slice(lo, len(some)), text(0), text(1), pa.array(rule, pa.string()), pa.array(verdict)], names=[id_col, "host", "path", "rule", "verdict"])

    return arrow(pages.select(id_col, url_col), run, f"{id_col} {id_type(pages, id_col)}, host string, path string, rule string, verdict string")

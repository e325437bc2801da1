"""Quality rules as a short-circuit cascade.

Each rule is estimated on a seeded sample (about ``sample_rows`` documents of the whole table) for
its cost, in seconds a document and with the counts that it asks for, and its selectivity, the
share it rejects of what the rules before it let through.  The rule of highest rejection per
cost goes first, and the rest are ranked again on what it leaves.  Each rule then runs over what
the earlier ones let through; counts are made when a rule first asks for them.  A document is
rejected if any rule rejects it, so the order never changes a verdict.

Null and empty texts have zero counts and fail the base rules.  Repeated rows are judged
alike, each on its own; very long texts are judged whole.  There are no ties.  Other columns are
never read, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._session import arrow, id_type
from ._text import LEAD, SPACE, Words, chunks, mix, utf8, windows

WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True


class Base:
    """Counts of some texts, made for the texts and at the time that they are asked for."""

    def __init__(self, texts: list[bytes | None]):
        self.texts = texts
        self.words = Words(texts)
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {"n_words": (self.words.counts(), np.ones(len(texts), bool))}

    def of(self, name: str, rows: np.ndarray) -> np.ndarray:
        """Count ``name`` of the texts numbered ``rows``."""
        values, known = self.known.setdefault(name, (np.zeros(len(self.texts), np.int64), np.zeros(len(self.texts), bool)))
        todo = rows[~known[rows]]
        if len(todo):
            values[todo] = COUNTS[name](self, todo)
            known[todo] = True
        return values[rows]

    def raw(self, i: int) -> np.ndarray:
        """The bytes of a text."""
        return self.words.raw[self.words.text_at[i] : self.words.text_at[i + 1] - 1]


def _each(count: Callable[[np.ndarray], int]) -> Callable[[Base, np.ndarray], np.ndarray]:
    return lambda base, rows: np.fromiter((count(base.raw(i)) for i in rows), np.int64, len(rows))


def _repeated(base: Base, rows: np.ndarray) -> np.ndarray:
    """Words in WINDOW-word windows that a text holds twice or more."""
    words = base.words if len(rows) == len(base.texts) else Words([base.texts[i] for i in rows])
    first, count = words.first, len(words.start)
    full = windows(words.hashes(), WINDOW)
    if not len(full):
        return np.zeros(len(rows), np.int64)
    owner = np.repeat(np.arange(len(rows)), words.counts())
    at = np.flatnonzero(owner[: len(full)] == owner[WINDOW - 1 :])
    key = full[at] ^ mix(owner[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(count + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return covered[first[1:]] - covered[first[:-1]]


def _solid_lines(text: bytes) -> list[bytes]:
    return [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]


def _dup_count(base: Base, rows: np.ndarray) -> np.ndarray:
    lines = (_solid_lines(base.texts[i] or b"") for i in rows)
    return np.fromiter((len(x) - len(set(x)) for x in lines), np.int64, len(rows))


COUNTS: dict[str, Callable[[Base, np.ndarray], np.ndarray]] = {
    "word_chars": _each(lambda b: np.count_nonzero((LEAD & ~SPACE)[b])),
    "n_symbols": _each(lambda b: np.count_nonzero(_SYMBOL[b])),
    "n_dup_lines": _dup_count,
    "n_lines": lambda base, rows: np.fromiter((len(_solid_lines(base.texts[i] or b"")) for i in rows), np.int64, len(rows)),
    "n_repeat_words": _repeated,
    "letters": _each(lambda b: np.count_nonzero(_LETTER[b])),
}


@dataclass(frozen=True)
class Rule:
    """``reject`` marks the rejected ones among the texts named by ``rows``."""

    name: str
    reject: Callable[[Base, np.ndarray], np.ndarray]


def _few_words(base: Base, rows: np.ndarray) -> np.ndarray:
    return base.of("n_words", rows) < 20


def _repeating(base: Base, rows: np.ndarray) -> np.ndarray:
    return 100 * base.of("n_repeat_words", rows) > 30 * base.of("n_words", rows)


def _symbols(base: Base, rows: np.ndarray) -> np.ndarray:
    return 10 * base.of("n_symbols", rows) > base.of("n_words", rows)


def _dup_lines(base: Base, rows: np.ndarray) -> np.ndarray:
    """More than half of the lines are there before."""
    return 2 * base.of("n_dup_lines", rows) > base.of("n_lines", rows)


def _word_length(base: Base, rows: np.ndarray) -> np.ndarray:
    n, chars = base.of("n_words", rows), base.of("word_chars", rows)
    return (chars > 20 * n) | (chars < 2 * n)


def _shouting(base: Base, rows: np.ndarray) -> np.ndarray:
    """More than half of the ASCII and other letters are A-Z."""
    upper = np.fromiter((np.count_nonzero(_UPPER[base.raw(i)]) for i in rows), np.int64, len(rows))
    return 2 * upper > base.of("letters", rows)


def _exclaiming(base: Base, rows: np.ndarray) -> np.ndarray:
    marks = np.fromiter(((base.texts[i] or b"").count(b"!") for i in rows), np.int64, len(rows))
    return 2 * marks > base.of("n_words", rows)


def _letters(base: Base, rows: np.ndarray) -> np.ndarray:
    """Fewer than half of the bytes in words are letters."""
    solid = np.fromiter((np.count_nonzero(~SPACE[base.raw(i)]) for i in rows), np.int64, len(rows))
    return 2 * base.of("letters", rows) < solid


#: What fails a document at once by contract, and what the cascade adds.
BASE_RULES = (Rule("few_words", _few_words), Rule("repeating", _repeating))
RULES = (Rule("symbols", _symbols), Rule("dup_lines", _dup_lines), Rule("word_length", _word_length), Rule("shouting", _shouting), Rule("exclaiming", _exclaiming), Rule("letters", _letters))


@dataclass(frozen=True)
class Estimate:
    name: str
    cost: float
    selectivity: float


def plan_cascade(texts: list[bytes | None], rules: tuple[Rule, ...] = RULES) -> list[Estimate]:
    """Rules in the order of the cascade, by rejection per cost as measured on ``texts``: the best
    one first, then the best one on what that leaves, and so on."""
    found, left = [], list(rules)
    rows = np.arange(len(texts))
    while left:
        tried = []
        for rule in left:
            # counts of its own: what a rule asks for is part of its cost
            base = Base(texts)
            began = time.perf_counter()
            bad = rule.reject(base, rows) if len(rows) else np.empty(0, bool)
            cost = (time.perf_counter() - began) / max(1, len(rows)) + 1e-9
            tried.append((Estimate(rule.name, cost, (int(bad.sum()) + 0.5) / (len(rows) + 1)), rule, bad))
        best, rule, bad = min(tried, key=lambda t: (-t[0].selectivity / t[0].cost, t[0].name))
        found.append(best)
        left.remove(rule)
        rows = rows[~bad]
    return found


def _ordered(docs: DataFrame, text_col: str, rules: tuple[Rule, ...], sample_rows: int, seed: int = 17) -> list[Rule]:
    """``rules`` as planned on a sample of ``sample_rows`` documents by expectation, twice as many at most."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    rows = docs.select(docs[text_col].cast("binary")).sample(False, share, seed).limit(2 * sample_rows).collect()
    by_name = {r.name: r for r in rules}
    return [by_name[e.name] for e in plan_cascade([None if r[0] is None else bytes(r[0]) for r in rows], rules)]


def cascade(base: Base, rows: np.ndarray, rules: list[Rule]) -> np.ndarray:
    """Of ``rows``, those that every rule lets through."""
    for rule in rules:
        if not len(rows):
            break
        rows = rows[~rule.reject(base, rows)]
    return rows


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 400) -> DataFrame:
    """Base counts, base verdict and the cascade's verdict of every document.

    ``sample_rows`` bounds the rows fetched to order the rules, nothing else.
    """
    ordered = _ordered(docs, text_col, rules, sample_rows)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for lo, hi in chunks(texts):
                base, every = Base(texts[lo:hi]), np.arange(hi - lo)
                counts = [base.of(n, every) for n in names]
                failed = _few_words(base, every) | _repeating(base, every)
                kept = np.zeros(hi - lo, bool)
                kept[cascade(base, np.flatnonzero(~failed), ordered)] = True
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(kept)], names=[id_col, *names, "base_failed", "kept"])

    return arrow(docs.select(id_col, text_col), run, f"{id_col} {id_type(docs, id_col)}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + RULES, sample_rows: int = 400) -> DataFrame:
    """The rows of ``docs`` that pass the cascade, base rules included, with all their columns, in one pass."""
    ordered = _ordered(docs, text_col, rules, sample_rows)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(at))
            for lo, hi in chunks(texts):
                yield batch.take(pa.array(cascade(Base(texts[lo:hi]), np.arange(hi - lo), ordered) + lo))

    return arrow(docs, run, docs.schema)

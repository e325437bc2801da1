"""Toxicity from subword-bag embeddings.

A text is a bag of character n-grams (3 to 5 bytes of the lower-cased text, within words
and with word ends as a mark), hashed into rows of an embedding table; the average, weighted
by rarity, goes
through a linear softmax of two classes.  Table and softmax are trained jointly by Adam
in numpy, on the driver, on a bounded sample of labelled rows.  As averaging is linear,
each trained row comes down to one number, and an unseen misspelling shares the numbers
of the n-grams it has in common with known words.

Null and empty texts, and texts without an n-gram, get the score of the bias alone, which
training sees as one clean row.  Long texts are scored whole, in pieces that overlap by
the length of an n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import arrow, id_type
from ._text import chunks, utf8

BITS = 18
BUCKETS = 1 << BITS
LENGTHS = (3, 4, 5)
#: Averages are small, a few words of hundreds; this keeps gradients in range.
SCALE = 64.0
#: An n-gram weighs RARE / (RARE + its share of all n-grams), so that frequent ones count little.
RARE = 1e-4
TOXIC = 0.35
#: Share of its own second moment in a parameter's step, the rest being its array's mean.
OWN = 0.1

#: 0 for what is no letter; bytes beyond ASCII count as letters.
_LETTER = np.zeros(256, np.uint32)
_LETTER[97:123] = np.arange(1, 27)
_LETTER[128:] = np.arange(27, 155)


def lowered(text: bytes | None) -> bytes:
    return (text or b"").decode("utf-8", "replace").lower().encode()


def grams(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Start and bucket of the n-grams of lower-cased text, a length and a piece at a time."""
    step = 1 << 20
    for lo in range(0, len(text) + 2, step):
        # a mark before the first and after the last byte
        b = _LETTER[np.frombuffer((b" " + text + b" ")[lo : lo + step + LENGTHS[-1] - 1], np.uint8)]
        letter = b > 0
        inner = letter.copy()  # inner[i]: bytes i + 1 .. i + n - 2 are letters
        for n in range(3, LENGTHS[-1] + 1):
            size = min(step, len(b) - n + 1)
            if size <= 0:
                break
            inner = letter[1 : 1 + size].copy() if n == 3 else inner[:size] & letter[n - 2 : n - 2 + size]
            h = np.full(size, n, np.uint32)
            for k in range(n):
                h = (h ^ b[k : k + size]) * np.uint32(0x01000193) + np.uint32(0x9E37)
                h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            at = np.flatnonzero(inner)
            yield at + lo, h[at] >> np.uint32(32 - BITS)


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a lower-cased text and their counts."""
    found = [b for _, b in grams(text)]
    ids, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint32), return_counts=True)
    return ids.astype(np.int32), n.astype(np.float32)


@dataclass(frozen=True)
class Model:
    #: what each bucket adds to the difference of the two logits, and the bias
    weight: np.ndarray
    bias: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Of lower-cased texts, laid end to end."""
        edge = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for at, bucket in grams(b" ".join(texts)):
            # a gram starts at the mark before its text at the earliest
            owner = np.searchsorted(edge, at, "right") - 1
            owner = np.minimum(owner, len(texts) - 1)
            total += np.bincount(owner, self.weight[bucket], len(texts))
            count += np.bincount(owner, minlength=len(texts))
        return total / np.maximum(count, 1) + self.bias


class _Rows:
    """A sparse matrix multiplied by dense ones either way."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        self.way = []
        for a, b in ((row, col), (col, row)):
            if len(a) and (a[1:] < a[:-1]).any():
                order = np.argsort(a, kind="stable")
                a, b, v = a[order], b[order], value[order]
            else:
                v = value
            start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.empty(0, np.int64)
            self.way.append((a[start], start, b, v))

    def dot(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        present, start, other, value = self.way[back]
        out = np.zeros((self.shape[back], x.shape[1]), np.float32)
        for d in range(x.shape[1] if len(start) else 0):
            out[present, d] = np.add.reduceat(x[:, d][other] * value, start)
        return out


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 4, epochs: int = 60, rate: float = 0.05, min_rows: int = 5, seed: int = 17) -> Model:
    """Fit table and softmax together; the toxic class has TOXIC of the weight.  Full batches, so the result
    depends on the rows alone."""
    rng = np.random.default_rng(seed)
    labels = np.append(labels, 0).astype(np.int64)  # the empty text counts as clean
    every = np.arange(len(labels))
    row = np.repeat(every[:-1], [len(ids) for ids, _ in bags]).astype(np.int32)
    col = np.concatenate([ids for ids, _ in bags]) if bags else np.empty(0, np.int32)
    value = np.concatenate([n / max(1.0, n.sum()) for _, n in bags]).astype(np.float32) if bags else np.empty(0, np.float32)
    share = np.bincount(col, np.concatenate([n for _, n in bags]) if bags else None, BUCKETS)
    weigh = (RARE / (RARE + share / max(1.0, share.sum()))).astype(np.float32)
    value *= weigh[col]
    # buckets of very few rows only serve to learn those rows by heart
    common = np.bincount(col, minlength=BUCKETS)[col] >= min_rows
    used, col = np.unique(col[common], return_inverse=True)
    texts = _Rows(row[common], col.astype(np.int32), value[common], (len(labels), len(used)))
    params = [rng.normal(0, 0.1, (len(used), dim)).astype(np.float32), rng.normal(0, 0.1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)]
    weight = np.where(labels == 1, TOXIC / max(1, (labels == 1).sum()), (1 - TOXIC) / max(1, (labels == 0).sum())).astype(np.float32)
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, epochs + 1):
        mean = texts.dot(params[0]) * SCALE
        logit = mean @ params[1] + params[2]
        prob = np.exp(logit - logit.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        wrong = prob.copy()
        wrong[every, labels] -= 1
        wrong *= weight[:, None]
        grad = texts.dot(wrong @ params[1].T * SCALE, back=True)
        for p, g, m, v in zip(params, (grad, mean.T @ wrong, wrong.sum(axis=0)), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            # partly one scale for a whole array: n-grams that rarely matter move little
            spread = OWN * v + (1 - OWN) * (v.mean() if v.size else 0)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    out = np.zeros(BUCKETS, np.float32)
    out[used] = SCALE * weigh[used] * (params[0] @ (params[1][:, 1] - params[1][:, 0]))
    return Model(out, float(params[2][1] - params[2][0]))


def sample_bags(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: tuple[int, int], seed: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Bags of about ``per_class`` (clean, toxic) labelled documents, counted on executors."""
    known = labels.filter(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("_label"))
    sizes = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    share = [min(1.0, n / max(1, sizes.get(c, 0))) for c, n in enumerate(per_class)]
    chance = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1_000_000)) / 1e6
    picked = known.filter(chance < F.when(F.col("_label") == 1, share[1]).otherwise(share[0]))
    # about sum(per_class) rows of two numbers
    joined = docs.select(id_col, text_col).join(F.broadcast(picked), id_col).select(id_col, "_label", text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag(lowered(t)) for t in utf8(batch.column(2))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary())], names=["id", "label", "ids", "n"])

    got = sorted((r[0] if r[0] is not None else -1, r[1], bytes(r[2]), bytes(r[3])) for r in arrow(joined, run, "id long, label int, ids binary, n binary").collect())
    return [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in got], np.array([r[1] for r in got], np.int64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: tuple[int, int] = (2600, 1000), seed: int = 17) -> Model:
    """``per_class`` bounds the clean and the toxic labelled documents that are learned from."""
    return train(*sample_bags(docs, labels, id_col, text_col, label_col, per_class, seed))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Probability of the toxic class, and whether it reaches ``threshold``, of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for lo, hi in chunks(texts):
                logits = np.clip(model.logits([lowered(t) for t in texts[lo:hi]]), -50, 50)
                prob = 1 / (1 + np.exp(-logits))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(prob), pa.array((prob >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return arrow(docs.select(id_col, text_col), run, f"{id_col} {id_type(docs, id_col)}, score double, predicted int")

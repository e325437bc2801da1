"""Language identification by nearest centroids.

A text is a vector of hashed character n-grams (bytes, lengths 1 to 3, A-Z lower-cased),
TF-IDF weighted and normalised.  Training vectors of each language are clustered by
spherical k-means into a few centroids; a text takes the language of the nearest one
by cosine.  Texts further than ``reject_below`` from every centroid are marked rejected.

Null texts and texts without a letter are ``und`` with score 0.  Document frequencies
cover all training rows; only k-means uses a sample of at most ``per_language`` distinct
texts a language.  Rows whose language is null are not learned from.  With no training row at
all, every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._session import arrow, id_type
from ._text import LOWER, chunks, utf8

DIM = 4096
_LETTER = regex.compile(rb"[A-Za-z]")
_ANY_LETTER = regex.compile(r"\p{L}")


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (bool(_LETTER.search(text)) or bool(_ANY_LETTER.search(text.decode("utf-8", "replace"))))


def counts(text: bytes) -> np.ndarray:
    """Hashed n-gram counts of a whole text."""
    out = np.zeros(DIM, np.int64)
    step = 1 << 20
    for lo in range(0, max(1, len(text)), step):
        b = LOWER[np.frombuffer(text[max(0, lo - 2) : lo + step], np.uint8)].astype(np.uint32)
        old = min(2, lo)  # bytes already counted as the end of an n-gram
        two = b[:-1] * np.uint32(257) + b[1:] + np.uint32(7919)
        three = two[:-1] * np.uint32(263) + b[2:] + np.uint32(104729)
        for grams, n in ((b, 1), (two, 2), (three, 3)):
            grams = grams[max(0, old - n + 1) :] * np.uint32(2654435761)
            out += np.bincount(grams >> np.uint32(20), minlength=DIM)
    return out


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows; term frequencies are dampened by a logarithm."""
    tf = np.log1p(np.array([counts(t) for t in texts], np.float32).reshape(len(texts), DIM))
    tf *= idf
    tf /= np.maximum(np.linalg.norm(tf, axis=1, keepdims=True), 1e-12)
    return tf


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    #: language of each centroid
    langs: tuple[str, ...]

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and cosine, in 0 to 1, of the nearest centroid."""
        near = vectors(texts, self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        return [self.langs[i] for i in best], np.clip(near[np.arange(len(texts)), best], 0, 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids, seeded by farthest points, so that equal input gives equal output."""
    picked = [0]
    near = x @ x[0]
    while len(picked) < min(k, len(x)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    centroids = x[picked].copy()
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        for c in range(len(centroids)):
            if (own == c).any():
                mean = x[own == c].mean(axis=0)
                centroids[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centroids


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many texts each hashed n-gram occurs, over all rows.  What reaches the driver
    is one row for each of the DIM n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIM + 1, np.int64)
        for batch in batches:
            for text in utf8(batch.column(0)):
                df[:DIM] += counts(text or b"") > 0
                df[DIM] += 1
        yield pa.record_batch([pa.array(np.arange(DIM + 1)), pa.array(df)], names=["gram", "n"])

    rows = arrow(docs.select(text_col), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM + 1, np.int64)
    for gram, n in rows:
        df[gram] = n
    return df[:DIM], int(df[DIM])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", clusters: int = 3, per_language: int = 400, seed: int = 17) -> Model | None:
    """Learn from all rows with a language; k-means sees the ``per_language`` distinct
    texts of lowest hash of each, or all of fewer.  The number of languages must be small
    (``per_language`` vectors each reach the driver)."""
    labelled = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    df, n = document_frequencies(labelled, text_col)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    hashed = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(seed), text_col).alias("h"))
    keys = hashed.select("lang", "h").distinct().withColumn("part", F.pmod("h", F.lit(64)))
    # the lowest of each part first, so that no task takes more than 64 * per_language rows of a language
    for by in (("lang", "part"), ("lang",)):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("h"))
        keys = keys.withColumn("place", place).filter(F.col("place") <= per_language).drop("place")
    sample = hashed.join(F.broadcast(keys.drop("part")), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            for lo in range(0, len(texts), 256):
                rows = vectors(texts[lo : lo + 256], idf).astype(np.float16)
                yield pa.record_batch([pa.array(langs[lo : lo + 256], pa.string()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "vector"])

    got = sorted((r[0], bytes(r[1])) for r in arrow(sample, run, "lang string, vector binary").collect())
    langs: list[str] = []
    centroids = []
    for lang in sorted({name for name, _ in got}):
        own = [np.frombuffer(v, np.float16) for name, v in got if name == lang]
        found = spherical_kmeans(np.array(own, np.float32), clusters)
        centroids.append(found)
        langs += [lang] * len(found)
    return Model(idf, np.concatenate(centroids), tuple(langs))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", reject_below: float = 0.35) -> DataFrame:
    """lang_pred, score (cosine) and rejected (cosine below ``reject_below``) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for lo, hi in chunks(texts, 1 << 21):
                lang, score = ["und"] * (hi - lo), np.zeros(hi - lo)
                for at in range(lo, hi, 512):
                    rows = [i for i in range(at, min(hi, at + 512)) if model and has_letter(texts[i])]
                    if rows:
                        found, near = model.predict([texts[i] for i in rows])
                        score[np.array(rows) - lo] = near
                        for i, name in zip(rows, found, strict=True):
                            lang[i - lo] = name
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(lang), pa.array(score), pa.array(score < reject_below)], names=[id_col, "lang_pred", "score", "rejected"])

    return arrow(docs.select(id_col, text_col), run, f"{id_col} {id_type(docs, id_col)}, lang_pred string, score double, rejected boolean")


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3

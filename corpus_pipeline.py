"""A training corpus from raw documents, in five stages.

Each stage works on all that its predecessor kept: junk goes, one document of each group of
near copies stays, secrets are redacted, sources are mixed to target weights (documents
repeat as often as the mix takes them, as rows alike), and what is left is encoded to token ids.

Null and empty texts go at the first stage; rows with a null id are kept as documents of their own, a null
source is a source.  Rows that repeat an id are one document from near-dedup on.  Very long
texts pass whole.  Columns beyond those of documents go along up to the last stage, whatever
their names.  Ties go by id.  An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brindle.llm import bpe, minhash, mixing, quality, secret_scan
from brindle.llm._session import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more."""
    return minhash.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    words = secret_scan.dictionary(docs)
    return secret_scan.redact(docs, secret_scan.fit(spark, words=words), path_col="source", words=words)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_taken(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number and digests."""
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scans", secret_scans), ("source_mixing", source_mixing), ("bpe_encoding", bpe_encoding)]

#: Sketches, forests and merges are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs

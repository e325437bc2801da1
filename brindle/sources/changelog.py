"""The change log: an append-only folder of mutation rows, its check and its compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "entry_type string, bucket string, key string, value string, cas bigint, seq_no bigint, rev_id bigint, flags bigint, deleted boolean, timestamp bigint"
_NAMES = [c.split()[0] for c in LOG.split(", ")]


def _crc():
    return F.crc32(F.to_json(F.struct(*_NAMES)).cast("binary"))


def append(entries: DataFrame, path: str) -> None:
    """Add entries, each with a checksum."""
    entries.select(*_NAMES, _crc().alias("crc")).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Entries whose checksum holds; with ``strict`` a broken one is an error."""
    rows = spark.read.schema(f"{LOG}, crc bigint").parquet(path)
    good = rows.filter(F.col("crc") == _crc())
    if strict and rows.count() != good.count():
        raise ValueError("the log has broken entries")
    return good.drop("crc")


def truncate(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], f"{LOG}, crc bigint").write.mode("overwrite").parquet(path)


def latest(log: DataFrame, keys: tuple[str, ...] = ("key",), order: str = "seq_no") -> DataFrame:
    """The last entry of each key, by partial aggregation rather than a window."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def compact(log: DataFrame, keys: tuple[str, ...] = ("key",), order: str = "seq_no") -> DataFrame:
    """Last write wins; a tombstone drops its key."""
    return latest(log, keys, order).filter(~F.col("deleted"))


def recover(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """A snapshot brought up to date by the entries after it."""
    return compact(snapshot.select(*_NAMES).unionByName(log.select(*_NAMES)))


def mutations_since(state: DataFrame, seq_no: int, vbucket: int | None = None) -> DataFrame:
    out = state.filter(F.col("seq_no") > seq_no)
    return out if vbucket is None else out.filter(F.col("vbucket_id") == vbucket)


def high_seqno(state: DataFrame) -> DataFrame:
    return state.groupBy("vbucket_id").agg(F.max("seq_no").alias("high_seqno"))


def write_sorted(df: DataFrame, path: str, key: str = "key", codec: str = "snappy") -> None:
    """Files sorted by key over ranges: point and range reads prune by their statistics."""
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").option("compression", codec).parquet(path)


def export_vbucket(state: DataFrame, vbucket: int, path: str) -> None:
    state.filter(F.col("vbucket_id") == vbucket).write.mode("overwrite").parquet(path)


def import_vbucket(state: DataFrame, vbucket: int, path: str) -> DataFrame:
    """The partition as exported, in place of what is there."""
    rows = state.sparkSession.read.schema(state.schema).parquet(path)
    return state.filter(F.col("vbucket_id") != vbucket).unionByName(rows)

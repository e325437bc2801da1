"""Change events: publishing, streams with filters, backfill, polling and replication.

Events are appended to a folder; a stream is a file source over it, and its cursor is the
query's checkpoint, so stopping and starting again is pause and resume.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import kv, replication

EVENT = (
    "event_type string, key string, value string, cas bigint, seq_no bigint, vbucket_id int, bucket string, scope string, collection string, "
    "timestamp string, expiry bigint, flags bigint, datatype int"
)


def events_of(state: DataFrame, bucket: str, now: Column | None = None) -> DataFrame:
    """Document rows as mutation, deletion and expiration events."""
    now = F.current_timestamp() if now is None else now
    kind = F.when(F.col("deleted"), "deletion").when(F.coalesce(F.col("expiry") < now, F.lit(False)), "expiration").otherwise("mutation")
    return state.select(kind.alias("event_type"), "key", "value", "cas", "seq_no", "vbucket_id", F.lit(bucket).alias("bucket"), "scope", "collection", F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), F.coalesce(F.unix_timestamp("expiry"), F.lit(0)).alias("expiry"), "flags", F.lit(1).alias("datatype"))


def publish(events: DataFrame, path: str) -> None:
    events.select(*(c.split()[0] for c in EVENT.split(", "))).write.mode("append").parquet(path)


def wanted(df: DataFrame, bucket: str | None = None, scope: str | None = None, collection: str | None = None, from_seq_no: int = 0) -> DataFrame:
    for c, v in (("bucket", bucket), ("scope", scope), ("collection", collection)):
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df.filter(F.col("seq_no") > from_seq_no) if from_seq_no else df


def stream(spark: SparkSession, path: str, max_files: int | None = None, **filters) -> DataFrame:
    reader = spark.readStream.schema(EVENT)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return wanted(reader.parquet(path), **filters)


def backfill(state: DataFrame, bucket: str, **filters) -> DataFrame:
    """The current state as mutation events."""
    return wanted(events_of(kv.live(state), bucket), **filters)


def poll(events: DataFrame, checkpoint: str, take: Callable[[DataFrame, int], None]) -> None:
    """Hand over what is new since the last poll with this checkpoint, once."""
    query = events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def follow(events: DataFrame, checkpoint: str, take: Callable[[DataFrame, int], None], every: str = "500 milliseconds") -> StreamingQuery:
    """Go on handing over batches; stop() pauses, and following again resumes."""
    return events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def latest(events: DataFrame) -> DataFrame:
    """The last event of each key, for batches and for streams in complete or update mode."""
    rest = [c for c in events.columns if c != "key"]
    return events.groupBy("key").agg(F.max_by(F.struct(*rest), "seq_no").alias("_e")).select("key", "_e.*")


def replicate(changes: DataFrame, checkpoint: str, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], mode: str = "sequence", cluster: str = "source", target: str = "target", expression: str | None = None) -> None:
    """Apply a stream of document rows to a target: loop prevention, filter, then for each batch
    the winner of both sides by key."""

    def take(batch: DataFrame, _: int) -> None:
        sent = replication.outgoing(batch, cluster, target, expression)
        newest = sent.groupBy("key").agg(F.max_by(F.struct(*sent.columns), "seq_no").alias("_r")).select("_r.*")
        write(replication.resolve(read(), newest, mode))

    poll(changes, checkpoint, take)


def expired(events: DataFrame, now: Column) -> DataFrame:
    """Expiration events for documents whose last event names a time that has passed."""
    due = latest(events).filter((F.col("event_type") == "mutation") & (F.col("expiry") > 0) & (F.timestamp_seconds("expiry") < now))
    return due.withColumn("event_type", F.lit("expiration")).withColumn("value", F.lit(None).cast("string"))


def window_counts(events: DataFrame, time: str, size: str, late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Extension: events in each window of event time, with a watermark for late ones."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count(F.lit(1)).alias("n"))

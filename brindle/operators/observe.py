"""Audit queries, gauges and the partition map, as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kv

AUDIT = "id bigint, time timestamp, type string, user string, bucket string, detail string, success boolean"


def audit(events: DataFrame, limit: int = 100, offset: int = 0, type_: str | None = None, bucket: str | None = None, id_col: str = "id", type_col: str = "type") -> DataFrame:
    """Newest first."""
    if type_ is not None:
        events = events.filter(F.col(type_col) == type_)
    if bucket is not None:
        events = events.filter(F.col("bucket") == bucket)
    return events.orderBy(F.desc(id_col)).offset(offset).limit(limit)


def gauges(states: dict[str, DataFrame], quota_bytes: int = 256 << 20) -> DataFrame:
    """metric, bucket and value: documents, bytes, quota, tombstones, expired and evicted."""
    out = None
    for name, state in states.items():
        on = ~F.col("deleted") & (F.col("expiry").isNull() | (F.current_timestamp() <= F.col("expiry")))
        row = state.agg(F.count_if(on).alias("documents"), F.coalesce(F.sum(F.when(on, kv.document_bytes())), F.lit(0)).alias("bytes"), F.count_if("deleted").alias("tombstones"), F.count_if("evicted").alias("evicted"), F.count_if(F.col("expiry").isNotNull()).alias("with_ttl"), F.lit(quota_bytes).alias("quota_bytes"))
        row = row.select(F.lit(name).alias("bucket"), F.posexplode(F.array(*row.columns)).alias("_i", "value"), F.lit(row.columns).alias("_names")).select(F.get("_names", F.col("_i")).alias("metric"), "bucket", F.col("value").cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def partition_map(spark, nodes: list[str], partitions: int = kv.PARTITIONS, replicas: int = 1) -> DataFrame:
    """Round-robin owners, with replicas on the nodes that follow."""
    n = len(nodes)
    names = F.lit(nodes)
    rows = spark.range(partitions).select(F.col("id").cast("int").alias("vbucket_id"))
    copies = F.transform(F.sequence(F.lit(1), F.lit(max(0, min(replicas, n - 1)))), lambda r: F.get(names, ((F.col("vbucket_id") + r) % n).cast("int"))) if replicas and n > 1 else F.array().cast("array<string>")
    return rows.select("vbucket_id", F.get(names, (F.col("vbucket_id") % n).cast("int")).alias("owner"), copies.alias("replicas"))

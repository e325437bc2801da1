"""Backups: per bucket its configuration, scopes and documents, and one manifest."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFound
from ..operators import kv
from .catalog import Catalog, Config

MANIFEST = "backup_id string, name string, created_at string, bucket string, mode string, key string, config string, scopes string"


def write(catalog: Catalog, path: str, name: str = "backup", buckets: list[str] | None = None) -> str:
    """Documents as Parquet under ``path/<id>/<bucket>``; the manifest is written last, so that
    a backup that broke off is not seen."""
    spark, made = catalog.spark, uuid.uuid4().hex
    rows = []
    now = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")).first()[0]
    for b in (catalog.get(n) for n in (buckets or sorted(catalog.buckets))):
        b.frame.write.parquet(f"{path}/{made}/{b.name}")
        rows.append((made, name, now, b.name, b.mode, b.key, json.dumps(asdict(b.config)), json.dumps({s: sorted(c) for s, c in b.scopes.items()})))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return made


def manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def restore(catalog: Catalog, path: str, backup_id: str, buckets: list[str] | None = None) -> list[str]:
    """Bring buckets back; documents that are newer now stay (by CAS)."""
    spark = catalog.spark
    found = manifests(spark, path).filter(F.col("backup_id") == backup_id).collect()
    if not found:
        raise NotFound(f"backup {backup_id}")
    out = []
    for r in found:
        if buckets and r["bucket"] not in buckets:
            continue
        rows = spark.read.parquet(f"{path}/{backup_id}/{r['bucket']}")
        if r["mode"] == "table":
            catalog.add_table(r["bucket"], rows, r["key"])
        else:
            b = catalog.buckets.get(r["bucket"]) or catalog.create(r["bucket"], Config(**json.loads(r["config"])))
            b.scopes = {s: set(c) for s, c in json.loads(r["scopes"]).items()}
            both = b.frame.unionByName(rows.select(*kv.COLUMNS))
            merged = both.groupBy("key").agg(F.max_by(F.struct(*kv.COLUMNS), "cas").alias("_w")).select("_w.*")
            catalog.replace(b.name, merged)
        out.append(r["bucket"])
    return out


def delete(spark: SparkSession, path: str, backup_id: str) -> None:
    """Drop a backup's files and its lines in the manifest."""
    rest = manifests(spark, path).filter(F.col("backup_id") != backup_id).collect()
    spark.createDataFrame(rest, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{backup_id}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

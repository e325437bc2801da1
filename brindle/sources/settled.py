"""DataFrames written to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """Write to the shared folder in spark.checkpoint.dir and read again; lineage ends there.
    Where that is unset, a folder beside the warehouse serves, on one machine only."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-scratch"
    path = f"{top.rstrip('/')}/brindle-state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

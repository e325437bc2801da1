"""Replication between copies of a bucket, and the resolution of conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Invalid

#: What wins, most telling first; the local copy wins ties.
ORDERS = {"sequence": ("rev_id", "cas"), "timestamp": ("updated_at", "cas")}


def keep(expression: str | None, value: str = "value") -> Column:
    """``key:prefix`` or ``field=value`` as a filter on document rows."""
    if not expression:
        return F.lit(True)
    if expression.startswith("key:"):
        return F.col("key").startswith(expression[4:])
    path, sign, wanted = expression.partition("=")
    if not sign:
        raise Invalid(f"not a filter: {expression}")
    return F.coalesce(F.get_json_object(value, f"$.{path.strip()}") == wanted.strip().strip("\"'"), F.lit(False))


def outgoing(source: DataFrame, cluster: str, target: str, expression: str | None = None, since: int = 0) -> DataFrame:
    """What is to be sent: changes after ``since``, without what came from the target itself."""
    came = F.coalesce(F.col("source_cluster") == target, F.lit(False))
    sent = source.filter((F.col("seq_no") > since) & ~came & keep(expression))
    return sent.withColumn("source_cluster", F.coalesce("source_cluster", F.lit(cluster)))


def resolve(local: DataFrame, remote: DataFrame, mode: str = "sequence", key: str = "key") -> DataFrame:
    """One row for each key: the winner of both sides."""
    order = ORDERS.get(mode)
    if order is None:
        raise Invalid(f"no conflict mode {mode}")
    columns = local.columns
    both = local.select("*", F.lit(1).alias("_local")).unionByName(remote.select(*columns, F.lit(0).alias("_local")))
    best = F.max_by(F.struct(*columns), F.struct(*order, "_local"))
    return both.groupBy(key).agg(best.alias("_w")).select("_w.*")


def statistics(local: DataFrame, remote: DataFrame, mode: str = "sequence", key: str = "key") -> DataFrame:
    """How many incoming rows are accepted or rejected, and how many met a local copy."""
    order = ORDERS[mode]
    mine = local.select(key, F.struct(*order).alias("_mine"))
    both = remote.select(key, F.struct(*order).alias("_theirs")).join(mine, key, "left")
    wins = F.col("_mine").isNull() | (F.col("_theirs") > F.col("_mine"))
    return both.agg(F.count_if(wins).alias("accepted"), F.count_if(~wins).alias("rejected"), F.count("_mine").alias("conflicts"))

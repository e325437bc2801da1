"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import cut, free


def _low(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself; partial sums keep hot nodes cheap."""
    return edges.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has ids ``a`` and ``b``.  Returns ``node`` and ``root``, the smallest node
    reachable, for every node but the roots.  Only counts reach the driver.  Null ends, loops and
    repeated edges count for nothing; no edges give no rows."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        state = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40)))).first())
        if state == seen:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._brindle_path = e._brindle_path
            return out
        seen = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours go to the smallest of the neighbourhood
        large = both.join(_low(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours, and the node itself, go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, old = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct()), e
        free(old)

"""Key-value mutations as whole-table rewrites.

A document table has the columns of ``SCHEMA``; values are JSON text.  Each function takes
a state and returns the next one: rows that a batch of mutations touches are joined with
it by key, the rest passes through.  ``clock`` gives the batch's time and first number, so
results can be repeated.  Numbers rise within a batch but need not be dense, so no batch
is ordered in one task.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import CasMismatch, Conflict, NotFound

SCHEMA = (
    "key string, scope string, collection string, value string, cas bigint, seq_no bigint, rev_id bigint, expiry timestamp, flags bigint, "
    "created_at timestamp, updated_at timestamp, deleted boolean, source_cluster string, vbucket_id int, xattrs map<string,string>, last_accessed timestamp, evicted boolean"
)
COLUMNS = [c.split()[0] for c in SCHEMA.replace("map<string,string>", "map").split(", ")]
PARTITIONS = 1024


@dataclass(frozen=True)
class Clock:
    now: dt.datetime
    first: int = 1

    @property
    def time(self) -> Column:
        return F.lit(self.now).cast("timestamp")


def vbucket(key: Column, partitions: int = PARTITIONS) -> Column:
    return (F.crc32(key.cast("string").cast("binary")) % partitions).cast("int")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def live(state: DataFrame, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return state.filter(~F.col("deleted") & (F.col("expiry").isNull() | (now <= F.col("expiry"))))


def documents(df: DataFrame, clock: Clock, key: Column, value: Column, partitions: int = PARTITIONS) -> DataFrame:
    """Any rows as a new document table."""
    n = F.monotonically_increasing_id() + F.lit(clock.first)
    new = {
        "key": key.cast("string"), "scope": F.lit("_default"), "collection": F.lit("_default"), "value": value, "cas": n, "seq_no": n, "rev_id": F.lit(1), "expiry": F.lit(None), "flags": F.lit(0),
        "created_at": clock.time, "updated_at": clock.time, "deleted": F.lit(False), "source_cluster": F.lit(None), "vbucket_id": vbucket(key, partitions), "xattrs": F.create_map(), "last_accessed": clock.time, "evicted": F.lit(False),
    }
    return _typed(df.select(*(c.alias(n) for n, c in new.items())))


def _typed(df: DataFrame) -> DataFrame:
    kinds = dict(x.split(" ", 1) for x in SCHEMA.split(", "))
    return df.select(*(F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS))


def _merged(state: DataFrame, touched: DataFrame) -> DataFrame:
    """``touched`` rows in place of those with their keys."""
    return state.join(touched.select("key"), "key", "left_anti").select(*COLUMNS).unionByName(_typed(touched))


def _incoming(batch: DataFrame) -> DataFrame:
    """The batch with all columns a mutation may carry."""
    have = set(batch.columns)
    extra = {"scope": F.lit("_default"), "collection": F.lit("_default"), "expiry": F.lit(None).cast("timestamp"), "flags": F.lit(0).cast("bigint"), "cas": F.lit(None).cast("bigint")}
    rows = batch.select("key", F.col("value").alias("in_value"), *((F.col(n) if n in have else c).alias(f"in_{n}") for n, c in extra.items()))
    # of a key's several writes the last one counts, and each is a revision
    last = rows.withColumn("_at", F.monotonically_increasing_id()).groupBy("key").agg(F.max_by(F.struct(*rows.columns[1:]), "_at").alias("_x"), F.count(F.lit(1)).alias("in_writes"))
    return last.select("key", "_x.*", "in_writes")


def upsert(state: DataFrame, batch: DataFrame, clock: Clock, max_ttl: int | None = None, partitions: int = PARTITIONS) -> DataFrame:
    """``batch``: key and value, and perhaps scope, collection, expiry and flags.  A key's
    revision goes on after a tombstone, and the document lives again.  Of a key that the batch
    repeats, its last row in the batch's order is written."""
    n = F.monotonically_increasing_id() + F.lit(clock.first)
    expiry = F.coalesce("in_expiry", clock.time + F.make_interval(secs=F.lit(max_ttl))) if max_ttl else F.col("in_expiry")
    old = state.select("key", "rev_id", "created_at", "xattrs")
    rows = _incoming(batch).join(old, "key", "left").select(
        "key", F.col("in_scope").alias("scope"), F.col("in_collection").alias("collection"), F.col("in_value").alias("value"), n.alias("cas"), n.alias("seq_no"), (F.coalesce("rev_id", F.lit(0)) + F.col("in_writes")).alias("rev_id"), expiry.alias("expiry"), F.col("in_flags").alias("flags"),
        F.coalesce("created_at", clock.time).alias("created_at"), clock.time.alias("updated_at"), F.lit(False).alias("deleted"), F.lit(None).alias("source_cluster"), vbucket(F.col("key"), partitions).alias("vbucket_id"), F.coalesce("xattrs", F.create_map().cast("map<string,string>")).alias("xattrs"), clock.time.alias("last_accessed"), F.lit(False).alias("evicted"),
    )
    return _merged(state, rows)


def insert(state: DataFrame, batch: DataFrame, clock: Clock) -> DataFrame:
    clash = live(state, clock.time).join(batch.select("key"), "key", "left_semi").limit(1)
    if not clash.isEmpty():
        raise Conflict(f"key exists: {clash.first()['key']}")
    return upsert(state, batch, clock)


def check_cas(state: DataFrame, batch: DataFrame, clock: Clock) -> None:
    """Every key of ``batch`` lives, and has the cas it names, if it names one."""
    found = batch.join(live(state, clock.time).select("key", F.col("cas").alias("_now")), "key", "left")
    bad = found.filter(F.col("_now").isNull() | ((F.col("cas") != F.col("_now")) if "cas" in batch.columns else F.lit(False))).limit(1).collect()
    if bad:
        raise (NotFound if bad[0]["_now"] is None else CasMismatch)(bad[0]["key"])


def replace(state: DataFrame, batch: DataFrame, clock: Clock) -> DataFrame:
    check_cas(state, batch, clock)
    return upsert(state, batch, clock)


def _change(state: DataFrame, keys: DataFrame, clock: Clock, **columns: Column) -> DataFrame:
    """Set columns of live documents; number and revision go on.  The state is joined with the keys: they are broadcast if few, else both are shuffled."""
    hit = state.join(keys.select("key").distinct().withColumn("_hit", F.lit(True)), "key", "left")
    on = F.coalesce("_hit", F.lit(False)) & ~F.col("deleted") & (F.col("expiry").isNull() | (clock.time <= F.col("expiry")))
    n = F.monotonically_increasing_id() + F.lit(clock.first)
    columns = {"cas": n, "seq_no": n, "rev_id": F.col("rev_id") + 1, "updated_at": clock.time, "last_accessed": clock.time} | columns
    return _typed(hit.select(*((F.when(on, columns[c]).otherwise(F.col(c)) if c in columns else F.col(c)).alias(c) for c in COLUMNS)))


def delete(state: DataFrame, keys: DataFrame, clock: Clock) -> DataFrame:
    """Tombstones in place of documents."""
    check_cas(state, keys, clock)
    return _change(state, keys, clock, deleted=F.lit(True), value=F.lit(None))


def touch(state: DataFrame, keys: DataFrame, expiry: Column, clock: Clock) -> DataFrame:
    return _change(state, keys, clock, expiry=expiry)


def counter(state: DataFrame, keys: DataFrame, delta: int, clock: Clock, initial: int | None = None) -> DataFrame:
    """Add to numbers, never below 0; keys that are not there get ``initial``."""
    out = _change(state, keys, clock, value=F.greatest(F.lit(0).cast("decimal(20,0)"), F.col("value").try_cast("decimal(20,0)") + delta).cast("string"))
    if initial is None:
        return out
    new = keys.select("key").distinct().join(live(state, clock.time).select("key"), "key", "left_anti")
    return upsert(out, new.withColumn("value", F.lit(str(initial))), clock)


def append(state: DataFrame, keys: DataFrame, text: str, clock: Clock, front: bool = False) -> DataFrame:
    """Add to string values; others stay as they are."""
    inner, add = F.regexp_extract("value", r'(?s)^"(.*)"$', 1), F.lit(json.dumps(text, ensure_ascii=False)[1:-1])
    joined = F.concat(F.lit('"'), add, inner, F.lit('"')) if front else F.concat(F.lit('"'), inner, add, F.lit('"'))
    return _change(state, keys, clock, value=F.when(F.col("value").startswith('"'), joined).otherwise(F.col("value")))


def get(state: DataFrame, key: str, now: Column | None = None) -> DataFrame:
    return live(state, now).filter(F.col("key") == key)


def exists(state: DataFrame, keys: DataFrame, now: Column | None = None) -> DataFrame:
    found = live(state, now).select("key", F.lit(True).alias("found"))
    return keys.select("key").join(found, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))


def meta(state: DataFrame) -> DataFrame:
    """All but the values, tombstones included."""
    return state.drop("value", "xattrs")


def purge_expired(state: DataFrame, clock: Clock) -> DataFrame:
    return _typed(state.withColumns({"value": F.when(_expired(clock), None).otherwise(F.col("value")), "deleted": F.col("deleted") | _expired(clock)}))


def _expired(clock: Clock) -> Column:
    return F.coalesce(F.col("expiry") < clock.time, F.lit(False))


def purge_tombstones(state: DataFrame, age_s: int, clock: Clock) -> DataFrame:
    return state.filter(~(F.col("deleted") & (F.col("updated_at") < clock.time - F.make_interval(secs=F.lit(age_s)))))


def document_bytes() -> Column:
    return F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 128


def stats(state: DataFrame, by_vbucket: bool = False, now: Column | None = None) -> DataFrame:
    rows = live(state, now)
    aggs = F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(document_bytes()), F.lit(0)).cast("bigint").alias("bytes")
    return rows.groupBy("vbucket_id").agg(*aggs) if by_vbucket else rows.agg(*aggs)


def evict(sizes: DataFrame, free: int, order: list[Column], buckets: int = 64) -> DataFrame:
    """Rows of ``sizes`` (with ``bytes``) to evict: oldest first until ``free`` bytes are freed.

    The order is cut into ranges, whose sums show where each begins; ranges that begin beyond
    the limit are left out, and the others are summed row by row, each in a task of its own.
    """
    ranged = sizes.select("*", F.struct(*order).alias("_o"))
    parts = ranged.repartitionByRange(buckets, "_o").withColumn("_p", F.spark_partition_id())
    upto = parts.groupBy("_p").agg(F.sum("bytes").alias("_b")).withColumn("_before", F.sum("_b").over(Window.orderBy("_p")) - F.col("_b"))
    placed = parts.join(F.broadcast(upto.filter(F.col("_before") < free)), "_p")
    run = F.sum("bytes").over(Window.partitionBy("_p").orderBy("_o")) + F.col("_before") - F.col("bytes")
    return placed.withColumn("freed_before", run).filter(F.col("freed_before") < free).drop("_o", "_p", "_b", "_before")


def page(df: DataFrame, prefix: str = "", offset: int = 0, limit: int = 50, key: str = "_key") -> DataFrame:
    """A page of documents in key order, with the number of matches and whether more follow."""
    limit = min(limit, 500)
    rows = df.filter(F.col(key).startswith(prefix)) if prefix else df
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    some = rows.orderBy(key).offset(offset).limit(limit)
    return some.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)

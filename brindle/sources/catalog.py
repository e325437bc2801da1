"""Buckets by name, and what the planner needs to know about them.

A table bucket is a DataFrame with a declared key column; a document bucket is a table in
``kv.SCHEMA`` whose JSON values get the schema they have in common.  Mutations swap in a
new DataFrame; ``settle`` writes it to the shared folder once plans get long.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Conflict, NotFound
from ..operators import indexes, kv, subdoc
from ..plans import lowering
from ..plans import syntax as S
from ..streaming import changes
from .settled import settle

#: Mutations of a table bucket after which its state is written out; those of document
#: buckets number their rows, so each is written out at once and stays as it is.
SETTLE_AFTER = 8


@dataclass
class Config:
    kind: str = "persistent"
    ram_quota_mb: int = 256
    replicas: int = 1
    vbuckets: int = kv.PARTITIONS
    flush: bool = True
    conflict: str = "sequence"
    max_ttl: int = 0
    compression: str = "off"
    eviction: str = "value"


@dataclass
class Bucket:
    name: str
    mode: str  # table or document
    frame: DataFrame
    key: str = "key"
    config: Config = field(default_factory=Config)
    scopes: dict[str, set[str]] = field(default_factory=lambda: {"_default": {"_default"}})
    schema: T.StructType | None = None
    version: int = 0
    seq: int = 1
    now: dt.datetime | None = None


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.buckets: dict[str, Bucket] = {}
        self.indexes: dict[tuple[str, str], indexes.Definition] = {}
        #: folders to which a bucket's changes are published
        self.watched: dict[str, str] = {}

    # -- buckets

    def get(self, name: str) -> Bucket:
        if name not in self.buckets:
            raise NotFound(f"bucket {name}")
        return self.buckets[name]

    def add_table(self, name: str, df: DataFrame, key: str) -> Bucket:
        self.buckets[name] = Bucket(name, "table", df, key)
        return self.buckets[name]

    def create(self, name: str, config: Config | None = None) -> Bucket:
        if name in self.buckets:
            raise Conflict(f"bucket {name} exists")
        self.buckets[name] = Bucket(name, "document", kv.empty(self.spark), config=config or Config())
        return self.buckets[name]

    def drop(self, name: str) -> None:
        self.get(name)
        del self.buckets[name]
        for k in [k for k in self.indexes if k[0] == name]:
            del self.indexes[k]

    def flush(self, name: str) -> None:
        self.replace(name, self.get(name).frame.limit(0))

    def create_scope(self, bucket: str, scope: str, collection: str | None = None) -> None:
        held = self.get(bucket).scopes
        if collection is None and scope in held:
            raise Conflict(f"scope {scope} exists")
        held.setdefault(scope, set())
        if collection is not None:
            if collection in held[scope]:
                raise Conflict(f"collection {collection} exists")
            held[scope].add(collection)

    def drop_scope(self, bucket: str, scope: str, collection: str | None = None) -> None:
        held = self.get(bucket).scopes
        if scope not in held or (collection is not None and collection not in held[scope]):
            raise NotFound(f"{scope}.{collection or ''}")
        if collection is None:
            del held[scope]
        else:
            held[scope].discard(collection)

    def replace(self, name: str, frame: DataFrame, numbers: int = 1 << 40) -> None:
        b = self.get(name)
        first = b.seq
        b.frame, b.version, b.schema = frame, b.version + 1, None
        b.seq += numbers
        if b.mode == "document" or b.version % SETTLE_AFTER == 0:
            b.frame = settle(frame)
        if name in self.watched and b.mode == "document":
            changes.publish(changes.events_of(b.frame.filter(F.col("seq_no") >= first), name, F.lit(b.now).cast("timestamp") if b.now else None), self.watched[name])
        for (owner, _), d in self.indexes.items():
            if owner == name:
                d.data = self._materialise(d)

    def clock(self, name: str) -> kv.Clock:
        b = self.get(name)
        return kv.Clock(b.now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), b.seq)

    # -- rows

    def rows(self, name: str, scope: str | None = None, collection: str | None = None) -> DataFrame:
        """Live documents: META columns beside the documents' fields."""
        b = self.get(name)
        if b.mode == "table":
            return b.frame.select(F.col(f"`{b.key}`").cast("string").alias("_key"), *(F.col(f"`{c}`") for c in b.frame.columns))
        state = kv.live(b.frame, F.lit(b.now).cast("timestamp") if b.now else None)
        if scope is not None or collection is not None:
            if scope not in (None, *b.scopes) or not any(collection in (None, *c) for c in b.scopes.values()):
                raise NotFound(f"{name}.{scope}.{collection}")
            state = state.filter((F.col("scope") == (scope or "_default")) & (F.col("collection") == (collection or "_default")))
        if b.schema is None:
            b.schema = subdoc.infer(b.frame.filter("NOT deleted"))
        meta = [F.col("key").alias("_key"), F.col("cas").alias("_cas"), F.col("rev_id").alias("_rev"), F.col("expiry").alias("_expiry"), F.col("updated_at").alias("_updated_at")]
        if not b.schema.names:
            return state.select(*meta)
        return state.withColumn("_v", F.from_json("value", b.schema)).select(*meta, "_v.*")

    def live(self, source: S.Source) -> DataFrame:
        return self.rows(source.bucket, source.scope, source.collection)

    # -- indexes

    def _resolve(self, rows: DataFrame) -> Callable[[str], Column]:
        def go(path: str) -> Column:
            first, *rest = path.split(".")
            c = F.col(f"`{first}`")
            for p in rest:
                c = c.getField(p)
            return c if indexes.schema_has(rows, path) else F.lit(None)

        return go

    def _materialise(self, d: indexes.Definition) -> DataFrame:
        rows = self.rows(d.bucket)
        cond = None
        if d.where is not None:
            low = lowering.Lowering(self)
            kept = low.where(lowering.Scope(lowering.source_frame(rows, d.bucket), (d.bucket,)), d.where)
            rows = rows.join(kept.select(F.col(lowering.meta_name(d.bucket, "_key")).alias("_key")), "_key", "left_semi")
        return settle(indexes.build(rows, d, self._resolve(rows), cond))

    def create_index(self, s: S.CreateIndex) -> indexes.Definition | None:
        self.get(s.source.bucket)
        if s.primary:
            return None  # documents are found by key anyway
        at = s.source.bucket, s.name
        if at in self.indexes:
            raise Conflict(f"index {s.name} exists")
        keys = tuple(".".join(k.path.parts) for k in s.keys)
        d = indexes.Definition(s.name, s.source.bucket, keys, tuple(k for k, x in zip(keys, s.keys, strict=True) if x.array), tuple(".".join(p.parts) for p in s.include), s.where)
        d.data = self._materialise(d)
        self.indexes[at] = d
        return d

    def drop_index(self, bucket: str, name: str) -> None:
        if (bucket, name) not in self.indexes:
            raise NotFound(f"index {name}")
        del self.indexes[bucket, name]

    def chosen(self, q: S.Select) -> tuple[indexes.Definition, bool] | None:
        if q.source is None or q.joins:
            return None
        return indexes.choose(q, [d for (b, _), d in self.indexes.items() if b == q.source.bucket])

    def indexed(self, q: S.Select) -> DataFrame | None:
        """Rows that an index gives a query: all of them if it covers it, else its candidates' documents."""
        found = self.chosen(q)
        if found is None:
            return None
        d, covers = found
        if covers:
            flat = d.data
            if any("." in c for c in flat.columns):
                return None
            return flat
        alias = q.source.name
        low = lowering.Lowering(self)
        scope = lowering.Scope(lowering.source_frame(d.data.select("_key", *(F.col(f"`{k}`") for k in d.keys if "." not in k)), alias), (alias,))
        parts = [c for c in indexes._conjuncts(q.where) if indexes.conditions(c) and all(p.removeprefix(f"{alias}.") in d.keys for p in indexes.paths(c)) and all("." not in p.removeprefix(f"{alias}.") for p in indexes.paths(c))]
        if not parts:
            return None
        df = scope.df
        for c in parts:
            df = low.where(lowering.Scope(df, (alias,)), c)
        keys = df.select(F.col(lowering.meta_name(alias, "_key")).alias("_key")).distinct()
        return self.rows(q.source.bucket, q.source.scope, q.source.collection).join(keys, "_key", "left_semi")


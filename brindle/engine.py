"""The facade: buckets, statements, search, change streams, transactions, backups and gauges."""

from __future__ import annotations

import contextlib
import datetime as dt
import hashlib
import itertools
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Invalid, NotFound
from .operators import fts, kv, observe, replication, subdoc, transactions
from .plans import syntax as S
from .plans.lowering import Lowering, Scope, default_name, meta_name, source_frame
from .sources import backup
from .sources.catalog import Bucket, Catalog, Config


@dataclass
class Result:
    """Rows of a statement, and what is known of how they came about."""

    df: DataFrame
    metrics: dict[str, Any] = field(default_factory=dict)

    def rows(self) -> list[dict[str, Any]]:
        began = time.perf_counter()
        out = [r.asDict(recursive=True) for r in self.df.collect()]
        self.metrics |= {"result_count": len(out), "elapsed_ms": (time.perf_counter() - began) * 1e3}
        return out


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark, self.catalog = spark, Catalog(spark)
        self._prepared: dict[str, tuple[str, Any]] = {}
        self._search: dict[str, fts.Index] = {}
        #: of each search index: bucket, its version then, and what it was created with
        self._search_of: dict[str, tuple[str, int, tuple]] = {}
        self._audit: list[tuple] = []
        self._audit_ids = itertools.count(1)
        self._transactions: dict[str, transactions.Transaction] = {}

    # -- buckets

    def create_bucket(self, name: str, **config: Any) -> Bucket:
        made = self.catalog.create(name, Config(**config))
        self.log("bucket_create", name)
        return made

    def drop_bucket(self, name: str) -> None:
        self.catalog.drop(name)
        self.log("bucket_drop", name)

    def register(self, name: str, df: DataFrame, key: str) -> None:
        """Make a table a bucket."""
        self.catalog.add_table(name, df, key)

    def register_parquet(self, folder: str, keys: dict[str, str]) -> Engine:
        for name, key in keys.items():
            self.register(name, self.spark.read.parquet(f"{folder}/{name}.parquet"), key)
        return self

    def buckets(self) -> DataFrame:
        return self.spark.createDataFrame([(b.name, b.mode, b.key, json.dumps({s: sorted(c) for s, c in b.scopes.items()})) for b in self.catalog.buckets.values()], "name string, mode string, key string, scopes string")

    # -- statements

    def query(self, text: str, params: dict[str, Any] | list[Any] | None = None) -> DataFrame:
        return self.run(text, params).df

    def run(self, text: str, params: dict[str, Any] | list[Any] | None = None) -> Result:
        statement = S.parse(text)
        if isinstance(statement, S.Prepare):
            return Result(self._prepare(statement))
        if isinstance(statement, S.Execute):
            if statement.name not in self._prepared:
                raise NotFound(f"prepared statement {statement.name}")
            used = S.constant(statement.using) if statement.using is not None else None
            statement, params = self._prepared[statement.name][1], used if used is not None else params
        out = self._run(S.bind(statement, _named(params)))
        if isinstance(statement, S.CreateIndex) and not statement.primary:
            self.catalog.indexes[statement.source.bucket, statement.name].statement = text
        return out

    def _run(self, s: Any) -> Result:
        if isinstance(s, S.Select):
            found = self.catalog.chosen(s)
            return Result(Lowering(self.catalog).select(s), {"index_used": found[0].name if found else None})
        if isinstance(s, S.Explain):
            return Result(self.explain(s.statement))
        if isinstance(s, S.Insert):
            return Result(self._insert(s))
        if isinstance(s, S.Update):
            return Result(self._update(s))
        if isinstance(s, S.Delete):
            return Result(self._delete(s))
        if isinstance(s, S.CreateIndex):
            self.catalog.create_index(s)
            return Result(self._count("indexes", 1))
        if isinstance(s, S.DropIndex):
            self.catalog.drop_index(s.bucket, s.name)
            return Result(self._count("indexes", 1))
        raise Invalid(f"cannot run {type(s).__name__}")

    def _count(self, name: str, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], f"{name} bigint")

    def explain(self, s: Any) -> DataFrame:
        """The statement's operators, the index it takes, and Spark's plan."""
        tree: dict[str, Any] = {"statement": type(s).__name__.lower()}
        spark_plan = ""
        if isinstance(s, S.Select):
            found = self.catalog.chosen(s)
            tree |= {
                "source": s.source.bucket if s.source else None,
                "access": {"index": found[0].name, "covering": found[1]} if found else "scan",
                "joins": [f"{'left ' * j.left}{j.kind}" for j in s.joins],
                "filter": s.where is not None, "group": [default_name(g) for g in s.group], "order": [default_name(o.expr) for o in s.order], "limit": s.limit, "offset": s.offset, "distinct": s.distinct,
            }
            spark_plan = Lowering(self.catalog).select(s)._jdf.queryExecution().toString()
        return self.spark.createDataFrame([(json.dumps(tree, sort_keys=True), spark_plan)], "plan string, spark_plan string")

    def _prepare(self, s: S.Prepare) -> DataFrame:
        name = s.name or "p" + hashlib.sha256(s.text.encode()).hexdigest()[:12]
        if isinstance(s.statement, S.Select):  # a dry run with nulls finds what is wrong with it
            Lowering(self.catalog).select(S.bind(s.statement, _Nulls()))
        self._prepared[name] = (s.text, s.statement)
        return self.prepared().filter(F.col("name") == name)

    def prepared(self) -> DataFrame:
        return self.spark.createDataFrame([(n, t) for n, (t, _) in self._prepared.items()], "name string, statement string")

    # -- DML

    def _target(self, source: S.Source, where: Any, limit: int | None) -> tuple[Bucket, Scope]:
        b = self.catalog.get(source.bucket)
        scope = Scope(source_frame(self.catalog.live(source), source.name), (source.name,))
        df = Lowering(self.catalog).where(scope, where) if where is not None else scope.df
        df = df.orderBy(meta_name(source.name, "_key")).limit(limit) if limit is not None else df
        return b, Scope(df, scope.aliases)

    def _returning(self, items: tuple[S.Item, ...], scope: Scope, source: S.Source) -> DataFrame:
        if not items:
            return scope.df.agg(F.count(F.lit(1)).alias("mutations"))
        columns, star = Lowering(self.catalog).outputs(S.Select(items, source), scope)
        return scope.df.select(*star, *(c.alias(n) for n, c in columns))

    def _insert(self, s: S.Insert) -> DataFrame:
        b = self.catalog.get(s.source.bucket)
        rows = [(str(S.constant(k)), json.dumps(S.constant(v), ensure_ascii=False, sort_keys=True)) for k, v in s.rows]
        batch = self.spark.createDataFrame(rows if b.mode == "document" else list(dict(rows).items()), "key string, value string")
        if b.mode == "document":
            batch = batch.withColumns({"scope": F.lit(s.source.scope or "_default"), "collection": F.lit(s.source.collection or "_default")})
            self.catalog.replace(b.name, kv.upsert(b.frame, batch, self.catalog.clock(b.name), b.config.max_ttl or None, b.config.vbuckets))
        else:
            t = b.frame.schema
            new = batch.withColumn("_v", F.from_json("value", t)).select(*(F.coalesce(f"_v.`{c}`", F.col("key").try_cast(t[c].dataType)).alias(c) if c == b.key else F.col(f"_v.`{c}`").alias(c) for c in t.names))
            old = b.frame.join(new.select(b.key), b.key, "left_anti").select(*b.frame.columns)
            self.catalog.replace(b.name, old.unionByName(new))
        if not s.returning:
            return self._count("mutations", len(rows))
        rows_now = self.catalog.live(s.source).filter(F.col("_key").isin([r[0] for r in rows]))
        return self._returning(s.returning, Scope(source_frame(rows_now, s.source.name), (s.source.name,)), s.source)

    def _update(self, s: S.Update) -> DataFrame:
        b, hit = self._target(s.source, s.where, s.limit)
        a, low = s.source.name, Lowering(self.catalog)
        t, doc = hit.df.schema[a].dataType, F.col(f"`{a}`")
        strip = lambda p: list(p.parts[1:] if p.parts[0] == a and len(p.parts) > 1 else p.parts)
        for path, e in s.sets:
            doc = subdoc.put(doc, t, strip(path), low.col(e, hit))
        for path in s.unsets:
            if b.mode == "table":  # a table's columns stay
                doc = subdoc.put(doc, t, strip(path), F.lit(None))
            elif strip(path)[0] in t.names:
                doc = subdoc.remove(doc, ".".join(strip(path)))
        key = F.col(meta_name(a, "_key"))
        changed = hit.df.select(key.alias("_key"), doc.alias("_new"))
        if b.mode == "document":
            batch = changed.select(F.col("_key").alias("key"), F.to_json("_new").alias("value")).join(b.frame.select("key", "scope", "collection", "expiry", "flags"), "key")
            self.catalog.replace(b.name, kv.upsert(b.frame, batch, self.catalog.clock(b.name), partitions=b.config.vbuckets))
        else:
            old = b.frame.withColumn("_key", F.col(b.key).cast("string"))
            both = old.join(changed, "_key", "left")
            self.catalog.replace(b.name, both.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.`{c}`").cast(b.frame.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) for c in b.frame.columns)))
        out = changed.select(F.col("_new").alias(a), F.col("_key").alias(meta_name(a, "_key")))
        return self._returning(s.returning, Scope(out, (a,)), s.source)

    def _delete(self, s: S.Delete) -> DataFrame:
        b, hit = self._target(s.source, s.where, s.limit)
        out = self._returning(s.returning, hit, s.source)
        keys = hit.df.select(F.col(meta_name(s.source.name, "_key")).alias("key"))
        if b.mode == "document":
            self.catalog.replace(b.name, kv._change(b.frame, keys, self.catalog.clock(b.name), deleted=F.lit(True), value=F.lit(None)))
        else:
            self.catalog.replace(b.name, b.frame.join(keys, F.col(b.key).cast("string") == F.col("key"), "left_anti"))
        return out

    # -- documents

    def put(self, bucket: str, documents: dict[str, Any], ttl: int | None = None, cas: int | None = None) -> None:
        """Upsert documents; with ``cas``, replace one that has not changed."""
        self.log("documents_put", bucket, f"{len(documents)} documents")
        b, clock = self.catalog.get(bucket), self.catalog.clock(bucket)
        batch = self.spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in documents.items()], "key string, value string")
        if ttl:
            batch = batch.withColumn("expiry", F.lit(clock.now + dt.timedelta(seconds=ttl)).cast("timestamp"))
        if cas is not None:
            self.catalog.replace(bucket, kv.replace(b.frame, batch.withColumn("cas", F.lit(cas)), clock))
        else:
            self.catalog.replace(bucket, kv.upsert(b.frame, batch, clock, b.config.max_ttl or None, b.config.vbuckets))

    def get(self, bucket: str, key: str) -> Any:
        row = kv.get(self.catalog.get(bucket).frame, key).select("value").first()
        if row is None:
            raise NotFound(key)
        return json.loads(row["value"])

    def remove(self, bucket: str, key: str, cas: int | None = None) -> None:
        self.log("document_remove", bucket, key)
        keys = self.spark.createDataFrame([(key, cas)], "key string, cas bigint")
        self.catalog.replace(bucket, kv.delete(self.catalog.get(bucket).frame, keys if cas is not None else keys.drop("cas"), self.catalog.clock(bucket)))

    def apply(self, bucket: str, change, *args: Any, **kwargs: Any) -> None:
        """Run a function of ``operators.kv`` over a bucket's state."""
        self.catalog.replace(bucket, change(self.catalog.get(bucket).frame, *args, clock=self.catalog.clock(bucket), **kwargs))

    def list_documents(self, bucket: str, prefix: str = "", offset: int = 0, limit: int = 50) -> DataFrame:
        return kv.page(self.catalog.rows(bucket), prefix, offset, limit)

    def stats(self, bucket: str) -> DataFrame:
        return kv.stats(self.catalog.get(bucket).frame)

    # -- change events

    def changes(self, bucket: str, path: str) -> None:
        """From now on mutations of a document bucket are published to ``path`` after each statement or call."""
        self.catalog.get(bucket)
        self.catalog.watched[bucket] = path

    # -- scopes, and mutations of keys

    def create_scope(self, bucket: str, scope: str, collection: str | None = None) -> None:
        self.catalog.create_scope(bucket, scope, collection)
        self.log("scope_create", bucket, f"{scope}.{collection or ''}")

    def drop_scope(self, bucket: str, scope: str, collection: str | None = None) -> None:
        self.catalog.drop_scope(bucket, scope, collection)
        self.log("scope_drop", bucket, f"{scope}.{collection or ''}")

    def flush(self, bucket: str) -> None:
        self.catalog.flush(bucket)
        self.log("bucket_flush", bucket)

    def _keys(self, *keys: str) -> DataFrame:
        return self.spark.createDataFrame([(k,) for k in keys], "key string")

    def touch(self, bucket: str, key: str, ttl: int) -> None:
        clock = self.catalog.clock(bucket)
        self.apply(bucket, kv.touch, self._keys(key), F.lit(clock.now + dt.timedelta(seconds=ttl)).cast("timestamp"))

    def counter(self, bucket: str, key: str, delta: int = 1, initial: int | None = None) -> int:
        self.apply(bucket, kv.counter, self._keys(key), delta, initial=initial)
        return int(self.get(bucket, key))

    def append(self, bucket: str, key: str, text: str, front: bool = False) -> None:
        self.apply(bucket, kv.append, self._keys(key), text, front=front)

    # -- indexes and search

    def indexes(self) -> DataFrame:
        return self.spark.createDataFrame([(d.bucket, d.name, d.state, d.to_json()) for d in self.catalog.indexes.values()], "bucket string, name string, state string, definition string")

    def save_indexes(self, path: str) -> None:
        """Keep the definitions as JSON lines; data is built again from them."""
        self.indexes().coalesce(1).write.mode("overwrite").json(path)

    def load_indexes(self, path: str) -> int:
        """Build the indexes kept at ``path`` whose buckets are here; returns how many."""
        kept = self.spark.read.schema("bucket string, name string, state string, definition string").json(path).collect()
        todo = [json.loads(r["definition"])["statement"] for r in kept if r["bucket"] in self.catalog.buckets and (r["bucket"], r["name"]) not in self.catalog.indexes]
        for statement in todo:
            self.run(statement)
        return len(todo)

    def rebuild_index(self, bucket: str, name: str) -> None:
        d = self.catalog.indexes.get((bucket, name))
        if d is None:
            raise NotFound(f"index {name}")
        d.data = self.catalog._materialise(d)

    def create_search(self, name: str, bucket: str, fields: list[str] | None = None, analyzer: fts.Analyzer = fts.STANDARD, numeric: tuple[str, ...] = ()) -> fts.Index:
        """A stored index of the named fields, or of all that hold text; it follows mutations."""
        seen = (bucket, self.catalog.get(bucket).version, (fields, analyzer, numeric))
        self._search[name] = fts.build(self._searchable(bucket), "_key", fields, analyzer, numeric, name).stored()
        self._search_of[name] = seen
        return self._search[name]

    def _searchable(self, bucket: str) -> DataFrame:
        rows = self.catalog.rows(bucket)
        return rows.drop(*(c for c in ("_cas", "_rev", "_expiry", "_updated_at") if c in rows.columns))

    def _fresh(self, name: str) -> fts.Index:
        """The index, brought up to the bucket's state: documents written since are indexed again,
        and keys that no longer live leave.  Table buckets and new text fields ask for a rebuild."""
        bucket, version, (fields, analyzer, numeric) = self._search_of[name]
        b, index = self.catalog.get(bucket), self._search[name]
        if b.version == version:
            return index
        rows = self._searchable(bucket)
        found = tuple(f for f in (fields or fts.string_fields(rows.schema)) if f != "_key")
        held = dict(index.documents.dtypes)
        same = b.mode == "document" and found == index.fields and all(f in rows.columns and rows.select(f).dtypes[0][1] == held.get(f) for f in (*found, *numeric))
        if not same:
            return self.create_search(name, bucket, fields, analyzer, numeric)
        # numbers of a version's writes begin at 1 + version * 2^40
        changed = rows.join(b.frame.filter(F.col("seq_no") > version << 40).select(F.col("key").alias("_key")), "_key", "left_semi")
        gone = index.documents.select("key").join(rows.select(F.col("_key").alias("key")), "key", "left_anti")
        self._search[name], self._search_of[name] = fts.update(index, changed, "_key", gone).stored(), (bucket, b.version, (fields, analyzer, numeric))
        return self._search[name]

    def rebuild_search(self, name: str) -> fts.Index:
        if name not in self._search:
            raise NotFound(f"index {name}")
        bucket, _, (fields, analyzer, numeric) = self._search_of[name]
        return self.create_search(name, bucket, fields, analyzer, numeric)

    def drop_search(self, name: str) -> None:
        if self._search.pop(name, None) is None:
            raise NotFound(f"index {name}")
        del self._search_of[name]

    def searches(self) -> DataFrame:
        return self.spark.createDataFrame([(i.name, i.state, ",".join(i.fields)) for i in self._search.values()], "name string, state string, fields string")

    def search(self, request: dict[str, Any]) -> DataFrame:
        if request.get("index") not in self._search:
            raise NotFound(f"index {request.get('index')}")
        return fts.Search(self._fresh(request["index"])).top(request)

    # -- transactions, replication, backups, observation

    def begin(self, bucket: str, timeout_s: float = 15.0) -> transactions.Transaction:
        t = transactions.Transaction(bucket, self.catalog.get(bucket).frame, self.catalog.clock(bucket).now, timeout_s)
        self._transactions[t.txn_id] = t
        return t

    def commit(self, t: transactions.Transaction) -> None:
        b = self.catalog.get(t.bucket)
        self.catalog.replace(t.bucket, t.commit(b.frame, self.catalog.clock(t.bucket)))

    @contextlib.contextmanager
    def txn(self, bucket: str, timeout_s: float = 15.0) -> Iterator[transactions.Transaction]:
        t = self.begin(bucket, timeout_s)
        try:
            yield t
        except BaseException:
            t.rollback()
            raise
        self.commit(t)

    def transactions(self) -> DataFrame:
        return self.spark.createDataFrame([(t.txn_id, t.bucket, t.status, len(t.staged)) for t in self._transactions.values()], "txn_id string, bucket string, status string, staged int")

    def purge_transactions(self) -> None:
        self._transactions = {k: t for k, t in self._transactions.items() if t.status == "Active"}

    def replicate(self, source: DataFrame, bucket: str, mode: str | None = None, cluster: str = "source", expression: str | None = None) -> DataFrame:
        """Merge another cluster's documents into a bucket; returns what became of them."""
        b = self.catalog.get(bucket)
        sent = replication.outgoing(source, cluster, bucket, expression)
        how = mode or b.config.conflict
        told = replication.statistics(b.frame, sent, how)
        self.catalog.replace(bucket, replication.resolve(b.frame, sent, how))
        return told

    def backup(self, path: str, name: str = "backup", buckets: list[str] | None = None) -> str:
        return backup.write(self.catalog, path, name, buckets)

    def restore(self, path: str, backup_id: str, buckets: list[str] | None = None) -> list[str]:
        return backup.restore(self.catalog, path, backup_id, buckets)

    def backups(self, path: str) -> DataFrame:
        return backup.manifests(self.spark, path)

    def log(self, type_: str, bucket: str | None = None, detail: str = "", user: str = "", success: bool = True) -> None:
        self._audit.append((next(self._audit_ids), dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), type_, user, bucket, detail, success))
        del self._audit[:-10_000]

    def audit(self, limit: int = 100, offset: int = 0, type_: str | None = None, bucket: str | None = None) -> DataFrame:
        return observe.audit(self.spark.createDataFrame(self._audit, observe.AUDIT), limit, offset, type_, bucket)

    def metrics(self) -> DataFrame:
        return observe.gauges({n: b.frame for n, b in self.catalog.buckets.items() if b.mode == "document"}) if any(b.mode == "document" for b in self.catalog.buckets.values()) else self.spark.createDataFrame([], "metric string, bucket string, value double")


class _Nulls(dict):
    """Every parameter, as null (and as 0 where a number is asked for)."""

    def __contains__(self, key: object) -> bool:
        return True

    def __missing__(self, key: str) -> None:
        return None


def _named(params: dict[str, Any] | list[Any] | None) -> dict[str, Any]:
    if params is None:
        return {}
    if isinstance(params, (list, tuple)):
        return {str(i): v for i, v in enumerate(params, 1)}
    return {str(k).lstrip("$"): v for k, v in params.items()}


__all__ = ["Engine", "Result"]

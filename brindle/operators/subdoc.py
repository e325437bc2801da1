"""Reads and writes inside documents, by dotted path.

Values are typed structs here (see ``typed``): Catalyst sees the fields, so reads prune and
writes are ``withField`` and ``dropFields``.  Extended attributes are a map of JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def infer(df: DataFrame, value: str = "value") -> T.StructType:
    """The schema that all JSON objects of a text column have in common.  Fields whose types
    differ become strings."""
    spark = df.sparkSession
    texts = getattr(df.filter(F.col(value).startswith("{")).select(value)._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(spark._jsparkSession.read().json(texts), spark).schema


def typed(df: DataFrame, schema: str | T.StructType, value: str = "value") -> DataFrame:
    return df.withColumn(value, F.from_json(value, schema))


def lookup(value: Column | str, path: str) -> Column:
    """JSON text at a path of JSON text; array places are numbers."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.get_json_object(value, f"${steps}")


def exists(value: Column | str, path: str) -> Column:
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    v = value if isinstance(value, Column) else F.col(value)
    return F.coalesce(F.try_variant_get(F.try_parse_json(v), f"${steps}", "variant").isNotNull(), F.lit(False))


def count(value: Column | str, path: str) -> Column:
    """Elements of an array or fields of an object."""
    at = lookup(value, path)
    return F.coalesce(F.json_array_length(at), F.array_size(F.json_object_keys(at)))


def put(c: Column, t: T.StructType, parts: list[str], value: Column) -> Column:
    """Set a field, making its parents."""
    head, rest = parts[0], parts[1:]
    if rest:
        inner = t[head].dataType if head in t.names else None
        if isinstance(inner, T.StructType):
            value = F.when(c.getField(head).isNull(), _nest(rest, value, inner)).otherwise(put(c.getField(head), inner, rest, value))
        else:
            value = _nest(rest, value, None)
    return c.withField(f"`{head}`", value)


def _nest(parts: list[str], value: Column, t: T.StructType | None) -> Column:
    for p in reversed(parts[1:]):
        value = F.struct(value.alias(p))
    if t is None:
        return F.struct(value.alias(parts[0]))
    names = [*t.names, *([parts[0]] if parts[0] not in t.names else [])]
    return F.struct(*((value if n == parts[0] else F.lit(None).cast(t[n].dataType)).alias(n) for n in names))


def remove(c: Column, path: str) -> Column:
    return c.dropFields(".".join(f"`{p}`" for p in path.split(".")))


def push(c: Column, path: str, value: Column, front: bool = False) -> Column:
    """Add to an array, at its end or front."""
    at = c
    for p in path.split("."):
        at = at.getField(p)
    return c.withField(path, (F.array_prepend if front else F.array_append)(at, value))


def add_unique(c: Column, path: str, value: Column) -> Column:
    at = c
    for p in path.split("."):
        at = at.getField(p)
    return c.withField(path, F.when(F.array_contains(at, value), at).otherwise(F.array_append(at, value)))


def insert_at(c: Column, path: str, place: int, value: Column) -> Column:
    at = c
    for p in path.split("."):
        at = at.getField(p)
    return c.withField(path, F.array_insert(at, place + 1 if place >= 0 else place, value))


def add(c: Column, path: str, delta: int) -> Column:
    at = c
    for p in path.split("."):
        at = at.getField(p)
    return c.withField(path, F.coalesce(at, F.lit(0)) + delta)


def multi_lookup(df: DataFrame, value: str, paths: list[str], key: str = "key") -> DataFrame:
    """One row for each document: what each path holds, and whether it is there."""
    return df.select(key, *(c for p in paths for c in (lookup(F.col(value), p).alias(p), exists(value, p).alias(f"{p}?"))))


def xattr_put(xattrs: Column | str, name: str, value: Column) -> Column:
    m = F.col(xattrs) if isinstance(xattrs, str) else xattrs
    return F.map_concat(F.map_filter(m, lambda k, v: k != name), F.create_map(F.lit(name), value.cast("string")))


def xattr_remove(xattrs: Column | str, name: str) -> Column:
    return F.map_filter(xattrs, lambda k, v: k != name)


def xattr_get(xattrs: Column | str, name: str) -> Column:
    m = F.col(xattrs) if isinstance(xattrs, str) else xattrs
    return virtual() if name == "$document" else m[name]


def xattr_names(xattrs: Column | str) -> Column:
    return F.array_sort(F.map_keys(xattrs))


def virtual() -> Column:
    """The virtual attribute that describes the document itself."""
    return F.to_json(F.struct(F.col("cas").alias("CAS"), F.col("seq_no").alias("seqno"), F.coalesce(F.unix_timestamp("expiry"), F.lit(0)).alias("exptime"), "flags", F.octet_length("value").alias("value_bytes"), F.lit(["json"]).alias("datatype"), "deleted", F.unix_timestamp("updated_at").alias("last_modified"), F.col("rev_id").alias("revid")))

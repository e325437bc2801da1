"""From syntax tree to DataFrame: names become columns, clauses become DataFrame operators.

Each source is one struct column named after its alias, holding the document's fields;
``__key``-like helper columns beside it carry what META() and SELECT * need.  Catalyst
prunes the structs' unused fields down to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import registry as R
from . import syntax as S

META = ("_key", "_cas", "_rev", "_expiry", "_updated_at")


@dataclass(frozen=True)
class Scope:
    """Sources in view: alias -> (fields, whether its columns are in one struct)."""

    df: DataFrame
    aliases: tuple[str, ...]
    outputs: tuple[str, ...] = ()

    def type_of(self, c: Column) -> T.DataType:
        return self.df.select(c).schema[0].dataType


def meta_name(alias: str, field: str) -> str:
    return f"__{alias}{field}"


def source_frame(df: DataFrame, alias: str) -> DataFrame:
    """A bucket's live rows as one struct and its helper columns."""
    fields = [c for c in df.columns if c not in META]
    helpers = [F.col(c).alias(meta_name(alias, c)) for c in META if c in df.columns]
    return df.select(F.struct(*(F.col(f"`{c}`") for c in fields)).alias(alias), *helpers)


def _fields(scope: Scope, alias: str) -> list[str]:
    t = scope.df.schema[alias].dataType
    return t.names if isinstance(t, T.StructType) else []


def _dig(c: Column, t: T.DataType, parts: tuple[str, ...], name: str) -> Column:
    for p in parts:
        if isinstance(t, T.StructType):
            if p not in t.names:
                return F.lit(None)
            c, t = c.getField(p), t[p].dataType
        elif isinstance(t, T.MapType):
            c, t = c.getItem(p), t.valueType
        elif isinstance(t, T.ArrayType) and p.isdigit():
            c, t = F.get(c, F.lit(int(p))), t.elementType
        elif isinstance(t, T.VariantType):
            c = F.try_variant_get(c, f"$.{p}", "variant")
        else:
            return F.lit(None)
    return c


def path_column(scope: Scope, path: S.Path) -> Column:
    """Alias first, then an output of an aggregation, then a field of exactly one source.
    A field that no document has is missing, and so NULL."""
    first, rest = path.parts[0], path.parts[1:]
    if first in scope.aliases:
        return _dig(F.col(f"`{first}`"), scope.df.schema[first].dataType, rest, first)
    if first in scope.outputs:
        return _dig(F.col(f"`{first}`"), scope.df.schema[first].dataType, rest, first)
    owners = [a for a in scope.aliases if first in _fields(scope, a)]
    if len(owners) > 1:
        raise S.QueryError(f"{first} is a field of {', '.join(owners)}: qualify it")
    if owners:
        return _dig(F.col(f"`{owners[0]}`"), scope.df.schema[owners[0]].dataType, path.parts, first)
    if first in META and len(scope.aliases) and meta_name(scope.aliases[0], first) in scope.df.columns:
        return F.col(meta_name(scope.aliases[0], first))
    return F.lit(None)


def aggregates_of(node: Any, out: dict[S.Aggregate, str] | None = None) -> dict[S.Aggregate, str]:
    out = {} if out is None else out
    if isinstance(node, S.Aggregate):
        out.setdefault(node, f"__agg{len(out)}")
    elif isinstance(node, tuple):
        for x in node:
            aggregates_of(x, out)
    elif hasattr(node, "__dataclass_fields__") and not isinstance(node, S.Select):
        for f in node.__dataclass_fields__:
            aggregates_of(getattr(node, f), out)
    return out


class Lowering:
    """Lowers one statement against a catalog (``live(source)`` gives a bucket's rows)."""

    def __init__(self, catalog: Any):
        self.catalog = catalog
        self.spark = catalog.spark

    # -- expressions

    def col(self, e: Any, scope: Scope, aggs: dict[S.Aggregate, str] | None = None) -> Column:
        go = lambda x: self.col(x, scope, aggs)
        if isinstance(e, S.Literal):
            return F.lit(e.value)
        if isinstance(e, S.Path):
            return path_column(scope, e)
        if isinstance(e, S.Meta):
            alias = e.alias or scope.aliases[0]
            if alias not in scope.aliases:
                raise S.QueryError(f"no source is named {alias}")
            field = {None: "_key", "id": "_key", "cas": "_cas", "rev": "_rev", "expiration": "_expiry"}.get(e.field)
            if field is None:
                raise S.QueryError(f"META() has no {e.field}")
            name = meta_name(alias, field)
            return F.col(name) if name in scope.df.columns else F.lit(None)
        if isinstance(e, S.Aggregate):
            if not aggs or e not in aggs:
                raise S.QueryError(f"{e.name} is not allowed here")
            return F.col(aggs[e])
        if isinstance(e, S.Call):
            if e.name == "META":
                return F.struct(self.col(S.Meta(None, "id"), scope).alias("id"))
            if e.name not in R.FUNCTIONS:
                raise S.QueryError(f"unknown function {e.name}")
            try:
                return R.call(e.name, [R.Arg(go(a), scope.df) for a in e.args])
            except ValueError as error:
                raise S.QueryError(str(error)) from error
        if isinstance(e, S.MakeArray):
            return F.array(*map(go, e.items))
        if isinstance(e, S.MakeObject):
            return F.struct(*(go(v).alias(k) for k, v in e.items)) if e.items else F.create_map()
        if isinstance(e, S.Unary):
            a = go(e.arg)
            if e.op == "not":
                return ~a
            if e.op == "-":
                return -a
            missing = a.isNull()
            if isinstance(scope.type_of(a), T.VariantType):
                missing = missing | F.is_variant_null(a)
            return missing if e.op == "is null" else ~missing
        if isinstance(e, S.Between):
            a, low = self._pair(e.arg, e.low, scope, aggs)
            b, high = self._pair(e.arg, e.high, scope, aggs)
            return (a >= low) & (b <= high)
        if isinstance(e, S.InList):
            pairs = [self._pair(e.arg, x, scope, aggs) for x in e.items]
            return reduce(lambda x, y: x | y, [a == b for a, b in pairs]) if pairs else F.lit(False)
        if isinstance(e, S.Scalar):
            return self.select(e.query).scalar()
        if isinstance(e, S.Binary):
            if e.op in ("and", "or"):
                a, b = go(e.left), go(e.right)
                return a & b if e.op == "and" else a | b
            a, b = self._pair(e.left, e.right, scope, aggs)
            if e.op == "!=":
                return ~a.eqNullSafe(b)
            if e.op == "like":
                return F.like(a.cast("string"), b)
            if e.op == "||":
                return F.concat(a.cast("string"), b.cast("string"))
            return {"=": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "+": a + b, "-": a - b, "*": a * b, "/": R.finite(a / F.nullif(b, F.lit(0))), "%": a % F.nullif(b, F.lit(0))}[e.op]
        if isinstance(e, (S.InQuery, S.Exists)):
            raise S.QueryError("a subquery is only allowed as a conjunct of WHERE")
        if isinstance(e, S.Param):
            raise S.QueryError(f"parameter ${e.name} has no value")
        raise S.QueryError(f"cannot lower {e!r}")

    def _pair(self, left: Any, right: Any, scope: Scope, aggs: dict | None) -> tuple[Column, Column]:
        """Two operands to compare.  A number never equals a string: where static types of
        column and literal differ, the literal is tried as the column's type."""
        a, b = self.col(left, scope, aggs), self.col(right, scope, aggs)
        out = []
        for x, y, other in ((a, b, right), (b, a, left)):
            tx = scope.type_of(x)
            if isinstance(tx, T.VariantType):
                ty = scope.type_of(y)
                x = F.try_variant_get(x, "$", "double" if isinstance(ty, T.NumericType) else "boolean" if isinstance(ty, T.BooleanType) else "string")
            elif isinstance(tx, T.StringType) and isinstance(ty := scope.type_of(y), T.NumericType):
                x = x.try_cast("double")
            elif isinstance(tx, T.StringType) and isinstance(scope.type_of(y), T.BooleanType):
                x = x.try_cast("boolean")
            out.append(x)
        return out[0], out[1]

    # -- clauses

    def where(self, scope: Scope, e: Any, aggs: dict | None = None) -> DataFrame:
        """Filters conjunct by conjunct; subquery predicates become semi and anti joins."""
        df = scope.df
        for part in _conjuncts(e):
            inner, no = part, False
            while isinstance(inner, S.Unary) and inner.op == "not":
                inner, no = inner.arg, not no
            now = Scope(df, scope.aliases, scope.outputs)
            if isinstance(inner, S.InQuery):
                sub = self.select(inner.query)
                if len(sub.columns) != 1:
                    raise S.QueryError("a subquery after IN has one column")
                sub = sub.select(F.col(f"`{sub.columns[0]}`").alias("__in")).filter("__in IS NOT NULL").distinct()
                df = df.join(sub, self.col(inner.arg, now, aggs) == F.col("__in"), "left_anti" if no else "left_semi")
            elif isinstance(inner, S.Exists):
                found = self.select(inner.query).limit(1).select(F.lit(1).alias("__any"))
                df = df.join(F.broadcast(found), F.lit(True), "left_anti" if no else "left_semi")
            else:
                df = df.filter(self.col(part, now, aggs))
        return df

    def joined(self, scope: Scope, join: S.Join) -> Scope:
        left = "left" if join.left else "inner"
        if join.kind == "unnest":
            c = path_column(scope, join.path)
            if not isinstance(scope.type_of(c), T.ArrayType):
                c = F.array().cast("array<string>")
            df = scope.df.select("*", (F.explode_outer if join.left else F.explode)(c).alias(join.alias))
            return Scope(df, (*scope.aliases, join.alias))
        right = source_frame(self.catalog.live(join.source), join.alias)
        both = Scope(scope.df.join(right, F.lit(True)), (*scope.aliases, join.alias))
        if join.kind == "join":
            return Scope(scope.df.join(right, self.col(join.on, both), left), both.aliases)
        # NEST: gather the right side by its key first, then an equi-join
        pairs, rest = [], []
        for part in _conjuncts(join.on):
            sides = _sides(part, scope.aliases, join.alias, scope, both) if isinstance(part, S.Binary) and part.op == "=" else None
            (pairs if sides else rest).append(sides or part)
        if not pairs or rest:
            raise S.QueryError("NEST needs equalities between both sides")
        own = Scope(right, (join.alias,))
        keys = [self.col(r, own).alias(f"__n{i}") for i, (_, r) in enumerate(pairs)]
        nested = right.select(*keys, join.alias).groupBy(*(f"__n{i}" for i in range(len(keys)))).agg(F.array_sort(F.collect_list(join.alias)).alias(join.alias))
        cond = reduce(lambda x, y: x & y, [self.col(l, scope) == F.col(f"__n{i}") for i, (l, _) in enumerate(pairs)])
        df = scope.df.join(nested, cond, left).drop(*(f"__n{i}" for i in range(len(keys))))
        return Scope(df, (*scope.aliases, join.alias))

    def select(self, q: S.Select) -> DataFrame:
        if q.source is None:
            scope = Scope(self.spark.range(1).select(F.lit(1).alias("__one")), ())
        else:
            live = self.catalog.indexed(q) if not q.joins else None
            scope = Scope(source_frame(live if live is not None else self.catalog.live(q.source), q.source.name), (q.source.name,))
        for j in q.joins:
            scope = self.joined(scope, j)
        if q.where is not None:
            scope = Scope(self.where(scope, q.where), scope.aliases)
        aggs = aggregates_of((q.items, q.having, q.order))
        if aggs or q.group:
            return self.grouped(q, scope, aggs)
        columns, star = self.outputs(q, scope)
        named = dict(columns)
        keys = []
        for o in q.order:
            alias = o.expr.parts[0] if isinstance(o.expr, S.Path) and len(o.expr.parts) == 1 else None
            c = named[alias] if alias in named else self.col(o.expr, scope)
            keys.append(c.desc_nulls_first() if o.down else c.asc_nulls_last())
        df = scope.df
        if q.distinct:
            df = df.select(*star, *(c.alias(n) for n, c in columns)).distinct()
            if q.order:
                out = Scope(df, (), tuple(df.columns))
                df = df.orderBy(*self.order(q, out, {}))
            return _page(df, q)
        if keys:
            df = df.orderBy(*keys)
        df = _page(df, q)
        return df.select(*star, *(c.alias(n) for n, c in columns))

    def order(self, q: S.Select, out: Scope, aggs: dict) -> list[Column]:
        keys = []
        for o in q.order:
            text = default_name(o.expr)
            c = F.col(f"`{text}`") if text in out.df.columns else self.col(o.expr, out, aggs)
            keys.append(c.desc_nulls_first() if o.down else c.asc_nulls_last())
        return keys

    def outputs(self, q: S.Select, scope: Scope) -> tuple[list[tuple[str, Column]], list[Column]]:
        """Named columns, and those of ``*``: the envelope of one source, one object for each of more."""
        columns, star = [], []
        for i, item in enumerate(q.items):
            if item.expr is None:
                if len(scope.aliases) == 1:
                    a = scope.aliases[0]
                    for m in META:
                        n = meta_name(a, m)
                        star.append((F.col(n) if n in scope.df.columns else F.lit(None)).alias(m))
                    star.append(F.col(f"`{a}`").alias("doc"))
                else:
                    star += [F.col(f"`{a}`") for a in scope.aliases]
            else:
                name = item.alias or (f"${i + 1}" if q.source is None else default_name(item.expr))
                columns.append((name, self.col(item.expr, scope)))
        return columns, star

    def grouped(self, q: S.Select, scope: Scope, aggs: dict[S.Aggregate, str]) -> DataFrame:
        made = []
        for a, name in aggs.items():
            made.append(self.aggregate(a, scope).alias(name))
        keys = {default_name(g): self.col(g, scope) for g in q.group}
        firsts, shown = [], []
        # one document of a group speaks for it: the first by key, whatever the partitions
        known = [meta_name(a, "_key") for a in scope.aliases if meta_name(a, "_key") in scope.df.columns]
        first = (lambda c: F.min_by(c, F.struct(*(F.col(k) for k in known)))) if known else F.first
        for i, item in enumerate(q.items):
            if item.expr is None:
                firsts += [first(F.col(f"`{a}`")).alias(f"__first{a}") for a in scope.aliases]
                shown += [(a, F.col(f"`__first{a}`")) for a in scope.aliases]
                continue
            name = item.alias or default_name(item.expr)
            if not aggregates_of(item.expr):
                if item.expr in q.group:
                    shown.append((name, F.col(f"`{default_name(item.expr)}`")))
                else:  # the value of some document of the group
                    firsts.append(first(self.col(item.expr, scope)).alias(f"__first{i}"))
                    shown.append((name, F.col(f"__first{i}")))
            else:
                shown.append((name, item.expr))
        df = scope.df.groupBy(*(c.alias(n) for n, c in keys.items())).agg(*made, *firsts) if keys else scope.df.agg(*(made or [F.count(F.lit(1)).alias("__n")]), *firsts)
        inner = Scope(df, (), tuple(df.columns))
        columns = [(n, c if isinstance(c, Column) else self.col(c, inner, aggs)) for n, c in shown]
        picked = {item.expr for item in q.items}
        hidden = [default_name(g) for g in q.group if g not in picked]
        out = df.select(*(c.alias(n) for n, c in columns), *(F.col(f"`{n}`") for n in hidden), *(F.col(n) for n in aggs.values()))
        view = Scope(out, (), tuple(out.columns))
        if q.having is not None:
            out = self.where(view, q.having, aggs)
        if q.order:
            out = out.orderBy(*self.order(q, Scope(out, (), tuple(out.columns)), aggs))
        out = out.drop(*aggs.values())
        out = out.distinct() if q.distinct else out
        return _page(out, q)

    def aggregate(self, a: S.Aggregate, scope: Scope) -> Column:
        if a.name == "COUNT":
            return F.count(F.lit(1)) if a.arg is None or isinstance(a.arg, S.Literal) else F.count(self.col(a.arg, scope))
        if a.arg is None:
            raise S.QueryError(f"{a.name} needs an argument")
        c = self.col(a.arg, scope)
        if a.name in ("SUM", "AVG"):
            n = R.number(R.Arg(c, scope.df))
            return F.coalesce(F.sum(n), F.lit(0.0)) if a.name == "SUM" else F.avg(n)
        if isinstance(scope.type_of(c), T.VariantType):
            pick = F.min_by if a.name == "MIN" else F.max_by
            return pick(F.to_json(c), F.when(c.isNotNull() & ~F.is_variant_null(c), R.sort_key(c)))
        return F.min(c) if a.name == "MIN" else F.max(c)


def _page(df: DataFrame, q: S.Select) -> DataFrame:
    if q.offset:
        df = df.offset(q.offset)
    return df if q.limit is None else df.limit(q.limit)


def _conjuncts(e: Any) -> list[Any]:
    return [*_conjuncts(e.left), *_conjuncts(e.right)] if isinstance(e, S.Binary) and e.op == "and" else [e]


def _mentions(e: Any, scope: Scope) -> set[str]:
    if isinstance(e, S.Meta):
        return {e.alias or scope.aliases[0]}
    if isinstance(e, S.Path):
        return {e.parts[0]} if e.parts[0] in scope.aliases else {a for a in scope.aliases if e.parts[0] in _fields(scope, a)}
    if isinstance(e, tuple):
        return set().union(*(_mentions(x, scope) for x in e)) if e else set()
    if hasattr(e, "__dataclass_fields__"):
        return set().union(*(_mentions(getattr(e, f), scope) for f in e.__dataclass_fields__))
    return set()


def _sides(e: S.Binary, left: tuple[str, ...], right: str, scope: Scope, both: Scope) -> tuple[Any, Any] | None:
    a, b = _mentions(e.left, both), _mentions(e.right, both)
    if a <= set(left) and b == {right}:
        return e.left, e.right
    if b <= set(left) and a == {right}:
        return e.right, e.left
    return None


def default_name(e: Any) -> str:
    """What an item without AS is called."""
    if isinstance(e, S.Path):
        return ".".join(e.parts)
    if isinstance(e, S.Meta):
        return "META().id" if e.field in (None, "id") else f"META().{e.field}"
    if isinstance(e, S.Aggregate):
        return f"{e.name}({'*' if e.arg is None else default_name(e.arg)})"
    if isinstance(e, S.Call):
        return f"{e.name}({', '.join(map(default_name, e.args))})"
    if isinstance(e, S.Literal):
        return S.to_json(e.value)
    if isinstance(e, S.Scalar):
        return "(SUBQUERY)"
    if isinstance(e, S.Binary):
        return f"{default_name(e.left)} {e.op} {default_name(e.right)}"
    return type(e).__name__.lower()

"""Secondary indexes as materialised, range-sorted projections.

An index holds its keys, included paths and the document key, sorted by its leading key, so
that file statistics prune equality, range and prefix scans.  The planner takes an index
whose leading key has a comparison; it prefers one that covers the query, then one with more
keys under conditions, then the narrowest.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import syntax as S


@dataclass
class Definition:
    name: str
    bucket: str
    keys: tuple[str, ...]
    array: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    where: Any = None
    statement: str = ""
    state: str = "Online"
    data: DataFrame | None = field(default=None, repr=False)

    def to_json(self) -> str:
        """What is kept of a definition; its data can be built again."""
        return json.dumps({k: getattr(self, k) for k in ("name", "bucket", "keys", "array", "include", "statement", "state")}, sort_keys=True)


def build(rows: DataFrame, d: Definition, resolve: Callable[[str], Column], cond: Column | None = None, partitions: int | None = None) -> DataFrame:
    """``rows`` has ``_key`` and the documents' fields; ``cond`` is the partial index's WHERE."""
    rows = rows.filter(cond) if cond is not None else rows
    columns = []
    for k in d.keys:
        c = resolve(k)
        columns.append((F.explode(c) if k in d.array else c).alias(k))
    out = rows.select("_key", *columns, *(resolve(p).alias(p) for p in d.include if p not in d.keys))
    lead = F.col(f"`{d.keys[0]}`")
    spread = out.repartitionByRange(partitions, lead) if partitions else out.repartitionByRange(lead)
    return spread.sortWithinPartitions(lead)


def eq(index: DataFrame, key: str, value: Any) -> DataFrame:
    return index.filter(F.col(f"`{key}`") == value)


def between(index: DataFrame, key: str, low: Any = None, high: Any = None, inclusive: tuple[bool, bool] = (True, True)) -> DataFrame:
    c = F.col(f"`{key}`")
    if low is not None:
        index = index.filter(c >= low if inclusive[0] else c > low)
    if high is not None:
        index = index.filter(c <= high if inclusive[1] else c < high)
    return index


def prefix(index: DataFrame, keys: tuple[str, ...], values: tuple[Any, ...]) -> DataFrame:
    """Rows whose leading keys have these values."""
    for k, v in zip(keys, values, strict=False):
        index = index.filter(F.col(f"`{k}`") == v)
    return index


def conditions(e: Any) -> dict[str, str]:
    """Paths under a comparison with a constant, in a conjunction."""
    out: dict[str, str] = {}
    if isinstance(e, S.Binary) and e.op == "and":
        return conditions(e.left) | conditions(e.right)
    if isinstance(e, S.Binary) and e.op in ("=", "<", "<=", ">", ">="):
        for a, b in ((e.left, e.right), (e.right, e.left)):
            if isinstance(a, S.Path) and isinstance(b, S.Literal):
                out[".".join(a.parts)] = e.op
    if isinstance(e, (S.Between, S.InList)) and isinstance(e.arg, S.Path):
        out[".".join(e.arg.parts)] = "range"
    return out


def paths(e: Any) -> set[str]:
    if isinstance(e, S.Path):
        return {".".join(e.parts)}
    if isinstance(e, tuple):
        return set().union(*map(paths, e)) if e else set()
    if hasattr(e, "__dataclass_fields__"):
        return set().union(*(paths(getattr(e, f)) for f in e.__dataclass_fields__))
    return set()


def choose(q: S.Select, found: list[Definition]) -> tuple[Definition, bool] | None:
    """The best index for a query on one bucket, and whether it covers it."""
    if q.where is None or any(i.expr is None for i in q.items):
        star = True
    else:
        star = False
    alias = q.source.name
    short = lambda p: p.removeprefix(f"{alias}.")
    under = {short(p) for p in conditions(q.where)} if q.where is not None else set()
    needed = {short(p) for p in paths((q.items, q.where, q.group, q.having, q.order))} - {i.alias for i in q.items if i.alias}
    ranked = []
    for d in found:
        if d.state != "Online" or d.array or d.keys[0] not in under or (q.index and d.name != q.index):
            continue
        if d.where is not None and not _implied(d.where, q.where):
            continue
        covers = not star and needed <= {*d.keys, *d.include}
        hits = 0
        for k in d.keys:
            if k not in under:
                break
            hits += 1
        ranked.append(((not covers, -hits, len(d.keys), d.name), d, covers))
    return min(ranked, key=lambda r: r[0])[1:] if ranked else None


def _conjuncts(e: Any) -> list[Any]:
    return [*_conjuncts(e.left), *_conjuncts(e.right)] if isinstance(e, S.Binary) and e.op == "and" else [e]


def _implied(partial: Any, where: Any) -> bool:
    """Every condition of a partial index is one of the query's."""
    return all(c in _conjuncts(where) for c in _conjuncts(partial))


def schema_has(df: DataFrame, path: str) -> bool:
    t: T.DataType = df.schema
    for p in path.split("."):
        if not isinstance(t, T.StructType) or p not in t.names:
            return False
        t = t[p].dataType
    return True

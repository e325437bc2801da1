"""The function table: name -> how many arguments, and the Column they make.

Arguments of a wrong type give NULL, never an error; types are those of the analysed
columns.  Numbers that JSON cannot hold (infinite, not a number) become NULL.  All
functions are built from Spark's own expressions, so they stay in generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Arg:
    """A column and where to find out its type."""

    col: Column
    df: DataFrame

    @property
    def type(self) -> T.DataType:
        return self.df.select(self.col).schema[0].dataType

    @property
    def kind(self) -> str:
        t = self.type
        if isinstance(t, T.StringType):
            return "string"
        if isinstance(t, T.BooleanType):
            return "boolean"
        if isinstance(t, T.NumericType):
            return "number"
        if isinstance(t, T.ArrayType):
            return "array"
        if isinstance(t, (T.StructType, T.MapType)):
            return "object"
        if isinstance(t, T.NullType):
            return "null"
        if isinstance(t, T.VariantType):
            return "variant"
        return "string" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "other"


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def text(a: Arg) -> Column:
    return a.col.cast("string") if a.kind == "string" else F.try_variant_get(a.col, "$", "string") if a.kind == "variant" else _null("string")


def number(a: Arg) -> Column:
    return a.col.cast("double") if a.kind == "number" else F.try_variant_get(a.col, "$", "double") if a.kind == "variant" else _null("double")


def array(a: Arg) -> Column:
    return a.col if a.kind == "array" else _null("array<string>")


def as_json(a: Arg) -> Column:
    """JSON text: strings as they are, null as ``null``."""
    kind = a.kind
    if kind == "null":
        return F.lit("null")
    plain = F.to_json(a.col) if kind in ("array", "object", "variant") else a.col.cast("string")
    return F.coalesce(plain, F.lit("null"))


def finite(c: Column) -> Column:
    return F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), None).otherwise(c)


def _math(f: Callable[[Column], Column]) -> Callable[[Arg], Column]:
    return lambda a: finite(f(number(a)).cast("double"))


def _scaled(way: Callable[[Column], Column]) -> Callable[..., Column]:
    """Round or cut at a decimal; the factor is 10 to the number of places."""

    def make(a: Arg, d: Arg | None = None) -> Column:
        n = number(a)
        factor = F.pow(F.lit(10.0), number(d)) if d else F.lit(1.0)
        return finite(way(n * factor) / factor)

    return make


def _substr(s: Arg, at: Arg, size: Arg | None = None) -> Column:
    start = number(at).cast("int") + 1
    return F.substring(text(s), start, number(size).cast("int") if size else F.lit(2**31 - 1))


def _trim(pattern: str) -> Callable[[Arg], Column]:
    return lambda a: F.regexp_replace(text(a), pattern, "")


def _concat(*args: Arg) -> Column:
    return F.concat_ws("", *(F.when(a.col.isNotNull(), as_json(a)) for a in args))


def _split(s: Arg, sep: Arg | None = None) -> Column:
    mark = text(sep) if sep else F.lit(",")
    return F.split(text(s), F.concat(F.lit(r"\Q"), mark, F.lit(r"\E")), -1)


def _to_number(a: Arg) -> Column:
    if a.kind == "string":
        return F.when(a.col.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), a.col.try_cast("double"))
    return number(a)


def _to_boolean(a: Arg) -> Column:
    kind = a.kind
    if kind == "boolean":
        return F.coalesce(a.col, F.lit(False))
    if kind == "number":
        return F.coalesce(a.col != 0, F.lit(False))
    if kind == "string":
        return F.coalesce(~a.col.cast("string").isin("", "false", "0"), F.lit(False))
    return a.col.isNotNull() if kind in ("array", "object") else F.lit(False)


def variant_kind(v: Column) -> Column:
    """The JSON type name of a variant value."""
    s = F.schema_of_variant(v)
    return F.when(v.isNull() | F.is_variant_null(v), "null").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("number")


def _type(a: Arg) -> Column:
    if a.kind == "variant":
        return variant_kind(a.col)
    return F.when(a.col.isNull(), "null").otherwise(a.kind)


def _is(kind: str) -> Callable[[Arg], Column]:
    return lambda a: _type(a) == kind


def _elements(a: Arg) -> str:
    t = a.type
    return t.elementType.simpleString() if isinstance(t, T.ArrayType) else "string"


def _array_concat(*args: Arg) -> Column:
    held = [F.coalesce(a.col, F.array().cast(a.type)) for a in args if a.kind == "array"]
    return F.concat(*held) if held else F.array()


def _array_contains(a: Arg, v: Arg) -> Column:
    return F.when(array(a).isNotNull(), F.coalesce(F.array_contains(array(a), v.col), F.lit(False)))


def _flatten(a: Arg, depth: Arg | None = None) -> Column:
    levels = 1
    if depth is not None:
        levels = int(depth.df.sparkSession.range(1).select(depth.col).first()[0])
    out, t = array(a), a.type
    while levels > 0 and isinstance(t, T.ArrayType) and isinstance(t.elementType, T.ArrayType):
        out, t, levels = F.flatten(out), t.elementType, levels - 1
    return out


def _numbers(a: Arg) -> Column:
    return F.filter(F.transform(array(a), lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def _array_sum(a: Arg) -> Column:
    return F.aggregate(_numbers(a), F.lit(0.0), lambda s, x: s + x)


def _array_avg(a: Arg) -> Column:
    return F.when(F.size(_numbers(a)) > 0, _array_sum(a) / F.size(_numbers(a)))


def _as_map(a: Arg) -> Column:
    """An object as a map of JSON text by name."""
    t = a.type
    if isinstance(t, T.StructType):
        pairs = [x for f in t.fields for x in (F.lit(f.name), as_json(Arg(a.col.getField(f.name), a.df)))]
        return F.map_filter(F.create_map(*pairs), lambda k, v: v != "null") if pairs else F.create_map().cast("map<string,string>")
    if isinstance(t, T.MapType):
        return F.transform_values(a.col, lambda k, v: v.cast("string"))
    if isinstance(t, T.VariantType):
        return F.transform_values(a.col.try_cast("map<string,variant>"), lambda k, v: v.cast("string"))
    return _null("map<string,string>")


def _keys(a: Arg) -> Column:
    return F.array_sort(F.map_keys(_as_map(a)))


def _values(a: Arg) -> Column:
    m = _as_map(a)
    return F.transform(_keys(a), lambda k: m[k])


def _put(a: Arg, key: Arg, value: Arg) -> Column:
    rest = F.map_filter(_as_map(a), lambda k, v: k != text(key))
    return F.map_concat(rest, F.create_map(text(key), as_json(value)))


def _remove(a: Arg, key: Arg) -> Column:
    return F.map_filter(_as_map(a), lambda k, v: k != text(key))


#: strftime directives and the date pattern letters that do the same
_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "I": "hh", "p": "a", "Z": "z", "z": "xx", "f": "SSSSSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}
RFC3339 = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def date_pattern(strftime: str) -> str:
    out, i = "", 0
    while i < len(strftime):
        c = strftime[i]
        if c == "%" and i + 1 < len(strftime):
            out += _STRFTIME.get(strftime[i + 1], f"'{strftime[i + 1]}'")
            i += 2
        else:
            out += "''" if c == "'" else f"'{c}'" if c.isalpha() else c
            i += 1
    return out


def _constant(a: Arg) -> str:
    return str(a.df.sparkSession.range(1).select(a.col).first()[0])


def _now_str(fmt: Arg | None = None) -> Column:
    return F.date_format(F.current_timestamp(), date_pattern(_constant(fmt) if fmt else "%Y-%m-%dT%H:%M:%S"))


def moment(a: Arg) -> Column:
    """An RFC 3339 string or a timestamp as a timestamp."""
    if isinstance(a.type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return a.col.cast("timestamp")
    return F.when(text(a).rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d"), F.try_to_timestamp(text(a)))


def _date_diff(a: Arg, b: Arg, part: Arg | None = None) -> Column:
    unit = _constant(part).lower() if part else "day"
    micros = F.unix_micros(moment(a)) - F.unix_micros(moment(b))
    step = {"millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}.get(unit, 1_000_000)
    # towards zero
    return F.when(micros >= 0, F.floor(micros / step)).otherwise(-F.floor(-micros / step)).cast("long")


def _millis_to_str(a: Arg) -> Column:
    return F.date_format(F.timestamp_millis(number(a).cast("long")), RFC3339)


def _case(*args: Arg) -> Column:
    out = F.when(args[0].col, args[1].col)
    for i in range(2, len(args) - 1, 2):
        out = out.when(args[i].col, args[i + 1].col)
    return out.otherwise(args[-1].col)


def _first(*args: Arg) -> Column:
    return F.coalesce(*(a.col for a in args))


def _extreme(f: Callable[..., Column]) -> Callable[..., Column]:
    return lambda *args: f(*(a.col for a in args)) if len(args) > 1 else args[0].col


def _round(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5).cast("double")


def _toward_zero(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")


_MANY = 1 << 16
_TABLE: list[tuple[str, int, int, Callable[..., Column]]] = [
    ("LOWER", 1, 1, lambda a: F.lower(text(a))),
    ("UPPER", 1, 1, lambda a: F.upper(text(a))),
    ("LENGTH", 1, 1, lambda a: F.octet_length(text(a)).cast("long")),
    ("TRIM", 1, 1, _trim(r"(?U)^\s+|\s+$")),
    ("LTRIM", 1, 1, _trim(r"(?U)^\s+")),
    ("RTRIM", 1, 1, _trim(r"(?U)\s+$")),
    ("SUBSTR SUBSTRING", 2, 3, _substr),
    ("CONCAT", 1, _MANY, _concat),
    ("CONTAINS", 2, 2, lambda s, x: text(s).contains(text(x))),
    ("REPLACE", 3, 3, lambda s, a, b: F.replace(text(s), text(a), text(b))),
    ("SPLIT", 1, 2, _split),
    ("REPEAT", 1, 2, lambda s, n=None: F.repeat(text(s), number(n).cast("int") if n else F.lit(1))),
    ("REVERSE", 1, 1, lambda a: F.reverse(text(a))),
    ("POSITION POSITION0", 2, 2, lambda s, x: F.call_function("locate", text(x), text(s)) - 1),
    ("ABS", 1, 1, _math(F.abs)),
    ("CEIL CEILING", 1, 1, _math(F.ceil)),
    ("FLOOR", 1, 1, _math(F.floor)),
    ("ROUND", 1, 2, _scaled(_round)),
    ("TRUNC TRUNCATE", 1, 2, _scaled(_toward_zero)),
    ("POWER POW", 2, 2, lambda a, b: finite(F.pow(number(a), number(b)))),
    ("SQRT", 1, 1, _math(F.sqrt)),
    ("SIGN", 1, 1, lambda a: F.signum(number(a)).cast("int")),
    ("PI", 0, 0, F.pi),
    ("E", 0, 0, F.e),
    ("DEGREES", 1, 1, _math(F.degrees)),
    ("RADIANS", 1, 1, _math(F.radians)),
    ("RANDOM", 0, 0, F.rand),
    ("TOSTRING TO_STRING", 1, 1, as_json),
    ("TONUMBER TO_NUMBER TONUM", 1, 1, _to_number),
    ("TOBOOLEAN TO_BOOLEAN TOBOOL", 1, 1, _to_boolean),
    ("TOARRAY TO_ARRAY", 1, 1, lambda a: a.col if a.kind == "array" else F.array(a.col)),
    ("TYPE TYPENAME TYPE_NAME", 1, 1, _type),
    ("ISNULL IS_NULL", 1, 1, lambda a: _type(a) == "null"),
    ("ISSTRING IS_STRING ISSTR", 1, 1, _is("string")),
    ("ISNUMBER IS_NUMBER ISNUM", 1, 1, _is("number")),
    ("ISBOOLEAN IS_BOOLEAN ISBOOL", 1, 1, _is("boolean")),
    ("ISARRAY IS_ARRAY", 1, 1, _is("array")),
    ("ISOBJECT IS_OBJECT ISOBJ", 1, 1, _is("object")),
    ("ARRAY_LENGTH", 1, 1, lambda a: F.array_size(array(a))),
    ("ARRAY_APPEND", 2, 2, lambda a, v: F.array_append(array(a), v.col.cast(_elements(a)))),
    ("ARRAY_PREPEND", 2, 2, lambda v, a: F.array_prepend(array(a), v.col.cast(_elements(a)))),
    ("ARRAY_CONCAT", 1, _MANY, _array_concat),
    ("ARRAY_CONTAINS", 2, 2, _array_contains),
    ("ARRAY_DISTINCT", 1, 1, lambda a: F.array_distinct(array(a))),
    ("ARRAY_FLATTEN", 1, 2, _flatten),
    ("ARRAY_REVERSE", 1, 1, lambda a: F.reverse(array(a))),
    ("ARRAY_SORT", 1, 1, lambda a: F.array_sort(array(a))),
    ("ARRAY_MIN", 1, 1, lambda a: F.array_min(array(a))),
    ("ARRAY_MAX", 1, 1, lambda a: F.array_max(array(a))),
    ("ARRAY_SUM", 1, 1, _array_sum),
    ("ARRAY_AVG", 1, 1, _array_avg),
    ("ARRAY_COUNT", 1, 1, lambda a: F.size(F.filter(array(a), lambda x: x.isNotNull()))),
    ("NOW_STR", 0, 1, _now_str),
    ("NOW_MILLIS", 0, 0, lambda: F.unix_millis(F.current_timestamp())),
    ("NOW_UTC", 0, 0, lambda: F.date_format(F.current_timestamp(), RFC3339)),
    ("DATE_DIFF_STR", 2, 3, _date_diff),
    ("MILLIS_TO_STR", 1, 1, _millis_to_str),
    ("STR_TO_MILLIS", 1, 1, lambda a: F.unix_millis(moment(a))),
    ("OBJECT_LENGTH", 1, 1, lambda a: F.when(a.col.isNotNull(), F.size(_as_map(a)))),
    ("OBJECT_KEYS OBJECT_NAMES", 1, 1, _keys),
    ("OBJECT_VALUES", 1, 1, _values),
    ("OBJECT_ADD OBJECT_PUT", 3, 3, _put),
    ("OBJECT_REMOVE", 2, 2, _remove),
    ("IFNULL", 1, _MANY, _first),
    ("IFMISSING", 1, _MANY, _first),
    ("IFMISSINGORNULL COALESCE NVL", 1, _MANY, _first),
    ("NULLIF", 2, 2, lambda a, b: F.nullif(a.col, b.col)),
    ("LEAST", 1, _MANY, _extreme(F.least)),
    ("GREATEST", 1, _MANY, _extreme(F.greatest)),
    ("UUID", 0, 0, F.uuid),
    ("CASE", 3, _MANY, _case),
]
FUNCTIONS = {name: (low, high, make) for names, low, high, make in _TABLE for name in names.split()}


def call(name: str, args: list[Arg]) -> Column:
    low, high, make = FUNCTIONS[name]
    if not low <= len(args) <= high:
        raise ValueError(f"{name} takes {low}{'' if low == high else ' or more' if high == _MANY else f' to {high}'} arguments")
    return make(*args)


def register(name: str, make: Callable[..., Column], low: int, high: int | None = None) -> None:
    """Add a function of one's own; ``make`` gets Args and returns a Column."""
    FUNCTIONS[name.upper()] = (low, low if high is None else high, make)


# ------------------------------------------------- order of mixed JSON values

_RANK = {"string": 1, "number": 2, "array": 3, "false": 4, "null": 5, "true": 6, "object": 7}


def sort_key(v: Column) -> Column:
    """Orders variant values of any types: strings, numbers, arrays, false, null, true and
    objects, numbers by value and the rest by text."""
    kind = variant_kind(v)
    flag = F.try_variant_get(v, "$", "boolean")
    ranked = reduce(lambda c, k: c.when(kind == k, _RANK[k]), ("number", "array", "null", "object"), F.when(kind == "string", _RANK["string"]))
    rank = ranked.when(flag, _RANK["true"]).otherwise(_RANK["false"])
    return F.struct(rank.alias("rank"), F.when(kind == "number", F.try_variant_get(v, "$", "double")).alias("n"), F.when(kind.isin("string", "array", "object"), F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))).alias("s"))

"""Tokens, syntax tree and recursive-descent parser of the query dialect."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any


class QueryError(ValueError):
    """A statement that cannot be understood or run."""


# ---------------------------------------------------------------- expressions


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Path:
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Meta:
    alias: str | None
    field: str | None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: Any  # None is *


@dataclass(frozen=True)
class Unary:
    op: str
    arg: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Between:
    arg: Any
    low: Any
    high: Any


@dataclass(frozen=True)
class InList:
    arg: Any
    items: tuple


@dataclass(frozen=True)
class InQuery:
    arg: Any
    query: Select


@dataclass(frozen=True)
class Exists:
    query: Select


@dataclass(frozen=True)
class Scalar:
    query: Select


@dataclass(frozen=True)
class MakeArray:
    items: tuple


@dataclass(frozen=True)
class MakeObject:
    items: tuple[tuple[str, Any], ...]


# ----------------------------------------------------------------- statements


@dataclass(frozen=True)
class Item:
    expr: Any  # None is *
    alias: str | None = None
    text: str = ""


@dataclass(frozen=True)
class Source:
    bucket: str
    scope: str | None = None
    collection: str | None = None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or self.collection or self.bucket


@dataclass(frozen=True)
class Join:
    kind: str  # join, nest, unnest
    left: bool
    source: Source | None = None
    on: Any = None
    path: Path | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    expr: Any
    down: bool


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    source: Source | None = None
    joins: tuple[Join, ...] = ()
    where: Any = None
    group: tuple = ()
    having: Any = None
    order: tuple[Order, ...] = ()
    limit: int | Param | None = None
    offset: int | Param | None = None
    distinct: bool = False
    index: str | None = None


@dataclass(frozen=True)
class Insert:
    source: Source
    rows: tuple[tuple[Any, Any], ...]
    returning: tuple[Item, ...] = ()


@dataclass(frozen=True)
class Update:
    source: Source
    sets: tuple[tuple[Path, Any], ...]
    unsets: tuple[Path, ...] = ()
    where: Any = None
    limit: int | None = None
    returning: tuple[Item, ...] = ()


@dataclass(frozen=True)
class Delete:
    source: Source
    where: Any = None
    limit: int | None = None
    returning: tuple[Item, ...] = ()


@dataclass(frozen=True)
class IndexKey:
    path: Path
    array: bool = False
    distinct: bool = False
    var: str | None = None
    expr: Any = None


@dataclass(frozen=True)
class CreateIndex:
    name: str
    source: Source
    keys: tuple[IndexKey, ...]
    include: tuple[Path, ...] = ()
    where: Any = None
    primary: bool = False


@dataclass(frozen=True)
class DropIndex:
    name: str
    bucket: str


@dataclass(frozen=True)
class Explain:
    statement: Any


@dataclass(frozen=True)
class Prepare:
    name: str | None
    statement: Any
    text: str = field(default="", compare=False)


@dataclass(frozen=True)
class Execute:
    name: str
    using: Any = None


# --------------------------------------------------------------------- tokens

_TOKEN = re.compile(
    r"""\s+ | --[^\n]* | /\*.*?\*/
    | (?P<num>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    | (?P<str>"(?:[^"\\]|\\.|"")*"|'(?:[^'\\]|\\.|'')*')
    | (?P<name>`[^`]+`|[A-Za-z_][A-Za-z_0-9]*)
    | (?P<param>\$[A-Za-z_0-9]+)
    | (?P<op><>|!=|<=|>=|==|\|\||[-+*/%=<>(),.\[\]{}:;])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}
RESERVED = set("SELECT FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET JOIN INNER LEFT OUTER NEST UNNEST ON AS AND OR NOT IN IS NULL LIKE BETWEEN EXISTS DISTINCT ASC DESC SET UNSET VALUES RETURNING USE USING INTO CASE WHEN THEN ELSE END".split())
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX"}


@dataclass(frozen=True)
class Token:
    kind: str
    value: Any
    start: int
    end: int
    quoted: bool = False


def _unquote(raw: str) -> str:
    mark = raw[0]
    body = raw[1:-1].replace(mark * 2, mark)
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), body, flags=re.S)


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at]!r} at {at}")
        kind, raw = m.lastgroup, m.group()
        if kind == "num":
            out.append(Token("num", float(raw) if re.search(r"[.eE]", raw) else int(raw), at, m.end()))
        elif kind == "str":
            out.append(Token("str", _unquote(raw), at, m.end()))
        elif kind == "name":
            out.append(Token("name", raw.strip("`"), at, m.end(), raw[0] == "`"))
        elif kind == "param":
            out.append(Token("param", raw[1:], at, m.end()))
        elif kind == "op" and raw != ";":
            out.append(Token("op", raw, at, m.end()))
        at = m.end()
    return [*out, Token("end", None, len(text), len(text))]


# --------------------------------------------------------------------- parser


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i = text, tokenize(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def word(self, *words: str, ahead: int = 0) -> bool:
        t = self.tokens[min(self.i + ahead, len(self.tokens) - 1)]
        return t.kind == "name" and not t.quoted and t.value.upper() in words

    def op(self, *ops: str, ahead: int = 0) -> bool:
        t = self.tokens[min(self.i + ahead, len(self.tokens) - 1)]
        return t.kind == "op" and t.value in ops

    def take(self, *words: str) -> bool:
        if self.word(*words):
            self.i += 1
            return True
        return False

    def take_op(self, *ops: str) -> bool:
        if self.op(*ops):
            self.i += 1
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise QueryError(f"{' or '.join(words)} expected at {self.now.start}: {self.text[self.now.start:self.now.start + 20]!r}")

    def need_op(self, op: str) -> None:
        if not self.take_op(op):
            raise QueryError(f"{op!r} expected at {self.now.start}: {self.text[self.now.start:self.now.start + 20]!r}")

    def name(self) -> str:
        t = self.now
        if t.kind != "name" or (not t.quoted and t.value.upper() in RESERVED):
            raise QueryError(f"a name was expected at {t.start}: {self.text[t.start:t.start + 20]!r}")
        self.i += 1
        return t.value

    def whole(self) -> Any:
        out = self.statement()
        if self.now.kind != "end":
            raise QueryError(f"unexpected {self.text[self.now.start:self.now.start + 20]!r} at {self.now.start}")
        return out

    def statement(self) -> Any:
        if self.word("SELECT"):
            return self.select()
        if self.take("EXPLAIN"):
            return Explain(self.statement())
        if self.take("PREPARE"):
            name = None
            if not self.word("AS", "FROM", "SELECT", "INSERT", "UPDATE", "DELETE"):
                name = self.name()
            self.take("AS") or self.take("FROM")
            start = self.now.start
            return Prepare(name, self.statement(), self.text[start:].strip())
        if self.take("EXECUTE"):
            name = self.now.value if self.now.kind == "str" else None
            name = self.name() if name is None else (setattr(self, "i", self.i + 1) or name)
            return Execute(name, self.expr() if self.take("USING") else None)
        if self.take("INSERT", "UPSERT"):
            return self.insert()
        if self.take("UPDATE"):
            return self.update()
        if self.take("DELETE"):
            return self.delete()
        if self.take("CREATE"):
            return self.create_index()
        if self.take("DROP"):
            return self.drop_index()
        raise QueryError(f"no statement begins with {self.text[:20]!r}")

    # -- SELECT

    def select(self) -> Select:
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        items = self.items()
        source, joins, index = None, [], None
        if self.take("FROM"):
            source = self.source()
            if self.take("USE"):
                self.need("INDEX")
                self.need_op("(")
                index = self.name()
                while self.take("USING"):
                    self.name()
                self.need_op(")")
            while (j := self.join()) is not None:
                joins.append(j)
        where = self.cond() if self.take("WHERE") else None
        group: list = []
        if self.take("GROUP"):
            self.need("BY")
            group.append(self.expr())
            while self.take_op(","):
                group.append(self.expr())
        having = self.cond() if self.take("HAVING") else None
        order: list[Order] = []
        if self.take("ORDER"):
            self.need("BY")
            while True:
                e = self.cond()
                down = self.take("DESC")
                if not down:
                    self.take("ASC")
                order.append(Order(e, down))
                if not self.take_op(","):
                    break
        limit = offset = None
        while self.word("LIMIT", "OFFSET"):
            if self.take("LIMIT"):
                limit = self.count()
            else:
                self.i += 1
                offset = self.count()
        return Select(tuple(items), source, tuple(joins), where, tuple(group), having, tuple(order), limit, offset, distinct, index)

    def count(self) -> int | Param:
        t = self.now
        self.i += 1
        if t.kind == "num" and isinstance(t.value, int):
            return t.value
        if t.kind == "param":
            return Param(t.value)
        raise QueryError(f"a number was expected at {t.start}")

    def items(self) -> list[Item]:
        out = [self.item()]
        while self.take_op(","):
            out.append(self.item())
        return out

    def item(self) -> Item:
        if self.take_op("*"):
            return Item(None)
        start = self.now.start
        e = self.cond()
        text = self.text[start : self.tokens[self.i - 1].end]
        alias = None
        if self.take("AS") or (self.now.kind == "name" and (self.now.quoted or self.now.value.upper() not in RESERVED)):
            alias = self.name()
        return Item(e, alias, text)

    def source(self) -> Source:
        parts = [self.name()]
        while self.take_op("."):
            parts.append(self.name())
        alias = None
        if self.take("AS") or (self.now.kind == "name" and (self.now.quoted or self.now.value.upper() not in RESERVED)):
            alias = self.name()
        if len(parts) > 3:
            raise QueryError("a source has at most three parts")
        return Source(parts[0], *(parts[1:3] if len(parts) == 3 else (None, parts[1] if len(parts) > 1 else None)), alias)

    def join(self) -> Join | None:
        start = self.i
        left = False
        if self.take("LEFT"):
            left = True
            self.take("OUTER")
        else:
            self.take("INNER")
        if self.take("UNNEST"):
            path = self.path()
            alias = None
            if self.take("AS") or (self.now.kind == "name" and self.now.value.upper() not in RESERVED):
                alias = self.name()
            return Join("unnest", left, path=path, alias=alias or path.parts[-1])
        if self.word("JOIN", "NEST"):
            kind = self.now.value.lower()
            self.i += 1
            source = self.source()
            self.need("ON")
            return Join(kind, left, source, self.cond(), alias=source.name)
        self.i = start
        return None

    def path(self) -> Path:
        parts = [self.name()]
        while self.take_op("."):
            t = self.now
            if t.kind == "name":
                parts.append(t.value)
                self.i += 1
            else:
                parts.append(self.name())
        return Path(tuple(parts))

    # -- conditions and expressions

    def cond(self) -> Any:
        out = self.conj()
        while self.take("OR"):
            out = Binary("or", out, self.conj())
        return out

    def conj(self) -> Any:
        out = self.neg()
        while self.take("AND"):
            out = Binary("and", out, self.neg())
        return out

    def neg(self) -> Any:
        if self.take("NOT"):
            return Unary("not", self.neg())
        return self.predicate()

    def predicate(self) -> Any:
        if self.take("EXISTS"):
            self.need_op("(")
            q = self.select()
            self.need_op(")")
            return Exists(q)
        left = self.expr()
        if self.op("=", "==", "!=", "<>", "<", "<=", ">", ">="):
            op = self.now.value
            self.i += 1
            return Binary({"==": "=", "<>": "!="}.get(op, op), left, self.expr())
        if self.take("IS"):
            no = self.take("NOT")
            self.need("NULL", "MISSING", "VALUED")
            word = self.tokens[self.i - 1].value.upper()
            return Unary("is not null" if no != (word == "VALUED") else "is null", left)
        no = self.take("NOT")
        if self.take("LIKE"):
            out: Any = Binary("like", left, self.expr())
        elif self.take("BETWEEN"):
            low = self.expr()
            self.need("AND")
            out = Between(left, low, self.expr())
        elif self.take("IN"):
            if self.op("[") or self.now.kind == "param":
                arr = self.expr()
                out = InList(left, arr.items) if isinstance(arr, MakeArray) else InList(left, (arr,))
            else:
                self.need_op("(")
                if self.word("SELECT"):
                    out = InQuery(left, self.select())
                else:
                    items = [self.expr()]
                    while self.take_op(","):
                        items.append(self.expr())
                    out = InList(left, tuple(items))
                self.need_op(")")
        elif no:
            raise QueryError(f"LIKE, BETWEEN or IN expected at {self.now.start}")
        else:
            return left
        return Unary("not", out) if no else out

    def expr(self) -> Any:
        out = self.term()
        while self.op("+", "-", "||"):
            op = self.now.value
            self.i += 1
            out = Binary(op, out, self.term())
        return out

    def term(self) -> Any:
        out = self.factor()
        while self.op("*", "/", "%"):
            op = self.now.value
            self.i += 1
            out = Binary(op, out, self.factor())
        return out

    def factor(self) -> Any:
        if self.take_op("-"):
            e = self.factor()
            return Literal(-e.value) if isinstance(e, Literal) and isinstance(e.value, (int, float)) else Unary("-", e)
        return self.primary()

    def primary(self) -> Any:
        t = self.now
        if t.kind in ("num", "str"):
            self.i += 1
            return Literal(t.value)
        if t.kind == "param":
            self.i += 1
            return Param(t.value)
        if self.take_op("("):
            if self.word("SELECT"):
                q = self.select()
                self.need_op(")")
                return Scalar(q)
            e = self.cond()
            self.need_op(")")
            return e
        if self.take_op("["):
            items = []
            while not self.take_op("]"):
                items.append(self.expr())
                self.take_op(",")
            return MakeArray(tuple(items))
        if self.take_op("{"):
            pairs = []
            while not self.take_op("}"):
                k = self.now
                self.i += 1
                if k.kind not in ("str", "name"):
                    raise QueryError(f"a field name was expected at {k.start}")
                self.need_op(":")
                pairs.append((k.value, self.expr()))
                self.take_op(",")
            return MakeObject(tuple(pairs))
        if t.kind != "name":
            raise QueryError(f"an expression was expected at {t.start}: {self.text[t.start:t.start + 20]!r}")
        if not t.quoted:
            up = t.value.upper()
            if up in ("TRUE", "FALSE", "NULL", "MISSING") and not self.op("(", ahead=1):
                self.i += 1
                return Literal({"TRUE": True, "FALSE": False}.get(up))
            if up == "CASE":
                return self.case()
            if self.op("(", ahead=1):
                return self.call()
        return self.path()

    def case(self) -> Any:
        self.i += 1
        args = []
        while self.take("WHEN"):
            args.append(self.cond())
            self.need("THEN")
            args.append(self.expr())
        args.append(self.expr() if self.take("ELSE") else Literal(None))
        self.need("END")
        return Call("CASE", tuple(args))

    def call(self) -> Any:
        name = self.now.value.upper()
        self.i += 2
        if name == "META":
            alias = None if self.op(")") else self.name()
            self.need_op(")")
            return Meta(alias, self.path().parts[0] if self.take_op(".") else None)
        if name in AGGREGATES:
            arg = None if self.take_op("*") else self.expr()
            self.need_op(")")
            return Aggregate(name, arg)
        args = []
        while not self.take_op(")"):
            args.append(self.cond())
            if not self.op(")"):
                self.need_op(",")
        return Call(name, tuple(args))

    # -- DML and indexes

    def insert(self) -> Insert:
        self.need("INTO")
        source = self.source()
        self.need_op("(")
        self.need("KEY")
        self.need_op(",")
        self.need("VALUE")
        self.need_op(")")
        rows = []
        self.need("VALUES")
        while True:
            self.need_op("(")
            k = self.expr()
            self.need_op(",")
            rows.append((k, self.expr()))
            self.need_op(")")
            if not self.take_op(","):
                break
            self.take("VALUES")
        return Insert(source, tuple(rows), self.returning())

    def returning(self) -> tuple[Item, ...]:
        return tuple(self.items()) if self.take("RETURNING") else ()

    def update(self) -> Update:
        source = self.source()
        sets, unsets = [], []
        if self.take("SET"):
            while True:
                p = self.path()
                self.need_op("=")
                sets.append((p, self.expr()))
                if not self.take_op(","):
                    break
        if self.take("UNSET"):
            unsets.append(self.path())
            while self.take_op(","):
                unsets.append(self.path())
        if not sets and not unsets:
            raise QueryError("UPDATE needs SET or UNSET")
        where = self.cond() if self.take("WHERE") else None
        limit = self.count() if self.take("LIMIT") else None
        return Update(source, tuple(sets), tuple(unsets), where, limit, self.returning())

    def delete(self) -> Delete:
        self.need("FROM")
        source = self.source()
        where = self.cond() if self.take("WHERE") else None
        limit = self.count() if self.take("LIMIT") else None
        return Delete(source, where, limit, self.returning())

    def create_index(self) -> CreateIndex:
        primary = self.take("PRIMARY")
        self.need("INDEX")
        name = "#primary" if primary and self.word("ON") else self.name()
        self.need("ON")
        source = Source(self.name())
        keys, include = [], []
        if not primary:
            self.need_op("(")
            while True:
                keys.append(self.index_key())
                if not self.take_op(","):
                    break
            self.need_op(")")
            if self.take("INCLUDE"):
                self.need_op("(")
                include.append(self.path())
                while self.take_op(","):
                    include.append(self.path())
                self.need_op(")")
        where = self.cond() if self.take("WHERE") else None
        return CreateIndex(name, source, tuple(keys), tuple(include), where, primary)

    def index_key(self) -> IndexKey:
        distinct = self.word("DISTINCT")
        if self.take("ALL", "DISTINCT"):
            self.need("ARRAY")
            e = self.expr()
            self.need("FOR")
            var = self.name()
            self.need("IN")
            path = self.path()
            self.need("END")
            return IndexKey(path, True, distinct, var, e)
        return IndexKey(self.path())

    def drop_index(self) -> DropIndex:
        self.need("INDEX")
        first = self.name()
        if self.take_op("."):
            return DropIndex(self.name(), first)
        self.need("ON")
        return DropIndex(first, self.name())


def parse(text: str) -> Any:
    return Parser(text).whole()


def literal_of(value: Any) -> Any:
    """A bound parameter as an expression."""
    if isinstance(value, (list, tuple)):
        return MakeArray(tuple(literal_of(v) for v in value))
    if isinstance(value, dict):
        return MakeObject(tuple((k, literal_of(v)) for k, v in sorted(value.items())))
    return Literal(value)


def constant(e: Any) -> Any:
    """The JSON value of an expression of literals."""
    if isinstance(e, Literal):
        return e.value
    if isinstance(e, MakeArray):
        return [constant(x) for x in e.items]
    if isinstance(e, MakeObject):
        return {k: constant(v) for k, v in e.items}
    raise QueryError("a constant was expected")


def bind(node: Any, params: dict[str, Any]) -> Any:
    """The tree with parameters replaced by literals; text is never substituted."""
    if isinstance(node, Param):
        if node.name not in params:
            raise QueryError(f"parameter ${node.name} has no value")
        return literal_of(params[node.name])
    if isinstance(node, tuple):
        return tuple(bind(x, params) for x in node)
    if hasattr(node, "__dataclass_fields__"):
        values = {f: bind(getattr(node, f), params) for f in node.__dataclass_fields__}
        for f in ("limit", "offset"):
            if isinstance(values.get(f), Literal):
                values[f] = int(values[f].value or 0)
        return type(node)(**values)
    return node


def to_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))

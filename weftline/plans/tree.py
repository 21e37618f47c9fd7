"""Syntax tree of scripts: expressions, and statements as plain immutable nodes."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from ..types import Field, Type


class Expr:
    __slots__ = ()


@dataclass(frozen=True)
class Pos(Expr):
    index: int


@dataclass(frozen=True)
class Name(Expr):
    name: str
    lineage: tuple[str, ...] = ()


@dataclass(frozen=True)
class Star(Expr):
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Deref(Expr):
    base: Expr
    field: Expr


@dataclass(frozen=True)
class Lookup(Expr):
    base: Expr
    key: str


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Negative(Expr):
    of: Expr


@dataclass(frozen=True)
class Cast(Expr):
    type: Type
    of: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Flatten(Expr):
    of: Expr


@dataclass(frozen=True)
class MakeTuple(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MakeBag(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MakeMap(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MakeMatrix(Expr):
    kind: str
    rows: int
    cols: int
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MakeGeometry(Expr):
    wkt: Expr
    times: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class And(Expr):
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Or(Expr):
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not(Expr):
    of: Expr


@dataclass(frozen=True)
class Generator:
    expr: Expr
    alias: Field | None = None


@dataclass(frozen=True)
class Var:
    """A variable of a triple pattern."""

    name: str


@dataclass(frozen=True)
class Pattern:
    """An event pattern: kind is simple, seq, and, or or neg."""

    kind: str
    name: str = ""
    parts: tuple[Pattern, ...] = ()


@dataclass(frozen=True)
class Stmt:
    """``kind`` is the statement's keyword, ``out`` the alias it defines (or empty), ``ins`` the aliases it reads."""

    kind: str
    out: str = ""
    ins: tuple[str, ...] = ()
    args: dict[str, Any] = field(default_factory=dict, hash=False)
    line: int = field(default=0, compare=False)

    def __getitem__(self, name: str) -> Any:
        return self.args.get(name)

    def but(self, **changes) -> Stmt:
        own = {k: changes.pop(k) for k in ("kind", "out", "ins", "line") if k in changes}
        base = {f.name: getattr(self, f.name) for f in fields(self)} | own
        return Stmt(**base | {"args": {**self.args, **changes}})


def plain(x: Any) -> Any:
    """A node as JSON-ready data, which equal nodes share."""
    if is_dataclass(x):
        return [type(x).__name__, *(plain(getattr(x, f.name)) for f in fields(x) if f.name != "line")]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in sorted(x.items())}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


def signature(stmt: Stmt, of_inputs: list[str]) -> str:
    """Hash of what a statement computes: its operation and its inputs' hashes, not their names."""
    names = {a: f"input {i}" for i, a in enumerate(stmt.ins)}
    body = json.dumps([stmt.kind, plain(renamed(stmt.args, names)), of_inputs], sort_keys=True, default=str)
    return hashlib.sha256(body.encode()).hexdigest()


def mapped(x: Any, f) -> Any:
    """The tree with ``f`` applied to each node from below; f returns the node to put there."""
    if is_dataclass(x) and not isinstance(x, type):
        x = type(x)(**{g.name: mapped(getattr(x, g.name), f) for g in fields(x)})
        return f(x)
    if isinstance(x, dict):
        return {k: mapped(v, f) for k, v in x.items()}
    if isinstance(x, tuple):
        return tuple(mapped(v, f) for v in x)
    return [mapped(v, f) for v in x] if isinstance(x, list) else f(x)


def renamed(x: Any, names: dict[str, str]) -> Any:
    """The tree with aliases in expressions and lineages renamed."""

    def one(n):
        if isinstance(n, Name):
            return Name(names.get(n.name, n.name) if not n.lineage else n.name, tuple(names.get(p, p) for p in n.lineage))
        return n

    return mapped(x, one)


def walk(x: Any):
    """All nodes of a tree."""
    yield x
    if is_dataclass(x) and not isinstance(x, type):
        for f in fields(x):
            yield from walk(getattr(x, f.name))
    elif isinstance(x, dict):
        for v in x.values():
            yield from walk(v)
    elif isinstance(x, (list, tuple)):
        for v in x:
            yield from walk(v)

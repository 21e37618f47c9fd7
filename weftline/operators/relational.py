"""Relational operators on relations: each statement becomes DataFrame transformations, never an action."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import builtins as B
from ..functions.builtins import Typed
from ..plans import tree as t
from ..shared import written
from ..types import BYTEARRAY, DOUBLE, LONG, CHARARRAY, BagType, Field, Schema, ScriptError, TupleType, compatible, escalate, to_spark
from .expressions import WINDOW, Functions, Grouped, Joined, Lower, Relation, RowScope, Scope, show


def positional(df: DataFrame, cols: list[Column], fields: list[Field] | None, like: Relation | None = None, window: bool = False, **changes) -> Relation:
    """A relation of columns computed on a frame."""
    out = [c.alias(f"_{i}") for i, c in enumerate(cols)]
    keep = [F.col(WINDOW)] if window else []
    return Relation(df.select(*out, *keep), Schema(tuple(fields)), window, like.stream if like else False, **changes)


def settled(r: Relation) -> Relation:
    """The relation with its bags built, if it is a group that none has aggregated."""
    if not r.grouped:
        return r
    out = build_cogroup(r) if r.grouped.sides else build_group(r)
    for by, functions in r.grouped.having:
        out = filter_(out, by, functions)
    return out


def row_struct(r: Relation) -> Column:
    return F.struct(*[F.col(c) for c in r.columns])


def filter_(r: Relation, by: t.Expr, functions: Functions) -> Relation:
    if r.grouped and not r.stream and not r.df.isStreaming:
        try:
            _lower_of(r.grouped, functions).predicate(by)
            return replace(r, grouped=replace(r.grouped, having=(*r.grouped.having, (by, functions))))
        except NotFusable:
            pass
    r = settled(r)
    return replace(r, df=r.df.where(Lower(RowScope.of(r), functions).predicate(by)))


# -- FOREACH
def foreach(r: Relation, generate: tuple[t.Generator, ...], block: tuple[t.Stmt, ...], functions: Functions) -> Relation:
    if r.grouped:
        try:
            return _fused(r, generate, block, functions)
        except NotFusable:
            r = settled(r)
    scope = RowScope.of(r)
    lower = Lower(scope, functions)
    for s in block:
        lower = Lower(scope, functions, {**lower.env, s.out: nested(s, lower)})
    return generated(r, generate, lower)


def _named(own: Field, alias: Field | None, x: Typed) -> tuple[Column, Field]:
    """Column and field of an item under its AS clause."""
    if alias is None:
        return x.col, replace(own, type=x.type)
    if alias.type == BYTEARRAY or alias.type == x.type:
        return x.col, Field(alias.name, x.type)
    if isinstance(alias.type, (TupleType, BagType)):
        return (x.col.cast(to_spark(alias.type)) if compatible(alias.type, x.type) else x.col), Field(alias.name, alias.type if compatible(alias.type, x.type) else x.type)
    return x.col.cast(to_spark(alias.type)), Field(alias.name, alias.type)


def generated(r: Relation, generate: tuple[t.Generator, ...], lower: Lower) -> Relation:
    """The rows of a GENERATE list, with stars and FLATTENs spread. Windows end here."""
    if r.schema is None and any(isinstance(g.expr, t.Star) for g in generate):
        if len(generate) > 1:
            raise ScriptError("GENERATE *, ... needs a schema")
        return replace(r, df=r.df.drop(WINDOW), window=False)
    df, cols, fields, bags = r.df, [], [], []
    for g in generate:
        if isinstance(g.expr, t.Star):
            for i, f in enumerate(r.schema.fields):
                cols.append(F.col(f"_{i}"))
                fields.append(f)
            continue
        if isinstance(g.expr, t.Flatten):
            x = lower.expr(g.expr.of)
            names = g.alias.type.fields if g.alias and isinstance(g.alias.type, TupleType) else (g.alias,) if g.alias else ()
            if isinstance(x.type, BagType):
                column = f"_b{len(bags)}"
                bags.append((column, x.col))
                inner, item = F.col(column), x.type.item
            elif isinstance(x.type, TupleType):
                inner, item = x.col, x.type
            else:
                cols.append(x.col)
                fields.append(replace(lower.field(g.expr.of), type=x.type) if g.alias is None else Field(g.alias.name, x.type))
                continue
            if item.fields is None:
                if not names:
                    raise ScriptError("FLATTEN of a tuple of unknown arity needs AS (...)")
                item = TupleType(fields=tuple(Field(f.name, BYTEARRAY) for f in names))
                part = lambda i, inner=inner: F.get(inner.getField("_raw"), F.lit(i))
            else:
                part = lambda i, inner=inner: inner.getField(f"_{i}")
            for i, f in enumerate(item.fields):
                c, named = _named(f, names[i] if i < len(names) else None, Typed(part(i), f.type))
                cols.append(c)
                fields.append(named)
            continue
        c, f = _named(lower.field(g.expr), g.alias, lower.expr(g.expr))
        cols.append(c)
        fields.append(f)
    # One explode for each bag: several make their cross product, an empty one drops the row.
    for column, bag in bags:
        df = df.select("*", bag.alias(column)).withColumn(column, F.explode(column))
    return positional(df, cols, fields, r)


def nested(s: t.Stmt, lower: Lower) -> Typed:
    """A statement of a nested block, on bags held in the row."""
    bag = lower.expr(s["of"])
    if s.kind == "project":
        return bag
    if not isinstance(bag.type, BagType):
        raise ScriptError(f"{show(s['of'])} is no bag")
    item = bag.type.item
    inside = lambda x: Lower(RowScope.inside(x, item), lower.functions, lower.env)
    if s.kind == "filter":
        return Typed(F.filter(bag.col, lambda x: F.coalesce(inside(x).predicate(s["by"]), F.lit(False))), bag.type)
    if s.kind == "distinct":
        return Typed(F.array_distinct(bag.col), bag.type)
    if s.kind == "limit":
        return Typed(F.slice(bag.col, 1, s["n"]), bag.type)
    keys = [(t.Pos(i), k[1]) for k in s["by"] for i in range(len(item.fields or ()))] if isinstance(s["by"][0][0], t.Star) else s["by"]

    def before(x: Column, y: Column) -> Column:
        out = None
        for ref, ascending in keys:
            a, b = (inside(z).expr(ref).col for z in (x, y))
            up, down = (-1, 1) if ascending else (1, -1)
            # Nulls first where ascending, last where descending, as in ORDER.
            step = lambda c, v: (F if out is None else out).when(c, v)
            out = step(a.isNull() & b.isNotNull() | (a < b), up)
            out = out.when(b.isNull() & a.isNotNull() | (a > b), down)
        return out.otherwise(0)

    return Typed(F.array_sort(bag.col, before), bag.type)


# -- GROUP
def group(r: Relation, alias: str, keys: tuple[t.Expr, ...], functions: Functions) -> Relation:
    r = settled(r)
    lower = Lower(RowScope.of(r), functions)
    typed = tuple((k, lower.expr(k), lower.field(k).name) for k in keys)
    group_type = CHARARRAY if not keys else typed[0][1].type if len(keys) == 1 else TupleType(fields=tuple(Field(n, x.type) for _, x, n in typed))
    schema = Schema((Field("group", group_type), Field(alias, BagType(item=r.item()))))
    return Relation(r.df, schema, r.window, r.stream, Grouped(r, alias, typed, not keys))


def _key_columns(g: Grouped) -> list[Column]:
    return [x.col.alias(f"_k{i}") for i, (_, x, _) in enumerate(g.keys)]


def _group_value(g: Grouped) -> Column:
    if g.everything:
        return F.lit("all")
    if len(g.keys) == 1:
        return F.col("_k0")
    return F.struct(*[F.col(f"_k{i}").alias(f"_{i}") for i in range(len(g.keys))])


def build_group(r: Relation) -> Relation:
    """The bags themselves. Only scripts that use whole bags come here; aggregates go through _fused."""
    g = r.grouped
    keys = _key_columns(g) + ([F.col(WINDOW)] if r.window else [])
    df = g.base.df.groupBy(*keys).agg(F.collect_list(row_struct(g.base)).alias("_bag"))
    out = df.select(_group_value(g).alias("_0"), F.col("_bag").alias("_1"), *([WINDOW] if r.window else []))
    return replace(r, df=out, grouped=None)


class NotFusable(Exception):
    """The expressions need the bags themselves."""


class _Bag:
    """A bag of the group's rows, described, not built."""

    def __init__(self, where: Column | None = None, cols: list[Typed] | None = None, fields: list[Field] | None = None, distinct: bool = False, side: int | None = None):
        self.where, self.cols, self.fields, self.distinct, self.side = where, cols, fields, distinct, side


class _GroupScope(Scope):
    def get(self, ref):
        raise NotFusable


class _GroupLower(Lower):
    """Expressions of a FOREACH over a group as aggregates of the group's rows."""

    def __init__(self, g: Grouped, functions: Functions, over=None):
        super().__init__(_GroupScope(), functions)
        self.g, self.over, self.bags = g, over, {}
        self.rows = Lower(RowScope.of(g.base), functions)
        self.extra: list[Column] = []

    def bag(self, e: t.Expr) -> _Bag | None:
        if isinstance(e, t.Name) and not e.lineage and e.name in self.bags:
            return self.bags[e.name]
        if isinstance(e, t.Name) and not e.lineage and e.name == self.g.alias or e == t.Pos(1):
            return _Bag()
        if isinstance(e, t.Deref) and (b := self.bag(e.base)):
            x, f = self.inner(b).ref(e.field)
            return _Bag(b.where, [x], [replace(f, type=x.type)], False, b.side) if not b.distinct else None
        return None

    def inner(self, b: _Bag) -> Lower:
        if b.cols is None:
            return self.rows
        return Lower(RowScope(Schema(tuple(b.fields)), lambda i: b.cols[i].col), self.functions)

    def define(self, s: t.Stmt) -> None:
        b = self.bag(s["of"])
        if b is None:
            raise NotFusable
        if s.kind == "filter" and not b.distinct:
            p = self.inner(b).predicate(s["by"])
            b = _Bag(p if b.where is None else b.where & p, b.cols, b.fields, False, b.side)
        elif s.kind == "distinct":
            b = _Bag(b.where, b.cols, b.fields, True, b.side)
        elif s.kind != "project":
            raise NotFusable
        self.bags[s.out] = b

    def key(self, e: t.Expr) -> int | None:
        """Which key an expression stands for."""
        if e in (t.Name("group"), t.Pos(0)) and len(self.g.keys) == 1 and not self.g.everything:
            return 0
        if isinstance(e, t.Deref) and e.base in (t.Name("group"), t.Pos(0)) and len(self.g.keys) > 1:
            if isinstance(e.field, t.Pos):
                return e.field.index if e.field.index < len(self.g.keys) else None
            hits = [i for i, (_, _, n) in enumerate(self.g.keys) if n == e.field.name]
            return hits[0] if len(hits) == 1 else None
        # The grouping column of the bag is the same in all its rows.
        if isinstance(e, t.Deref) and e.base in (t.Name(self.g.alias), t.Pos(1)) and len(self.g.keys) == 1 and isinstance(self.g.keys[0][0], (t.Name, t.Pos)):
            schema = self.g.base.schema
            place = lambda r: r.index if isinstance(r, t.Pos) else schema.find(r.name, r.lineage) if schema else None
            if place(e.field) == place(self.g.keys[0][0]) is not None:
                return 0
        return None

    def field(self, e):
        if e == t.Name("group") or e == t.Pos(0):
            return Field("group", BYTEARRAY)
        if isinstance(e, t.Deref) and isinstance(e.field, t.Name):
            return Field(e.field.name, BYTEARRAY)
        return Field("", BYTEARRAY)

    def key_column(self, i: int) -> Column:
        return F.col(f"_k{i}")

    def expr(self, e):
        if (k := self.key(e)) is not None:
            return Typed(self.key_column(k), self.g.keys[k][1].type)
        if e in (t.Name("group"), t.Pos(0)):
            kind = CHARARRAY if self.g.everything else TupleType(fields=tuple(Field(n, x.type) for _, x, n in self.g.keys))
            return Typed(_group_value(self.g), kind)
        if isinstance(e, t.Call) and len(e.args) == 1 and e.name not in self.functions.aliases and e.name not in self.functions.python:
            name = e.name.upper()
            if name in B.AGGREGATES or name in ("ISEMPTY", "NONEMPTY"):
                b = self.bag(e.args[0])
                if b is not None:
                    return self.aggregate(name, b)
        return super().expr(e)

    def aggregate(self, name: str, b: _Bag) -> Typed:
        if name in ("ISEMPTY", "NONEMPTY"):
            n = self.aggregate("COUNT", b)
            return Typed(n.col == 0 if name == "ISEMPTY" else n.col > 0, B.BOOLEAN)
        held = lambda c: c if b.where is None else F.when(b.where, c)
        if name == "COUNT":
            if b.distinct:
                if self.over is not None:
                    raise NotFusable
                # A struct of nulls isn't null: a null element counts once.
                whole = F.struct(*[c.col for c in b.cols]) if b.cols is not None else row_struct(self.g.base)
                return B.aggregate("COUNT", Typed(held(whole), BYTEARRAY), True)
            out = B.aggregate("COUNT", None if b.where is None else Typed(held(F.lit(1)), LONG))
        else:
            cols = b.cols
            if cols is None:
                if self.g.base.schema is None or len(self.g.base.schema.fields) != 1:
                    raise NotFusable
                cols = [self.rows.expr(t.Pos(0))]
            if len(cols) != 1 or name == "MEDIAN" and (b.distinct or self.over is not None) or b.distinct and (name == "AVG" or self.over is not None):
                raise NotFusable
            x = Typed(held(cols[0].col), cols[0].type)
            if name == "MEDIAN":
                x = B.number(x)
                column = f"_m{len(self.extra)}"
                self.extra.append(x.col.alias(column))
                return Typed(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)"), x.type)
            out = B.aggregate(name, x, b.distinct)
        return Typed(out.col.over(self.over), out.type) if self.over is not None else out


class _CoLower(_GroupLower):
    """The same over a COGROUP: the bag of an input is the rows of its side."""

    def __init__(self, g: Grouped, functions: Functions):
        super().__init__(g, functions)
        self.sides = [Lower(RowScope(r.schema, lambda p, i=i: F.col(f"s{i}_{p}")), functions) for i, (r, _) in enumerate(g.sides)]

    def bag(self, e: t.Expr) -> _Bag | None:
        if isinstance(e, t.Name) and not e.lineage and e.name in self.bags:
            return self.bags[e.name]
        for i, (_, alias) in enumerate(self.g.sides):
            if isinstance(e, t.Name) and not e.lineage and e.name == alias or e == t.Pos(i + 1):
                return _Bag(F.col("_side") == i, side=i)
        return super().bag(e) if isinstance(e, t.Deref) else None

    def key(self, e: t.Expr) -> int | None:
        # A bag's own key fields are no keys of the group: the bag may be empty.
        return None if isinstance(e, t.Deref) and e.base not in (t.Name("group"), t.Pos(0)) else super().key(e)

    def inner(self, b: _Bag) -> Lower:
        return self.sides[b.side] if b.cols is None else super().inner(b)

    def aggregate(self, name: str, b: _Bag) -> Typed:
        if b.cols is None and (b.distinct or name not in ("COUNT", "ISEMPTY", "NONEMPTY")):
            raise NotFusable
        return super().aggregate(name, b)


def _lower_of(g: Grouped, functions: Functions, over=None) -> _GroupLower:
    return _CoLower(g, functions) if g.sides else _GroupLower(g, functions, over)


class _NotPushed(Exception):
    """The aggregates need the joined rows."""


class _JoinLower(_GroupLower):
    """Aggregates of a JOIN's rows from sums over each input's rows of equal keys, so that the combinations of rows aren't made."""

    def __init__(self, g: Grouped, functions: Functions):
        super().__init__(g, functions)
        self.seen: set[int] = set()
        self.rows = Lower(RowScope(g.base.schema, lambda i: (self.seen.add(i), F.col(f"_{i}"))[1]), functions)
        self.of = [i for i, r in enumerate(g.base.joined.rs) for _ in r.columns]
        self.partial: list[list[Column]] = [[] for _ in g.base.joined.rs]
        self.grouping: set[int] = set()
        for e, _, _ in g.keys:
            self.rows.expr(e)
        self.grouping, self.seen = self.seen, set()

    def weight(self, but: int | None = None) -> Column:
        out = F.lit(1).cast("bigint")
        for i in range(len(self.partial)):
            if i != but:
                out = out * F.col(f"_m{i}")
        return out

    def put(self, side: int, c: Column) -> Column:
        name = f"_s{side}_{len(self.partial[side])}"
        self.partial[side].append(c.alias(name))
        return F.col(name)

    def expr(self, e):
        self.seen = set()
        return super().expr(e)

    def aggregate(self, name: str, b: _Bag) -> Typed:
        if name in ("ISEMPTY", "NONEMPTY"):
            return super().aggregate(name, b)
        if name == "COUNT":
            return Typed(F.coalesce(F.sum(self.weight()), F.lit(0).cast("bigint")), LONG)
        sides = {self.of[p] for p in self.seen}
        if b.cols is None or len(b.cols) != 1 or len(sides) != 1 or name == "MEDIAN":
            raise _NotPushed
        side, x = sides.pop(), b.cols[0]
        if name in ("MIN", "MAX"):
            own = B.aggregate(name, x)
            return Typed({"MIN": F.min, "MAX": F.max}[name](self.put(side, own.col)), own.type)
        own = B.aggregate("SUM", B.number(x))
        if name == "SUM":
            return Typed(F.sum(self.put(side, own.col) * self.weight(side)), own.type)
        n = F.sum(self.put(side, F.count(x.col)) * self.weight(side))
        return Typed(F.sum(self.put(side, F.sum(B.number(x).col.cast("double"))) * self.weight(side)) / F.when(n > 0, n), DOUBLE)


def _pushed(r: Relation, generate, functions: Functions) -> Relation:
    """GROUP of a JOIN with a FOREACH of aggregates: each input is summed up by its join keys and grouping fields, and these sums
    are joined. A key with a rows in one input and b in another takes a + b steps, not a * b."""
    g = r.grouped
    j, lower = g.base.joined, _JoinLower(g, functions)
    cols, fields = _items(generate, lower)
    having = [lower.predicate(by).alias(f"_h{i}") for i, (by, _) in enumerate(g.having)]
    df, start = None, 0
    for i, (own, keys) in enumerate(zip(j.rs, j.keys)):
        names = [f"_{start + k}" for k in range(len(own.columns))]
        by = [names[k] for k in range(len(names)) if start + k in lower.grouping]
        rows = own.df.select(*[F.col(c).alias(n) for c, n in zip(own.columns, names)], *[k.alias(f"_j{i}_{n}") for n, k in enumerate(keys)])
        if any(not isinstance(rows.schema[c].dataType, T.AtomicType) for c in by):
            raise _NotPushed
        on = [f"_j{i}_{n}" for n in range(len(keys))]
        part = rows.groupBy(*on, *by).agg(F.count(F.lit(1)).alias(f"_m{i}"), *lower.partial[i])
        start += len(names)
        if df is None:
            df = part
            continue
        same = None
        for n in range(len(keys)):
            one = F.col(f"_j0_{n}").cast(part.schema[f"_j{i}_{n}"].dataType) == F.col(f"_j{i}_{n}")
            same = one if same is None else same & one
        df = df.join(part, same)
    df = df.groupBy(*_key_columns(g)).agg(*[c.alias(f"_{i}") for i, c in enumerate(cols)], *having)
    for i in range(len(having)):
        df = df.where(f"_h{i}")
    return Relation(df.select(*[f"_{i}" for i in range(len(cols))]), Schema(tuple(fields)))


def _items(generate, lower: _GroupLower) -> tuple[list[Column], list[Field]]:
    cols, fields = [], []
    for g in generate:
        if isinstance(g.expr, t.Flatten) and g.expr.of in (t.Name("group"), t.Pos(0)) and not lower.g.everything:
            names = g.alias.type.fields if g.alias and isinstance(g.alias.type, TupleType) else (g.alias,) if g.alias else ()
            for i, (_, x, n) in enumerate(lower.g.keys):
                own = n if len(lower.g.keys) > 1 else "group"
                c, f = _named(Field(own, x.type), names[i] if i < len(names) else None, Typed(lower.key_column(i), x.type))
                cols.append(c)
                fields.append(f)
        elif isinstance(g.expr, (t.Flatten, t.Star)):
            raise NotFusable
        else:
            c, f = _named(lower.field(g.expr), g.alias, lower.expr(g.expr))
            cols.append(c)
            fields.append(f)
    return cols, fields


def _fused(r: Relation, generate, block, functions: Functions) -> Relation:
    """GROUP with a FOREACH of aggregates: a partial and a final aggregation, no bags."""
    g = r.grouped
    running = r.stream and not r.window
    over = None
    base = g.base.df
    if g.base.joined is not None and g.base.joined.df is base and not running and not block and not r.window and generate:
        try:
            return _pushed(r, generate, functions)
        except _NotPushed:
            pass
    if running:
        # Each row sees what came up to it.
        base = base.select("*", *_key_columns(g)).withColumn("_at", arrival(g.base))
        over = Window.partitionBy(*[f"_k{i}" for i in range(len(g.keys))]).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    lower = _lower_of(g, functions, over)
    having = [lower.predicate(by).alias(f"_h{i}") for i, (by, _) in enumerate(g.having)]
    for s in block:
        lower.define(s)
    cols, fields = _items(generate, lower)
    named = [c.alias(f"_{i}") for i, c in enumerate(cols)]
    if running:
        return Relation(base.select(*named), Schema(tuple(fields)), False, True)
    keys = _key_columns(g) + ([F.col(WINDOW)] if r.window else [])
    if lower.extra:
        base = base.select("*", *lower.extra)
    # Aggregates and keys may be mixed in one expression; constants and keys alone are allowed too.
    df = base.groupBy(*keys).agg(*named, *having) if cols or having else base.groupBy(*keys).agg(F.count("*"))
    for i in range(len(having)):
        df = df.where(f"_h{i}")
    return Relation(df.select(*[f"_{i}" for i in range(len(cols))]), Schema(tuple(fields)), False, r.stream)


def arrival(r: Relation) -> Column:
    """What orders the rows of a stream: its timestamp field, else the order of reading."""
    if r.schema is not None and r.schema.timestamp is not None:
        return F.struct(F.col(f"_{r.schema.timestamp}"), F.monotonically_increasing_id())
    return F.monotonically_increasing_id()


def _prefixes(g: Grouped, wanted: list[tuple[str, Column, T.DataType]]) -> DataFrame:
    """Aggregates of each prefix of all rows, without one task that reads them all: rows are sorted by ranges and written with their
    range and place; each range runs along its own rows, and starts from what the ranges before it add up to (one row a range)."""
    x = [c.alias(f"_x{i}") for i, (_, c, _) in enumerate(wanted)]
    rows = g.base.df.withColumn("_at", arrival(g.base)).orderBy("_at").select(*x, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"))
    rows = written(rows)
    steps: list[tuple[str, Callable[[Column], Column], Column]] = []
    for i, (name, _, _) in enumerate(wanted):
        c = F.col(f"_x{i}")
        if name == "AVG":
            steps += [("sum", F.sum, c.cast("double")), ("count", F.count, c)]
        else:
            steps.append((name.lower(), {"SUM": F.sum, "COUNT": F.count, "MIN": F.min, "MAX": F.max}[name], c))
    along = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("_p", *[f(c).over(along).alias(f"_o{k}") for k, (_, f, c) in enumerate(steps)])
    sums = rows.groupBy("_p").agg(*[f(c).alias(f"_s{k}") for k, (_, f, c) in enumerate(steps)])
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    again = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    before = sums.select("_p", *[again[kind](f"_s{k}").over(ahead).alias(f"_b{k}") for k, (kind, _, _) in enumerate(steps)])
    df = own.join(F.broadcast(before), "_p")  # a row for each range
    both = []
    for k, (kind, _, _) in enumerate(steps):
        a, b = F.col(f"_o{k}"), F.col(f"_b{k}")
        both.append({"sum": F.coalesce(a + b, a, b), "count": a + F.coalesce(b, F.lit(0)), "min": F.least(a, b), "max": F.greatest(a, b)}[kind])
    cols, k = [], 0
    for i, (name, _, kind) in enumerate(wanted):
        c = both[k] / F.when(both[k + 1] > 0, both[k + 1]) if name == "AVG" else both[k]
        cols.append(c.cast(kind).alias(f"_{i}"))
        k += 1 + (name == "AVG")
    return df.select(*cols)


def accumulate(r: Relation, generate, functions: Functions) -> Relation:
    """Aggregates of all rows; of each prefix of a stream, or, behind a GROUP, of each key."""
    if r.grouped and (r.grouped.having or r.grouped.sides):
        r = settled(r)
    g = r.grouped or Grouped(r, "\0", (), True)
    over, base = None, g.base.df
    if r.stream and not r.window:
        base = base.select("*", *_key_columns(g)).withColumn("_at", arrival(g.base))
        over = Window.partitionBy(*([f"_k{i}" for i in range(len(g.keys))] or [F.lit(0)])).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    lower, whole = _GroupLower(g, functions, over), []
    cols, fields = [], []
    for gen in generate:
        e = gen.expr
        if lower.key(e) is None and (not isinstance(e, t.Call) or e.name.upper() not in ("AVG", "SUM", "COUNT", "MIN", "MAX") or len(e.args) != 1):
            raise ScriptError("ACCUMULATE takes AVG, SUM, COUNT, MIN and MAX of one field each")
        if lower.key(e) is not None:
            x = lower.expr(e)
        else:
            b = lower.bag(e.args[0]) if r.grouped else None
            if b is None:
                got, f = lower.rows.ref(e.args[0])
                b = _Bag(None, [got], [replace(f, type=got.type)])
            x = lower.aggregate(e.name.upper(), b)
            name = e.name.upper()
            if name == "COUNT" or b.cols is not None and len(b.cols) == 1:
                whole.append((name, F.lit(1) if name == "COUNT" else B.number(b.cols[0]).col if name in ("SUM", "AVG") else b.cols[0].col, to_spark(x.type)))
        c, f = _named(Field("", x.type), gen.alias, x)
        cols.append(c)
        fields.append(f)
    named = [c.alias(f"_{i}") for i, c in enumerate(cols)]
    if over is not None and not g.keys and len(whole) == len(cols):
        return Relation(_prefixes(g, whole), Schema(tuple(fields)), False, r.stream)
    df = base.select(*named) if over is not None else base.groupBy(*_key_columns(g)).agg(*named).select(*[f"_{i}" for i in range(len(cols))])
    return Relation(df, Schema(tuple(fields)), False, r.stream)


def cogroup(rs: list[Relation], aliases: list[str], keys: list[tuple[t.Expr, ...]], functions: Functions) -> Relation:
    """Rows of all inputs by key, in one exchange: a tagged union, and a bag for each tag. Null keys form a group."""
    rs = [settled(r) for r in rs]
    if len({len(k) for k in keys}) != 1:
        raise ScriptError("COGROUP needs as many keys for each input")
    typed = [[(lower.expr(k), lower.field(k).name) for k in ks] for ks, lower in zip(keys, (Lower(RowScope.of(r), functions) for r in rs))]
    kinds = [t_[0].type for t_ in typed[0]]
    for other in typed[1:]:
        kinds = [escalate(a, x.type) for a, (x, _) in zip(kinds, other)]
    n, union = len(kinds), None
    for i, r in enumerate(rs):
        own = [x.col.cast(to_spark(kind)).alias(f"_k{j}") for j, ((x, _), kind) in enumerate(zip(typed[i], kinds))]
        cols = [(F.col(c) if j == i else F.lit(None).cast(q.df.schema[c].dataType)).alias(f"s{j}{c}") for j, q in enumerate(rs) for c in q.columns]
        part = r.df.select(*own, F.lit(i).alias("_side"), *cols)
        union = part if union is None else union.unionAll(part)
    group_type = CHARARRAY if n == 0 else kinds[0] if n == 1 else TupleType(fields=tuple(Field(nm, k) for (_, nm), k in zip(typed[0], kinds)))
    fields = [Field("group", group_type), *(Field(a, BagType(item=r.item())) for a, r in zip(aliases, rs))]
    key_refs = tuple((k, Typed(F.col(f"_k{j}"), kind), name) for j, (k, kind, (_, name)) in enumerate(zip(keys[0], kinds, typed[0])))
    made = Relation(union, Schema(tuple(fields)), grouped=Grouped(Relation(union, None), "\0", key_refs, n == 0, sides=tuple(zip(rs, aliases))))
    return made if all(r.schema is not None for r in rs) else build_cogroup(made)


def build_cogroup(r: Relation) -> Relation:
    """A bag for each side. Only scripts that use whole bags come here."""
    g = r.grouped
    sides = [F.struct(*[F.col(f"s{i}{c}").alias(c) for c in q.columns]) for i, (q, _) in enumerate(g.sides)]
    bags = [F.collect_list(F.when(F.col("_side") == i, x)).alias(f"_b{i}") for i, x in enumerate(sides)]
    df = g.base.df.groupBy(*[f"_k{j}" for j in range(len(g.keys))]).agg(*bags)
    return positional(df, [_group_value(g), *(F.col(f"_b{i}") for i in range(len(sides)))], list(r.schema.fields))


# -- joins
def _marked(r: Relation, mark: str) -> DataFrame:
    return r.df.select(*[F.col(c).alias(f"{mark}{c}") for c in r.df.columns])


def _joined(df: DataFrame, rs: list[Relation], aliases: list[str], marks: list[str], window: bool = False) -> Relation:
    if any(r.schema is None for r in rs):
        arrays = [F.col(f"{m}_raw") if r.schema is None else F.array(*[F.col(f"{m}{c}").cast("string") for c in r.columns]) for r, m in zip(rs, marks)]
        return Relation(df.select(F.concat(*arrays).alias("_raw")), None)
    cols = [F.col(f"{m}{c}") for r, m in zip(rs, marks) for c in r.columns]
    fields = [f for r, a in zip(rs, aliases) for f in r.schema.within(a)]
    return positional(df, cols, fields, rs[0])


def join(rs: list[Relation], aliases: list[str], keys: list[tuple[t.Expr, ...]], functions: Functions) -> Relation:
    """Inner equi-join; several inputs all meet on the first one's key. Null keys match nothing. Windows have to agree."""
    rs = [settled(r) for r in rs]
    if len({len(k) for k in keys}) != 1:
        raise ScriptError("JOIN needs as many keys for each input")
    if len({r.window for r in rs}) > 1:
        raise ScriptError("JOIN needs windows on all its inputs or on none")
    marks = [f"r{i}" for i in range(len(rs))]
    frames, columns = [], []
    for r, ks, m in zip(rs, keys, marks):
        lower = Lower(RowScope.of(r), functions)
        typed = [lower.expr(k) for k in ks]
        frames.append(r.df.select(*[F.col(c).alias(f"{m}{c}") for c in r.df.columns], *[x.col.alias(f"{m}k{j}") for j, x in enumerate(typed)]))
        columns.append(typed)
    df, compared = frames[0], [[None] * len(columns[0]) for _ in rs]
    for i in range(1, len(rs)):
        on = None
        for j, (a, b) in enumerate(zip(columns[0], columns[i])):
            if not compatible(a.type, b.type):
                raise ScriptError(f"can't join {a.type} with {b.type}")
            kind = to_spark(escalate(a.type, b.type))
            same = F.col(f"{marks[0]}k{j}").cast(kind) == F.col(f"{marks[i]}k{j}").cast(kind)
            compared[i][j] = b.col.cast(kind)
            on = same if on is None else on & same
        if rs[0].window:
            on = on & (F.col(f"{marks[0]}{WINDOW}") == F.col(f"{marks[i]}{WINDOW}"))
        df = df.join(frames[i], on, "inner")
    out = _joined(df, rs, aliases, marks)
    if out.schema is None or rs[0].window:
        return out
    compared[0] = [a.col for a in columns[0]]
    return replace(out, joined=Joined(tuple(rs), tuple(map(tuple, compared)), out.df))


def cross(rs: list[Relation], aliases: list[str]) -> Relation:
    """All combinations of rows; of each window, where the inputs have windows."""
    rs = [settled(r) for r in rs]
    marks = [f"r{i}" for i in range(len(rs))]
    df = _marked(rs[0], marks[0])
    for r, m in zip(rs[1:], marks[1:]):
        other = _marked(r, m)
        df = df.join(other, F.col(f"{marks[0]}{WINDOW}") == F.col(f"{m}{WINDOW}")) if r.window and rs[0].window else df.crossJoin(other)
    return _joined(df, rs, aliases, marks)


def indexed(r: Relation) -> DataFrame:
    """The rows with their position, _n. Each partition numbers its own rows and they are written to the shared folder with these
    numbers, so that a lost executor or a sort that would cut its ranges elsewhere changes nothing. One count for each partition reaches
    the driver and goes back as a table of as many rows."""
    spark = r.df.sparkSession
    part = written(r.df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts, starts, total = sorted(tuple(x) for x in part.groupBy("_p").count().collect()), [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    base = F.broadcast(spark.createDataFrame(starts, "_p int, _b bigint"))
    return part.join(base, "_p").withColumn("_n", F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def zip_(rs: list[Relation], aliases: list[str], with_index: bool) -> Relation:
    """Rows side by side by position, or each row with its position. A preceding ORDER fixes positions."""
    rs = [settled(r) for r in rs]
    if with_index:
        r = rs[0]
        df = indexed(r)
        if r.schema is None:
            return Relation(df.select(F.concat("_raw", F.array(F.col("_n").cast("string"))).alias("_raw")), None)
        return positional(df, [*(F.col(c) for c in r.columns), F.col("_n")], [*r.schema.fields, Field("index", LONG)], r)
    df = None
    marks = [f"r{i}" for i in range(len(rs))]
    for r, m in zip(rs, marks):
        own = indexed(r).select(*[F.col(c).alias(f"{m}{c}") for c in r.columns], F.col("_n"))
        df = own if df is None else df.join(own, "_n")
    return _joined(df, rs, aliases, marks)


# -- sets
def union(rs: list[Relation]) -> Relation:
    """A bag union by position, names from the first input, types wide enough for all."""
    rs = [settled(r) for r in rs]
    if any(r.schema is None for r in rs) or len({len(r.schema.fields) for r in rs}) > 1:
        raw = [r.df.select(F.col("_raw") if r.schema is None else F.array(*[F.col(c).cast("string") for c in r.columns]).alias("_raw")) for r in rs]
        df = raw[0]
        for other in raw[1:]:
            df = df.unionAll(other)
        return Relation(df, None)
    fields = list(rs[0].schema.fields)
    for r in rs[1:]:
        fields = [replace(a, type=escalate(a.type, b.type)) for a, b in zip(fields, r.schema.fields)]
    df = None
    for r in rs:
        own = r.df.select(*[F.col(c).cast(to_spark(f.type)).alias(c) for c, f in zip(r.columns, fields)], *([WINDOW] if r.window else []))
        df = own if df is None else df.unionAll(own)
    return Relation(df, Schema(tuple(fields)), rs[0].window, rs[0].stream)


def _same(a: Relation, b: Relation) -> Relation:
    if (a.schema is None) != (b.schema is None) or a.schema and len(a.schema.fields) != len(b.schema.fields):
        raise ScriptError("both inputs need the same number of fields")
    if a.schema is None:
        return b
    return replace(b, df=b.df.select(*[F.col(c).cast(to_spark(f.type)).alias(c) for c, f in zip(b.columns, a.schema.fields)]))


def intersection(a: Relation, b: Relation) -> Relation:
    a, b = settled(a), settled(b)
    return replace(a, df=a.df.select(*a.columns).intersect(_same(a, b).df))


def difference(a: Relation, b: Relation, keys, functions: Functions) -> Relation:
    """Rows of the first input with no equal row, or no equal key, in the second; duplicates stay."""
    a, b = settled(a), settled(b)
    if keys is None:
        left, right = [F.col(c) for c in a.columns], [F.col(c) for c in _same(a, b).columns]
        frame = _same(a, b).df
    else:
        left = [Lower(RowScope.of(a), functions).expr(k).col for k in keys[0]]
        right = [Lower(RowScope.of(b), functions).expr(k).col for k in keys[1]]
        frame = b.df
    if len(left) != len(right):
        raise ScriptError("DIFFERENCE needs as many keys for each input")
    gone = frame.select(*[c.alias(f"d{i}") for i, c in enumerate(right)]).distinct()
    own = a.df.select("*", *[c.alias(f"e{i}") for i, c in enumerate(left)])
    on = None
    for i in range(len(left)):
        same = F.col(f"e{i}").eqNullSafe(F.col(f"d{i}")) if keys is None else F.col(f"e{i}") == F.col(f"d{i}")
        on = same if on is None else on & same
    return replace(a, df=own.join(gone, on, "left_anti").select(*a.df.columns))


# -- the rest
def order(r: Relation, by, functions: Functions) -> Relation:
    """A global sort; each key has its own direction."""
    r = settled(r)
    if isinstance(by[0][0], t.Star):
        keys = [(F.col(c) if r.schema else F.col("_raw"), by[0][1]) for c in r.columns]
    else:
        lower = Lower(RowScope.of(r), functions)
        keys = [(lower.expr(ref).col, ascending) for ref, ascending in by]
    cols = [c.asc() if ascending else c.desc() for c, ascending in keys]
    return replace(r, df=r.df.orderBy(*([F.col(WINDOW)] if r.window else []), *cols))


def limit(r: Relation, n: int) -> Relation:
    r = settled(r)
    return replace(r, df=r.df.limit(n))


def distinct(r: Relation) -> Relation:
    """Equal rows once; in each window, where there are windows."""
    r = settled(r)
    return replace(r, df=r.df.distinct())


def sample(r: Relation, fraction: t.Expr, functions: Functions, seed: int | None) -> Relation:
    """Each row with the given probability. An expression over fields gives each row its own."""
    r = settled(r)
    if isinstance(fraction, t.Lit):
        if not 0 <= float(fraction.value) <= 1:
            raise ScriptError("SAMPLE needs a fraction from 0 to 1")
        if not r.df.isStreaming:
            return replace(r, df=r.df.sample(False, float(fraction.value), seed))
    return replace(r, df=r.df.where((F.rand(seed) if seed is not None else F.rand()) < Lower(RowScope.of(r), functions).expr(fraction).col))


_LEVELS = {"memory_only": StorageLevel.MEMORY_ONLY, "memory_and_disk": StorageLevel.MEMORY_AND_DISK, "disk_only": StorageLevel.DISK_ONLY}


def cache(r: Relation, mode: str) -> Relation:
    r = settled(r)
    if mode == "none" or r.df.isStreaming:
        return r
    base = mode.removesuffix("_2").removesuffix("_ser")
    level = _LEVELS[base]
    if mode.endswith("_2"):
        level = StorageLevel(level.useDisk, level.useMemory, level.useOffHeap, level.deserialized, 2)
    return replace(r, df=r.df.persist(level))


def delay(r: Relation, wait: float, factor: int) -> Relation:
    """Waits once in each partition, then repeats each row, or keeps a random share of 1/-factor."""
    r = settled(r)
    df = r.df
    if wait > 0:

        def slow(batches):
            import time

            time.sleep(wait)
            yield from batches

        df = df.mapInArrow(slow, df.schema)
    if factor > 0:
        df = df.withColumn("_t", F.explode(F.array_repeat(F.lit(1), factor))).drop("_t")
    elif factor < 0:
        df = df.sample(False, 1 / -factor)
    return replace(r, df=df)


def tuplify(r: Relation, on: t.Expr, functions: Functions) -> Relation:
    """Triples of one subject (or other field) as one wide tuple: the field, a map from predicate to object, and a bag of all pairs. Of a
    predicate that occurs more than once the map has the smallest object, as a map holds one value a key; the bag keeps each."""
    r = settled(r)
    if r.schema is None or len(r.schema.fields) != 3:
        raise ScriptError("TUPLIFY needs triples")
    lower = Lower(RowScope.of(r), functions)
    x, f = lower.ref(on)
    at = on.index if isinstance(on, t.Pos) else r.schema.find(on.name, on.lineage)
    rest = [i for i in range(3) if i != at]
    pair = F.struct(F.col(f"_{rest[0]}").cast("string"), F.col(f"_{rest[1]}").cast("string"))
    df = r.df.select(x.col.alias("_k"), pair.getField("col1").alias("_p"), pair.getField("col2").alias("_o"))
    df = df.groupBy("_k", "_p").agg(F.min("_o").alias("_o"), F.array_sort(F.collect_list(F.struct(F.col("_p").alias("_0"), F.col("_o").alias("_1")))).alias("_a"))
    df = df.groupBy("_k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_p", "_o"))))).alias("_m"), F.flatten(F.array_sort(F.collect_list("_a"))).alias("_a"))
    from ..types import BagType, MapType, TupleType

    names = [r.schema.fields[i].name for i in rest]
    item = TupleType(fields=tuple(Field(n, CHARARRAY) for n in names))
    return positional(df, [F.col("_k"), F.col("_m"), F.col("_a")], [f, Field("values", MapType(value=CHARARRAY)), Field("pairs", BagType(item=item))])


__all__ = ["DOUBLE", "Relation", "positional", "settled"]

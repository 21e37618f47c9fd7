"""Lowering of expressions to typed Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import builtins as B
from ..functions.builtins import Typed
from ..plans import tree as t
from ..types import BOOLEAN, BYTEARRAY, CHARARRAY, DOUBLE, GEOMETRY, INT, LONG, NUMERIC, BagType, Field, MapType, MatrixType, Schema, ScriptError, TupleType, Type, escalate, from_spark, to_spark

WINDOW = "_w"


@dataclass(frozen=True)
class Relation:
    """A bag. Columns are positional (_0, _1, ...), or one array _raw where the arity isn't known; names live in the schema.
    ``window``: whether a hidden column tells the window of each row. ``stream``: aggregates run along with the rows."""

    df: DataFrame
    schema: Schema | None
    window: bool = False
    stream: bool = False
    grouped: Grouped | None = field(default=None, compare=False)
    deferred: tuple = ()
    #: A live stream whose windows come whole in a micro-batch: what follows is run on each batch.
    whole: bool = False
    #: What a JOIN was made of, as long as ``df`` is still its result.
    joined: Joined | None = field(default=None, compare=False)
    #: What a PARTITION or INDEX laid out: its result, and the relation before.
    laid: tuple | None = field(default=None, compare=False)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != WINDOW]

    def item(self) -> TupleType:
        return TupleType(fields=self.schema.fields if self.schema else None)


@dataclass(frozen=True)
class Grouped:
    """A GROUP whose bags aren't built yet. ``having``: FILTERs on its groups. ``sides``: the inputs of a COGROUP with their aliases;
    its base has their rows one below the other, each in columns of its own."""

    base: Relation
    alias: str
    keys: tuple[tuple[t.Expr, Typed, str], ...]
    everything: bool
    having: tuple[tuple[t.Expr, Functions], ...] = ()
    sides: tuple[tuple[Relation, str], ...] = ()


@dataclass(frozen=True)
class Joined:
    """The inputs of a JOIN, their keys as the columns are compared, and the result."""

    rs: tuple[Relation, ...]
    keys: tuple[tuple[Column, ...], ...]
    df: DataFrame


class Scope:
    """Where references are looked up."""

    def get(self, ref: t.Expr) -> tuple[Typed, Field]:
        raise NotImplementedError


class RowScope(Scope):
    """Fields of a relation's rows, or of a tuple given as a struct column."""

    def __init__(self, schema: Schema | None, column: Callable[[int], Column], raw: Callable[[], Column] | None = None):
        self.schema, self.column, self.raw = schema, column, raw

    @classmethod
    def of(cls, r: Relation) -> RowScope:
        return cls(r.schema, lambda i: F.col(f"_{i}"), lambda: F.col("_raw"))

    @classmethod
    def inside(cls, x: Column, item: TupleType) -> RowScope:
        return cls(None if item.fields is None else Schema(item.fields), lambda i: x.getField(f"_{i}"), lambda: x.getField("_raw"))

    def get(self, ref: t.Expr) -> tuple[Typed, Field]:
        if self.schema is None:
            if not isinstance(ref, t.Pos):
                raise ScriptError(f"{show(ref)} needs a schema; there is none, so use $0, $1, ...")
            return Typed(F.get(self.raw(), F.lit(ref.index)), BYTEARRAY), Field("", BYTEARRAY)
        i = ref.index if isinstance(ref, t.Pos) else self.schema.find(ref.name, ref.lineage)
        if not 0 <= i < len(self.schema.fields):
            raise ScriptError(f"no field ${i} in {self.schema}")
        f = self.schema.fields[i]
        return Typed(self.column(i), f.type), f


def show(e) -> str:
    if isinstance(e, t.Pos):
        return f"${e.index}"
    if isinstance(e, t.Name):
        return "::".join([*e.lineage, e.name])
    return type(e).__name__.lower()


@dataclass
class Functions:
    """What a session knows of functions: Python ones and aliases with bound arguments."""

    spark: object
    python: dict[str, tuple[Callable, Type]] = field(default_factory=dict)
    aliases: dict[str, tuple[str, tuple]] = field(default_factory=dict)

    def is_aggregate(self, name: str) -> bool:
        return name.upper() in B.AGGREGATES

    def call(self, lower: Lower, call: t.Call) -> Typed:
        if call.name in self.aliases:
            target, bound = self.aliases[call.name]
            return lower.expr(t.Call(target, (*(t.Lit(v) for v in bound), *call.args)))
        name = call.name.upper()
        if call.name in self.python:
            fn, kind = self.python[call.name]
            return Typed(fn(*[lower.expr(a).col for a in call.args]), kind)
        if name in ("TOKENIZE", "STRSPLIT"):
            if not 1 <= len(call.args) <= 2:
                raise ScriptError(f"{call.name} takes a text and perhaps a pattern")
            pattern = None
            if len(call.args) == 2:
                if not isinstance(call.args[1], t.Lit) or not isinstance(call.args[1].value, str):
                    raise ScriptError(f"the pattern of {call.name} has to be a literal")
                pattern = call.args[1].value
            return B.split_function(name, lower.expr(call.args[0]), pattern)
        if name in B.AGGREGATES:
            if len(call.args) != 1:
                raise ScriptError(f"{call.name} takes one bag")
            return B.over_bag(name, lower.expr(call.args[0]))
        if name in B.SCALAR:
            least, most, fn = B.SCALAR[name]
            if not least <= len(call.args) <= most:
                raise ScriptError(f"{call.name} takes {least} to {most} arguments, not {len(call.args)}")
            return fn([lower.expr(a) for a in call.args])
        if "." not in call.name and self.spark.catalog.functionExists(call.name.lower()):
            return Typed(F.call_function(call.name.lower(), *[lower.expr(a).col for a in call.args]), BYTEARRAY)
        raise ScriptError(f"no function {call.name!r}")


class Lower:
    """Expressions over one scope. ``env`` has the aliases of a nested block."""

    def __init__(self, scope: Scope, functions: Functions, env: dict[str, Typed] | None = None):
        self.scope, self.functions, self.env = scope, functions, env or {}

    def ref(self, e: t.Expr) -> tuple[Typed, Field]:
        if isinstance(e, t.Name) and not e.lineage and e.name in self.env:
            x = self.env[e.name]
            return x, Field(e.name, x.type)
        return self.scope.get(e)

    def field(self, e: t.Expr) -> Field:
        """The field that an expression without AS makes: a reference's own, else a nameless one."""
        if isinstance(e, (t.Name, t.Pos)):
            return self.ref(e)[1]
        if isinstance(e, t.Deref) and isinstance(e.field, t.Name):
            return Field(e.field.name, BYTEARRAY)
        return Field("", BYTEARRAY)

    def expr(self, e: t.Expr) -> Typed:
        return getattr(self, "x_" + type(e).__name__.lower())(e)

    def x_pos(self, e):
        return self.ref(e)[0]

    x_name = x_pos

    def x_lit(self, e):
        v = e.value
        if isinstance(v, bool):
            return Typed(F.lit(v), BOOLEAN)
        if isinstance(v, int):
            return Typed(F.lit(v), INT if -(1 << 31) <= v < 1 << 31 else LONG)
        return Typed(F.lit(v), DOUBLE if isinstance(v, float) else CHARARRAY)

    def x_deref(self, e):
        base = self.expr(e.base)
        if isinstance(base.type, TupleType):
            return RowScope.inside(base.col, base.type).get(e.field)[0]
        if isinstance(base.type, BagType):
            return self.project(base, [e.field])
        raise ScriptError(f"{show(e.base)} is a {base.type.name}, which has no fields")

    def project(self, bag: Typed, refs: list[t.Expr]) -> Typed:
        """Some columns of a bag, as a bag."""
        got = [RowScope.inside(F.lit(None), bag.type.item).get(r)[1] for r in refs]
        col = F.transform(bag.col, lambda x: F.struct(*[RowScope.inside(x, bag.type.item).get(r)[0].col.alias(f"_{i}") for i, r in enumerate(refs)]))
        return Typed(col, BagType(item=TupleType(fields=tuple(got))))

    def x_lookup(self, e):
        base = self.expr(e.base)
        if isinstance(base.type, MapType):
            return Typed(F.try_element_at(base.col, F.lit(e.key)), base.type.value)
        raise ScriptError(f"{show(e.base)} is a {base.type.name}, not a map")

    def x_binary(self, e):
        a, b = self.expr(e.left), self.expr(e.right)
        if e.op == "+" and CHARARRAY in (a.type, b.type):
            return Typed(F.concat(B.text(a), B.text(b)), CHARARRAY)
        a, b = B.number(a), B.number(b)
        kind = escalate(a.type, b.type)
        if e.op == "/" and kind in (INT, LONG):
            return Typed(F.call_function("div", a.col, b.col).cast(to_spark(kind)), kind)
        out = {"+": lambda: a.col + b.col, "-": lambda: a.col - b.col, "*": lambda: a.col * b.col, "/": lambda: a.col / b.col}[e.op]()
        return Typed(out if e.op != "/" else out.cast(to_spark(kind)), kind)

    def x_negative(self, e):
        x = B.number(self.expr(e.of))
        return Typed(-x.col, x.type)

    def x_cast(self, e):
        x = self.expr(e.of)
        if isinstance(e.type, TupleType) and isinstance(x.type, TupleType) and x.type.fields:
            fields = tuple(Field(f.name, g.type) for f, g in zip(x.type.fields, e.type.fields or ()))
            if len(fields) != len(x.type.fields):
                raise ScriptError(f"can't cast {x.type} to {e.type}")
            return Typed(F.struct(*[x.col.getField(f"_{i}").cast(to_spark(f.type)).alias(f"_{i}") for i, f in enumerate(fields)]), TupleType(fields=fields))
        if isinstance(e.type, MapType) and isinstance(x.type, MapType):
            return x
        if e.type in (CHARARRAY, BYTEARRAY):
            return Typed(B.text(x), e.type)
        # Text of a fraction can become a whole number, as text "1.5" can't be cast directly.
        return Typed(x.col.cast(to_spark(e.type)), e.type)

    def x_call(self, e):
        return self.functions.call(self, e)

    def x_flatten(self, e):
        raise ScriptError("FLATTEN can only stand for itself in GENERATE")

    def x_maketuple(self, e):
        xs = [self.expr(i) for i in e.items]
        fields = tuple(Field(self.field(i).name, x.type) for i, x in zip(e.items, xs))
        return Typed(F.struct(*[x.col.alias(f"_{k}") for k, x in enumerate(xs)]), TupleType(fields=fields))

    def x_makebag(self, e):
        xs = [self.expr(i) for i in e.items]
        kind = xs[0].type if xs else BYTEARRAY
        for x in xs[1:]:
            kind = escalate(kind, x.type)
        if isinstance(kind, TupleType):
            return Typed(F.array(*[x.col for x in xs]), BagType(item=kind))
        cols = [F.struct(x.col.cast(to_spark(kind)).alias("_0")) for x in xs]
        item = TupleType(fields=(Field("", kind),))
        return Typed(F.array(*cols) if cols else F.array().cast(to_spark(BagType(item=item))), BagType(item=item))

    def x_makemap(self, e):
        return B.make_map([self.expr(i) for i in e.items])

    def x_makematrix(self, e):
        """Values fill the columns one after another. A sparse matrix keeps the values other than 0 with their places."""
        kind = MatrixType(kind=e.kind, rows=e.rows, cols=e.cols)
        unit = to_spark(INT if e.kind[1] == "i" else DOUBLE)
        xs = [self.expr(i) for i in e.items]
        if len(xs) == 1 and isinstance(xs[0].type, BagType):
            values = F.transform(xs[0].col, lambda x: x.getField("_0").cast(unit))
        else:
            values = F.array(*[x.col.cast(unit) for x in xs])
        size = F.lit(e.rows * e.cols)
        values = F.when(F.size(values) == size, values).otherwise(F.raise_error(F.lit(f"a {e.rows}x{e.cols} matrix needs {e.rows * e.cols} values")))
        head = [F.lit(e.rows).alias("rows"), F.lit(e.cols).alias("cols")]
        if e.kind[0] == "d":
            return Typed(F.struct(*head, values.alias("values")), kind)
        at = F.filter(F.transform(values, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
        return Typed(F.struct(*head, F.filter(values, lambda x: x != 0).alias("values"), at.alias("at")), kind)

    def x_makegeometry(self, e):
        times = [self.expr(x).col.cast("double") for x in e.times]
        start = times[0] if times else F.lit(None).cast("double")
        end = times[1] if len(times) > 1 else start
        return Typed(F.struct(B.text(self.expr(e.wkt)).alias("wkt"), start.alias("t_start"), end.alias("t_end")), GEOMETRY)

    # -- predicates
    def x_compare(self, e):
        a, b = self.expr(e.left), self.expr(e.right)
        if a.type != b.type:
            numbers = [x.type.name in NUMERIC for x in (a, b)]
            if all(numbers):
                pass
            elif numbers[0] and b.type in (BYTEARRAY, CHARARRAY):
                b = Typed(b.col.try_cast("double"), DOUBLE)
            elif numbers[1] and a.type in (BYTEARRAY, CHARARRAY):
                a = Typed(a.col.try_cast("double"), DOUBLE)
            elif BOOLEAN in (a.type, b.type) and BYTEARRAY in (a.type, b.type):
                a, b = (x if x.type == BOOLEAN else Typed(x.col.cast("boolean"), BOOLEAN) for x in (a, b))
            elif not {a.type, b.type} <= {CHARARRAY, BYTEARRAY}:
                raise ScriptError(f"can't compare {a.type} with {b.type}")
        return Typed({"==": a.col == b.col, "!=": a.col != b.col, "<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[e.op], BOOLEAN)

    def x_and(self, e):
        return Typed(self.predicate(e.left) & self.predicate(e.right), BOOLEAN)

    def x_or(self, e):
        return Typed(self.predicate(e.left) | self.predicate(e.right), BOOLEAN)

    def x_not(self, e):
        return Typed(~self.predicate(e.of), BOOLEAN)

    def predicate(self, e: t.Expr) -> Column:
        x = self.expr(e)
        if x.type not in (BOOLEAN, BYTEARRAY):
            raise ScriptError(f"a condition is needed, not {x.type}")
        return x.col if x.type == BOOLEAN else x.col.cast("boolean")


def type_of_column(df: DataFrame, name: str) -> Type:
    return from_spark(df.schema[name].dataType)

"""Types and schemas of the script language, and their Spark counterparts."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T


class ScriptError(ValueError):
    """A script that can't be parsed, resolved or typed."""


@dataclass(frozen=True)
class Type:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class TupleType(Type):
    """``fields`` is None where the arity isn't known."""

    name: str = "tuple"
    fields: tuple[Field, ...] | None = ()

    def __str__(self) -> str:
        return "(" + ", ".join(map(str, self.fields or ())) + ")"


@dataclass(frozen=True)
class BagType(Type):
    name: str = "bag"
    item: TupleType = TupleType()

    def __str__(self) -> str:
        return "{" + str(self.item) + "}"


@dataclass(frozen=True)
class MapType(Type):
    name: str = "map"
    value: Type = Type("bytearray")

    def __str__(self) -> str:
        return f"[{self.value}]"


@dataclass(frozen=True)
class MatrixType(Type):
    name: str = "matrix"
    kind: str = "dd"
    rows: int = 0
    cols: int = 0

    def __str__(self) -> str:
        return f"{self.kind}matrix({self.rows},{self.cols})"


@dataclass(frozen=True)
class Field:
    name: str
    type: Type
    lineage: tuple[str, ...] = ()

    def __str__(self) -> str:
        return "::".join([*self.lineage, self.name]) + f": {self.type}"


INT, LONG, FLOAT, DOUBLE, BOOLEAN, CHARARRAY, BYTEARRAY, ANY = (Type(n) for n in ("int", "long", "float", "double", "boolean", "chararray", "bytearray", "any"))
GEOMETRY = Type("geometry")
SIMPLE = {t.name: t for t in (INT, LONG, FLOAT, DOUBLE, BOOLEAN, CHARARRAY, BYTEARRAY)}
_RANK = {"bytearray": 0, "int": 1, "long": 2, "float": 3, "double": 4}
NUMERIC = frozenset(("int", "long", "float", "double"))


def escalate(a: Type, b: Type) -> Type:
    """The type that holds both: the wider number, or bytearray where nothing fits."""
    if a == b:
        return a
    if a.name in _RANK and b.name in _RANK:
        return a if _RANK[a.name] >= _RANK[b.name] else b
    if {a.name, b.name} == {"chararray", "bytearray"}:
        return CHARARRAY
    if isinstance(a, TupleType) and isinstance(b, TupleType) and a.fields and b.fields and len(a.fields) == len(b.fields):
        return TupleType(fields=tuple(replace(x, type=escalate(x.type, y.type)) for x, y in zip(a.fields, b.fields)))
    if isinstance(a, BagType) and isinstance(b, BagType):
        item = escalate(a.item, b.item)
        return BagType(item=item) if isinstance(item, TupleType) else BYTEARRAY
    return BYTEARRAY


def compatible(a: Type, b: Type) -> bool:
    if a == b or "any" in (a.name, b.name):
        return True
    simple = [t.name for t in (a, b)]
    if all(n in NUMERIC for n in simple) or "bytearray" in simple and all(n in NUMERIC | {"bytearray", "chararray"} for n in simple):
        return True
    if isinstance(a, BagType) and isinstance(b, BagType):
        return compatible(a.item, b.item)
    if isinstance(a, TupleType) and isinstance(b, TupleType):
        return a.fields is None or b.fields is None or len(a.fields) == len(b.fields) and all(compatible(x.type, y.type) for x, y in zip(a.fields, b.fields))
    return False


def _within(part: tuple[str, ...], whole: tuple[str, ...]) -> bool:
    """Whether the names occur in this order."""
    rest = iter(whole)
    return all(p in rest for p in part)


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]
    timestamp: int | None = field(default=None, compare=False)

    def find(self, name: str, lineage: tuple[str, ...] = ()) -> int:
        """Position of a name. A bare name has to be unique; a qualified one must match its lineage."""
        hits = [i for i, f in enumerate(self.fields) if f.name == name and (not lineage or f.lineage[-len(lineage) :] == lineage)]
        if lineage and not hits:  # the alias of a later join, before names that an earlier one gave
            hits = [i for i, f in enumerate(self.fields) if f.name == name and _within(lineage, f.lineage)]
        if lineage and len(hits) > 1:
            hits = [i for i in hits if self.fields[i].lineage == lineage] or hits
        if len(hits) > 1:
            raise ScriptError(f"field {name!r} is ambiguous: {', '.join(str(self.fields[i]) for i in hits)}")
        if not hits:
            raise ScriptError(f"no field {'::'.join([*lineage, name])!r} in {self}")
        return hits[0]

    def within(self, alias: str) -> tuple[Field, ...]:
        """The fields with an alias put before their lineage."""
        return tuple(replace(f, lineage=(alias, *f.lineage)) for f in self.fields)

    def __str__(self) -> str:
        return "{" + ", ".join(map(str, self.fields)) + "}"


_SPARK = {"int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "chararray": T.StringType(), "bytearray": T.StringType()}
GEOMETRY_STRUCT = T.StructType([T.StructField("wkt", T.StringType()), T.StructField("t_start", T.DoubleType()), T.StructField("t_end", T.DoubleType())])


def to_spark(t: Type) -> T.DataType:
    if t.name in _SPARK:
        return _SPARK[t.name]
    if isinstance(t, TupleType):
        if t.fields is None:
            return T.StructType([T.StructField("_raw", T.ArrayType(T.StringType()))])
        return T.StructType([T.StructField(f"_{i}", to_spark(f.type)) for i, f in enumerate(t.fields)])
    if isinstance(t, BagType):
        return T.ArrayType(to_spark(t.item))
    if isinstance(t, MapType):
        return T.MapType(T.StringType(), to_spark(t.value))
    if isinstance(t, MatrixType):
        values = T.IntegerType() if t.kind[1] == "i" else T.DoubleType()
        dense = [T.StructField("rows", T.IntegerType()), T.StructField("cols", T.IntegerType()), T.StructField("values", T.ArrayType(values))]
        return T.StructType(dense + [T.StructField("at", T.ArrayType(T.IntegerType()))] * (t.kind[0] == "s"))
    if t == GEOMETRY:
        return GEOMETRY_STRUCT
    raise ScriptError(f"no Spark type for {t}")


def from_spark(t: T.DataType) -> Type:
    """The type of a column that comes with a schema of its own; what the language lacks is text."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return INT
    for kind, out in ((T.LongType, LONG), (T.FloatType, FLOAT), (T.DoubleType, DOUBLE), (T.BooleanType, BOOLEAN), (T.DecimalType, DOUBLE)):
        if isinstance(t, kind):
            return out
    if isinstance(t, T.StructType):
        return TupleType(fields=tuple(Field(f.name, from_spark(f.dataType)) for f in t.fields))
    if isinstance(t, T.ArrayType):
        item = from_spark(t.elementType)
        return BagType(item=item if isinstance(item, TupleType) else TupleType(fields=(Field("", item),)))
    if isinstance(t, T.MapType):
        return MapType(value=from_spark(t.valueType))
    return CHARARRAY

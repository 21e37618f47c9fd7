"""Scalar and bag functions of the language as Spark columns. Each takes typed arguments and gives a typed column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import ANY, BOOLEAN, BYTEARRAY, CHARARRAY, DOUBLE, GEOMETRY, INT, LONG, NUMERIC, BagType, Field, MapType, ScriptError, TupleType, Type, to_spark


@dataclass(frozen=True)
class Typed:
    col: Column
    type: Type


AGGREGATES = frozenset(("COUNT", "SUM", "AVG", "MIN", "MAX", "MEDIAN"))
TOKENS = BagType(item=TupleType(fields=(Field("", CHARARRAY),)))


def number(x: Typed) -> Typed:
    """An argument as a number; text that has no type becomes double."""
    if x.type.name in NUMERIC:
        return x
    if x.type in (BYTEARRAY, CHARARRAY):
        return Typed(x.col.cast("double"), DOUBLE)
    raise ScriptError(f"a number is needed, not {x.type}")


def text(x: Typed) -> Column:
    return x.col if x.type in (CHARARRAY, BYTEARRAY) else x.col.cast("string")


def literal(x: Typed, value) -> str:
    if not isinstance(value, str):
        raise ScriptError("a pattern has to be a literal")
    return value


def split_text(s: Column, pattern: str) -> Column:
    """Parts between matches, without empty ones at the end; text of separators alone has no part, empty text has one."""
    bare = F.regexp_replace(s, f"(?:{pattern})+$", "")
    return F.when(s == "", F.array(F.lit(""))).when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, pattern))


def singles(values: Column) -> Column:
    """A bag of one-field tuples."""
    return F.transform(values, lambda x: F.struct(x.alias("_0")))


def item_of(bag: Typed) -> Field:
    if not isinstance(bag.type, BagType) or not bag.type.item.fields or len(bag.type.item.fields) != 1:
        raise ScriptError(f"a bag of one field is needed, not {bag.type}")
    return bag.type.item.fields[0]


def over_bag(name: str, bag: Typed) -> Typed:
    """An aggregate of a bag that is there as an array. Nulls count for COUNT alone."""
    if name == "COUNT":
        return Typed(F.size(bag.col).cast("bigint"), LONG)
    f = item_of(bag)
    values = F.filter(F.transform(bag.col, lambda x: x.getField("_0")), lambda x: x.isNotNull())
    kind = f.type
    if kind.name not in NUMERIC and name in ("SUM", "AVG", "MEDIAN"):
        values, kind = F.transform(values, lambda x: x.cast("double")), DOUBLE
    if name == "MIN":
        return Typed(F.array_min(values), kind)
    if name == "MAX":
        return Typed(F.array_max(values), kind)
    if name == "MEDIAN":
        return Typed(F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int")), kind)
    wide = LONG if kind.name in ("int", "long") else DOUBLE
    total = F.aggregate(values, F.lit(0).cast(to_spark(wide)), lambda a, x: a + x.cast(to_spark(wide)))
    if name == "SUM":
        return Typed(F.when(F.size(values) > 0, total), wide)
    return Typed(F.when(F.size(values) > 0, total.cast("double") / F.size(values)), DOUBLE)


def aggregate(name: str, x: Typed | None, distinct: bool = False) -> Typed:
    """The same over the rows of a group."""
    if name == "COUNT":
        return Typed(F.count(F.lit(1)) if x is None else F.count_distinct(x.col) if distinct else F.count(x.col), LONG)
    if x.type.name not in NUMERIC and name in ("SUM", "AVG", "MEDIAN"):
        x = Typed(x.col.cast("double"), DOUBLE)
    if name == "SUM":
        return Typed(F.sum_distinct(x.col) if distinct else F.sum(x.col), LONG if x.type.name in ("int", "long") else DOUBLE)
    if name == "AVG":
        return Typed(F.expr("avg(DISTINCT _x)") if distinct else F.avg(x.col), DOUBLE)
    return Typed({"MIN": F.min, "MAX": F.max}[name](x.col), x.type)


def _isempty(x: Typed) -> Column:
    return F.size(x.col) == 0 if isinstance(x.type, (BagType, MapType)) else F.length(text(x)) == 0


def _tomap(args: list[Typed]) -> Typed:
    if len(args) == 1 and isinstance(args[0].type, BagType):
        fields = args[0].type.item.fields
        if not fields or len(fields) != 2:
            raise ScriptError("TOMAP needs a bag of pairs")
        return Typed(F.map_from_entries(F.transform(args[0].col, lambda x: F.struct(x.getField("_0").cast("string"), x.getField("_1")))), MapType(value=fields[1].type))
    return make_map(args)


def make_map(args: list[Typed]) -> Typed:
    if len(args) % 2:
        raise ScriptError("a map needs a value for each key")
    kinds = {a.type for a in args[1::2]}
    value = kinds.pop() if len(kinds) == 1 else CHARARRAY
    return Typed(F.create_map(*[text(a) if i % 2 == 0 else a.col.cast(to_spark(value)) for i, a in enumerate(args)]) if args else F.create_map().cast("map<string,string>"), MapType(value=value))


def _substring(args: list[Typed]) -> Typed:
    s, start = text(args[0]), args[1].col.cast("int")
    end = args[2].col.cast("int") if len(args) > 2 else F.length(s)
    return Typed(F.substring(s, start + 1, end - start), CHARARRAY)


def _distance(args: list[Typed]) -> Typed:
    from ..operators.spatial import distance

    if any(a.type != GEOMETRY for a in args):
        raise ScriptError("S_DISTANCE needs two geometries")
    return Typed(distance(args[0].col, args[1].col), DOUBLE)


#: Name: (least, most arguments, implementation).
SCALAR = {
    "ISEMPTY": (1, 1, lambda a: Typed(_isempty(a[0]), BOOLEAN)),
    "NONEMPTY": (1, 1, lambda a: Typed(~_isempty(a[0]), BOOLEAN)),
    "TRIM": (1, 1, lambda a: Typed(F.regexp_replace(text(a[0]), r"^[\x00-\x20]+|[\x00-\x20]+$", ""), CHARARRAY)),
    "SUBSTRING": (2, 3, _substring),
    "STARTSWITH": (2, 2, lambda a: Typed(F.startswith(text(a[0]), text(a[1])), BOOLEAN)),
    "ENDSWITH": (2, 2, lambda a: Typed(F.endswith(text(a[0]), text(a[1])), BOOLEAN)),
    "STRLEN": (1, 1, lambda a: Typed(F.length(text(a[0])), INT)),
    "LOWER": (1, 1, lambda a: Typed(F.lower(text(a[0])), CHARARRAY)),
    "UPPER": (1, 1, lambda a: Typed(F.upper(text(a[0])), CHARARRAY)),
    "CONCAT": (2, 2, lambda a: Typed(F.concat(text(a[0]), text(a[1])), CHARARRAY)),
    "STRCONTAINS": (2, 2, lambda a: Typed(F.contains(text(a[0]), text(a[1])), BOOLEAN)),
    "TODOUBLE": (1, 1, lambda a: Typed(a[0].col.cast("double"), DOUBLE)),
    "TOINT": (1, 1, lambda a: Typed(a[0].col.cast("int"), INT)),
    "SQRT": (1, 1, lambda a: Typed(F.sqrt(number(a[0]).col), DOUBLE)),
    "POW": (2, 2, lambda a: Typed(F.pow(number(a[0]).col, number(a[1]).col), DOUBLE)),
    "TOMAP": (0, 1 << 20, _tomap),
    "S_DISTANCE": (2, 2, _distance),
}


def split_function(name: str, subject: Typed, pattern: str | None) -> Typed:
    if name == "TOKENIZE":
        return Typed(singles(split_text(text(subject), pattern if pattern is not None else '[, "]')), TOKENS)
    return Typed(F.struct(split_text(text(subject), pattern if pattern is not None else ",").alias("_raw")), TupleType(fields=None))


__all__ = ["AGGREGATES", "ANY", "SCALAR", "Typed", "aggregate", "make_map", "number", "over_bag", "singles", "split_function", "text"]

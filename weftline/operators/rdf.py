"""Basic graph patterns over triples: a filtered scan for each pattern, joined on shared variables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import tree as t
from ..types import CHARARRAY, BagType, Field, Schema, ScriptError
from .expressions import Relation
from .relational import settled


def _constant(part) -> str | None:
    if isinstance(part, t.Var):
        return None
    if isinstance(part, t.Lit):
        return str(part.value)
    raise ScriptError("a triple pattern takes variables and quoted constants")


def _matches(got: Column, wanted: str) -> Column:
    # Files quote literals; a pattern names them with or without their quotes.
    return got.isin(wanted, f'"{wanted}"')


def _condition(pattern, cols: list[Column]) -> Column:
    out = F.lit(True)
    seen: dict[str, Column] = {}
    for part, c in zip(pattern, cols):
        if (wanted := _constant(part)) is not None:
            out = out & _matches(c, wanted)
        elif part.name in seen:
            out = out & (c == seen[part.name])
        else:
            seen[part.name] = c
    return out


def _scan(df: DataFrame, pattern) -> DataFrame:
    cols = [F.col(f"_{i}") for i in range(3)]
    out = {}
    for part, c in zip(pattern, cols):
        if isinstance(part, t.Var):
            out.setdefault(part.name, c)
    rows = df.where(_condition(pattern, cols))
    return rows.select(*[c.alias(n) for n, c in out.items()]) if out else rows.select(F.lit(1).alias("\0exists")).limit(1)


def _flat(r: Relation) -> DataFrame:
    """Triples again, from triple groups."""
    if len(r.schema.fields) == 3:
        return r.df
    key, bag = r.schema.fields
    order = ["subject", "predicate", "object"]
    rest = [f.name for f in bag.type.item.fields]
    df = r.df.select(F.col("_0"), F.explode("_1").alias("_s"))
    of = {key.name: F.col("_0"), **{n: F.col("_s").getField(f"_{i}") for i, n in enumerate(rest)}}
    return df.select(*[of[n].alias(f"_{i}") for i, n in enumerate(order)])


def join_order(patterns: list) -> list:
    """Patterns so that each shares a variable with those before, where that can be; those with more constants first."""
    left, out, known = list(patterns), [], set()
    names = lambda p: {x.name for x in p if isinstance(x, t.Var)}
    while left:
        best = min(left, key=lambda p: (bool(out) and not names(p) & known, len(names(p) - known), patterns.index(p)))
        left.remove(best)
        out.append(best)
        known |= names(best)
    return out


def shape(patterns: list) -> str:
    """single, star (one variable in the same place of all), path (object to subject), or general."""
    if len(patterns) == 1:
        return "single"
    for k in range(3):
        if len({p[k].name if isinstance(p[k], t.Var) else None for p in patterns}) == 1 and isinstance(patterns[0][k], t.Var):
            return "star"
    if all(isinstance(a[2], t.Var) and isinstance(b[0], t.Var) and a[2].name == b[0].name for a, b in zip(patterns, patterns[1:])):
        return "path"
    return "general"


def bgp(r: Relation, patterns: tuple) -> Relation:
    """One pattern keeps the input's form; several give a column for each variable, in alphabetical order."""
    r = settled(r)
    if r.schema is None or len(r.schema.fields) not in (2, 3) or len(r.schema.fields) == 2 and not isinstance(r.schema.fields[1].type, BagType):
        raise ScriptError("BGP_FILTER needs triples or triple groups")
    if len(patterns) == 1:
        if len(r.schema.fields) == 3:
            return replace(r, df=r.df.where(_condition(patterns[0], [F.col(f"_{i}") for i in range(3)])))
        names = [r.schema.fields[0].name, *(f.name for f in r.schema.fields[1].type.item.fields)]
        place = [names.index(n) for n in ("subject", "predicate", "object")]

        def holds(s: Column) -> Column:
            own = [F.col("_0"), s.getField("_0"), s.getField("_1")]
            return _condition(patterns[0], [own[i] for i in place])

        return replace(r, df=r.df.where(F.exists("_1", holds)))
    flat, df, known = _flat(r), None, set()
    for p in join_order(list(patterns)):
        own = _scan(flat, p)
        names = {x.name for x in p if isinstance(x, t.Var)}
        shared = sorted(names & known)
        if df is None:
            df = own
        elif shared:
            df = df.join(own, shared)
        else:
            df = df.crossJoin(own)
        known |= names
    out = sorted(known)
    if not out:
        raise ScriptError("a pattern of several triples needs a variable")
    return Relation(df.select(*[F.col(n).alias(f"_{i}") for i, n in enumerate(out)]), Schema(tuple(Field(n, CHARARRAY) for n in out)))

"""Event patterns over ordered rows: SEQ, AND, OR, NEG, selection modes and WITHIN.

A pattern becomes alternatives, each a sequence of steps with events that must not occur before a step. Conditions on a row alone
are computed by Spark; those that look at earlier events of a match run with the automaton, in Python, for each key.
Without BY all rows form one sequence, which one task reads; with BY keys the work is dealt out.

Modes: skip_till_next_match: each start opens a run, which takes its next fitting row and skips others.
skip_till_any_match: a run may also pass over a fitting row. contiguity: a row that doesn't fit ends a run.
first_match: one run at a time. recent_match: a new start replaces a run that has only its start. cognitive_match: rows of a
complete match aren't used again.
"""

from __future__ import annotations

import itertools
import operator
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import tree as t
from ..types import ScriptError
from .expressions import Functions, Lower, Relation, RowScope
from .relational import settled


@dataclass(frozen=True)
class Step:
    event: str
    forbidden: frozenset[str] = frozenset()


def alternatives(p: t.Pattern) -> list[list[Step | str]]:
    """Sequences that satisfy a pattern; plain names among steps are events that must not occur there."""
    if p.kind == "simple":
        return [[Step(p.name)]]
    if p.kind == "neg":
        return [[p.parts[0].name]]
    if p.kind == "or":
        return [a for part in p.parts for a in alternatives(part)]
    orders = itertools.permutations(p.parts) if p.kind == "and" else [p.parts]
    return [list(itertools.chain(*chosen)) for parts in orders for chosen in itertools.product(*map(alternatives, parts))]


def compiled(p: t.Pattern) -> list[tuple[list[Step], frozenset[str]]]:
    """Each alternative's steps, and what must not occur behind the last."""
    out = []
    for a in alternatives(p):
        steps, banned = [], set()
        for x in a:
            if isinstance(x, str):
                banned.add(x)
            else:
                steps.append(Step(x.event, frozenset(banned)))
                banned = set()
        if not steps:
            raise ScriptError("a pattern needs an event that occurs")
        if (steps, frozenset(banned)) not in out:
            out.append((steps, frozenset(banned)))
    return out


_OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "+": operator.add, "-": operator.sub, "*": operator.mul}


def evaluate(e: t.Expr, row: tuple, matched: dict[str, tuple], names: list[str]):
    """A condition on a row and earlier events; comparisons with null are false."""
    go = lambda x: evaluate(x, row, matched, names)
    if isinstance(e, t.Lit):
        return e.value
    if isinstance(e, t.Pos):
        return row[e.index]
    if isinstance(e, t.Name):
        return row[names.index(e.name)]
    if isinstance(e, t.Deref) and isinstance(e.base, t.Name):
        other = matched.get(e.base.name)
        if other is None:
            return None
        return other[e.field.index if isinstance(e.field, t.Pos) else names.index(e.field.name)]
    if isinstance(e, t.And):
        return bool(go(e.left)) and bool(go(e.right))
    if isinstance(e, t.Or):
        return bool(go(e.left)) or bool(go(e.right))
    if isinstance(e, t.Not):
        return not go(e.of)
    if isinstance(e, (t.Compare, t.Binary)):
        a, b = go(e.left), go(e.right)
        if a is None or b is None:
            return False if isinstance(e, t.Compare) else None
        if e.op == "/":
            return int(a / b) if isinstance(a, int) and isinstance(b, int) else a / b
        return _OPS[e.op](a, b)
    if isinstance(e, t.Negative):
        return -go(e.of)
    raise ScriptError("a condition on earlier events takes fields, numbers, comparisons and AND, OR, NOT")


@dataclass
class Run:
    which: int
    at: int
    rows: list
    names: dict
    start: float | None


class Matcher:
    """The automaton for one sequence of rows. ``push`` gives the matches that a row completes, ``finish`` those left at the end."""

    def __init__(self, plans, mode: str, within: float | None, holds):
        self.plans, self.mode, self.within, self.holds = plans, mode, within, holds
        self.runs: list[Run] = []
        self.count = 0

    def _advance(self, run: Run, row, steps) -> Run:
        names = {**run.names, steps[run.at].event: row}
        return Run(run.which, run.at + 1, [*run.rows, (self.count, row)], names, run.start)

    def push(self, row, flags, time: float | None) -> Iterator[list]:
        self.count += 1
        kept, done = [], []
        for run in self.runs:
            steps, after = self.plans[run.which]
            if self.within is not None and time is not None and run.start is not None and time - run.start > self.within:
                if run.at == len(steps):
                    done.append(run)
                continue
            if run.at == len(steps):
                if not any(self.holds(e, row, flags, run.names) for e in after):
                    kept.append(run)
                continue
            step = steps[run.at]
            if self.holds(step.event, row, flags, run.names):
                new = self._advance(run, row, steps)
                (kept if new.at < len(steps) or after else done).append(new)
                if self.mode == "skip_till_any_match":
                    kept.append(run)
            elif not any(self.holds(e, row, flags, run.names) for e in step.forbidden) and self.mode != "contiguity":
                kept.append(run)
        ended = bool(done)
        if not (self.mode == "first_match" and (kept or ended)) and not (self.mode == "cognitive_match" and ended):
            for which, (steps, after) in enumerate(self.plans):
                if self.holds(steps[0].event, row, flags, {}):
                    new = Run(which, 1, [(self.count, row)], {steps[0].event: row}, time)
                    if self.mode == "recent_match":
                        kept = [r for r in kept if r.which != which or r.at > 1]
                    (kept if len(steps) > 1 or after else done).append(new)
                    if self.mode == "first_match":
                        break
        if self.mode == "first_match" and done:
            done, kept = done[:1], []
        if self.mode == "cognitive_match" and done:
            used = {n for run in done for n, _ in run.rows}
            kept = [r for r in kept if not used & {n for n, _ in r.rows}]
        self.runs = kept
        return (run.rows for run in done)

    def finish(self) -> Iterator[list]:
        """Nothing forbidden came behind the last step of these."""
        return (run.rows for run in self.runs if run.at == len(self.plans[run.which][0]))


def match(r: Relation, pattern: t.Pattern, events, mode: str, within: float | None, by, order, functions: Functions) -> Relation:
    """The rows of all matches, match after match, in the input's form."""
    r = settled(r)
    if r.schema is None:
        raise ScriptError("MATCH_EVENT needs a schema")
    known = {n for n, _ in events}
    wanted = {p.name for p in t.walk(pattern) if isinstance(p, t.Pattern) and p.kind == "simple"}
    if wanted - known:
        raise ScriptError(f"no event {', '.join(sorted(wanted - known))} in WITH")
    lower = Lower(RowScope.of(r), functions)
    names = [f.name for f in r.schema.fields]
    relative = {n: e for n, e in events if any(isinstance(x, t.Deref) and isinstance(x.base, t.Name) and x.base.name in known for x in t.walk(e))}
    flags = [n for n, _ in events if n not in relative]
    df = r.df
    for n, e in events:
        if n not in relative:
            df = df.withColumn(f"_e{flags.index(n)}", F.coalesce(lower.predicate(e), F.lit(False)))
    at = F.col(f"_{r.schema.timestamp}") if r.schema.timestamp is not None else None
    at = lower.expr(order).col if order is not None else at
    timed = at is not None
    if within is not None and not timed:
        raise ScriptError("WITHIN needs ORDER BY or a timestamp field")
    # Without an order rows count as they arrive; a live stream has no numbers for that, but its batches come one by one.
    df = df.withColumn("_o", at if timed else F.lit(0) if df.isStreaming else F.monotonically_increasing_id())
    moment = isinstance(df.schema["_o"].dataType, (T.TimestampType, T.TimestampNTZType))
    keys = [lower.expr(k).col.alias(f"_k{i}") for i, k in enumerate(by)] or [F.lit(0).alias("_k0")]
    seconds = F.unix_micros(F.col("_o").cast("timestamp")) / 1e6 if moment else F.col("_o").cast("double")
    df = df.select("*", *keys, (seconds if within is not None else F.lit(None).cast("double")).alias("_s"))
    width, plans, key_names = len(names), compiled(pattern), [f"_k{i}" for i in range(len(keys))]
    columns = [f"_{i}" for i in range(width)]
    out_schema = T.StructType([f for f in df.schema if f.name in columns])
    read = [*columns, *(f"_e{i}" for i in range(len(flags))), "_s"]

    def holds(event, row, flagged, matched) -> bool:
        if event in relative:
            return bool(evaluate(relative[event], row, matched, names))
        return flagged[flags.index(event)]

    # Ties in the order are broken by the rows' own values, so that a rerun gives the same matches.
    ties = [c for c in columns if isinstance(df.schema[c].dataType, T.AtomicType)] if timed else []

    if r.df.isStreaming:
        # Runs are the state of a key; rows are matched in the order of their micro-batches, and by order within these.
        def stateful(key, parts, state):
            m = Matcher(plans, mode, within, holds)
            if state.exists:
                m.runs, m.count = pickle.loads(state.get[0])
            part = pd.concat(list(parts), ignore_index=True).sort_values(["_o", *ties], kind="stable")[read].astype(object)
            found = []
            for row in part.where(part.notna(), None).itertuples(index=False, name=None):
                for rows in m.push(row[:width], row[width:-1], row[-1]):
                    found += [x for _, x in rows]
            state.update((pickle.dumps((m.runs, m.count)),))
            yield pd.DataFrame(found, columns=columns)

        out = df.groupBy(*key_names).applyInPandasWithState(stateful, out_schema, T.StructType([T.StructField("runs", T.BinaryType())]), "append", "NoTimeout")
        return replace(r, df=out, window=False)

    def whole(batches):
        """Rows of a partition by key and order, read as they come: only open runs are held, however many rows a key has."""
        m, last, kinds = None, None, None
        for batch in batches:
            kinds = kinds or [batch.schema.field(c).type for c in columns]
            key_rows = zip(*[batch.column(k).to_pylist() for k in key_names])
            found = []
            for key, row in zip(key_rows, zip(*[batch.column(c).to_pylist() for c in read])):
                if m is None or key != last:
                    found += [x for rows in (m.finish() if m else ()) for _, x in rows]
                    m, last = Matcher(plans, mode, within, holds), key
                for rows in m.push(row[:width], row[width:-1], row[-1]):
                    found += [x for _, x in rows]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], names=columns)
        if m is not None:
            found = [x for rows in m.finish() for _, x in rows]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], names=columns)

    dealt = df.repartition(*key_names) if by else df.repartition(1)
    dealt = dealt.sortWithinPartitions(*key_names, F.col("_o").asc_nulls_last(), *ties).select(*key_names, *read)
    out = dealt.mapInArrow(whole, out_schema)
    return replace(r, df=out, window=False)

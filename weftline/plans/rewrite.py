"""Plans as lists of statements: macro expansion, rewriting rules, graph helpers and plan editing.

Catalyst merges filters, pushes them down and prunes columns by itself; the rules here keep plans readable and
serve user rules. Required steps (macros, SPLIT) run always, optional ones only if optimisation is on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from ..types import ScriptError
from . import tree as t

Plan = list[t.Stmt]
Rule = Callable[[Plan], Plan | None]


# -- macros
def expand(plan: Plan, macros: dict[str, t.Stmt], fresh: Callable[[], int], depth: int = 0) -> Plan:
    """Macro calls replaced by their bodies. Aliases that a body defines get names of their own."""
    if depth > 50:
        raise ScriptError("macros call each other without end")
    out: Plan = []
    for s in plan:
        if s.kind == "defmacro":
            macros[s["name"]] = s
        elif s.kind == "macro":
            m = macros.get(s["name"])
            if m is None:
                raise ScriptError(f"no macro or statement {s['name']!r}")
            if len(m["params"]) != len(s["params"]):
                raise ScriptError(f"macro {s['name']} takes {len(m['params'])} arguments, not {len(s['params'])}")
            out += expand(_instance(m, s, fresh()), macros, fresh, depth + 1)
        else:
            out.append(s)
    return out


def _instance(m: t.Stmt, call: t.Stmt, number: int) -> Plan:
    given = {f"${p}": a for p, a in zip(m["params"], call["params"])}
    names = {p: a.name for p, a in given.items() if isinstance(a, t.Name)}
    names[f"${m['returns']}"] = call.out
    inner = [b for s in m["body"] for b in (s.out, *(n for n, _ in s["branches"] or ())) if b]
    names |= {n: f"{n}__{number}" for n in inner if n not in names}
    if m["returns"] in inner:
        names[m["returns"]] = call.out

    def one(x):
        if isinstance(x, t.Name):
            if not x.lineage and x.name in given and not isinstance(given[x.name], t.Name):
                return given[x.name]
            return t.Name(names.get(x.name, x.name), tuple(names.get(p, p) for p in x.lineage))
        return x

    out = []
    for s in m["body"]:
        s = t.Stmt(s.kind, names.get(s.out, s.out), tuple(names.get(i, i) for i in s.ins), t.mapped(s.args, one), call.line)
        if s["branches"]:
            s = s.but(branches=tuple((names.get(n, n), p) for n, p in s["branches"]))
        out.append(s)
    return out


def split_to_filters(plan: Plan) -> Plan:
    return [f for s in plan for f in ([t.Stmt("filter", n, s.ins, {"by": p}, s.line) for n, p in s["branches"]] if s.kind == "split" else [s])]


# -- graph
def producers(plan: Plan) -> dict[str, t.Stmt]:
    return {s.out: s for s in plan if s.out}


def consumers(plan: Plan, alias: str) -> Plan:
    return [s for s in plan if alias in s.ins]


def breadth_first(plan: Plan, start: t.Stmt, down: bool = True) -> Iterable[t.Stmt]:
    """Statements reached from one along its outputs, or against them along its inputs."""
    made, queue, seen = producers(plan), [start], set()
    while queue:
        s = queue.pop(0)
        if id(s) in seen:
            continue
        seen.add(id(s))
        yield s
        queue += consumers(plan, s.out) if down and s.out else [] if down else [made[a] for a in s.ins if a in made]


def depth_first(plan: Plan, start: t.Stmt, down: bool = True) -> Iterable[t.Stmt]:
    made, stack, seen = producers(plan), [start], set()
    while stack:
        s = stack.pop()
        if id(s) in seen:
            continue
        seen.add(id(s))
        yield s
        stack += reversed(consumers(plan, s.out) if down and s.out else [] if down else [made[a] for a in s.ins if a in made])


def topological(plan: Plan) -> Plan:
    """Producers before consumers; otherwise in the order given."""
    made, out, state = producers(plan), [], {}

    def visit(s: t.Stmt) -> None:
        if state.get(id(s)) == 1:
            raise ScriptError(f"{s.out} depends on itself")
        if id(s) in state:
            return
        state[id(s)] = 1
        for a in s.ins:
            if a in made:
                visit(made[a])
        state[id(s)] = 2
        out.append(s)

    for s in plan:
        visit(s)
    return out


def sources(plan: Plan) -> Plan:
    return [s for s in plan if s.out and not s.ins]


def sinks(plan: Plan) -> Plan:
    return [s for s in plan if s.ins and (not s.out or not consumers(plan, s.out))]


def check(plan: Plan, known: Iterable[str] = ()) -> None:
    """Every alias is defined once, before or after its use, and every input exists."""
    seen: set[str] = set()
    for s in plan:
        if s.out in seen:
            raise ScriptError(f"line {s.line}: {s.out} is defined twice")
        if s.out:
            seen.add(s.out)
    for s in plan:
        for a in s.ins:
            if a not in seen and a not in known:
                raise ScriptError(f"line {s.line}: no bag {a!r}")


# -- editing
def replace(plan: Plan, old: t.Stmt, new: t.Stmt) -> Plan:
    """One statement for another; what read the old one reads the new one."""
    out = [new if s is old else s for s in plan]
    return rewired(out, old.out, new.out) if old.out != new.out else out


def rewired(plan: Plan, old: str, new: str) -> Plan:
    return [s.but(ins=tuple(new if a == old else a for a in s.ins)) if old in s.ins else s for s in plan]


def remove(plan: Plan, stmt: t.Stmt) -> Plan:
    """Without a statement of one input; what read it reads its input."""
    if len(stmt.ins) != 1 and stmt.out:
        raise ScriptError("only a statement of one input can be taken out")
    rest = [s for s in plan if s is not stmt]
    return rewired(rest, stmt.out, stmt.ins[0]) if stmt.out else rest


def insert_after(plan: Plan, stmt: t.Stmt, new: t.Stmt) -> Plan:
    """``new`` reads ``stmt``, and all that read it read ``new``."""
    new = new.but(ins=(stmt.out,))
    out: Plan = []
    for s in plan:
        out.append(s.but(ins=tuple(new.out if a == stmt.out else a for a in s.ins)) if s is not stmt and stmt.out in s.ins else s)
        if s is stmt:
            out.append(new)
    return out


def insert_between(plan: Plan, first: t.Stmt, second: t.Stmt, new: t.Stmt) -> Plan:
    out: Plan = []
    for s in plan:
        if s is second:
            out += [new.but(ins=(first.out,)), s.but(ins=tuple(new.out if a == first.out else a for a in s.ins))]
        else:
            out.append(s)
    return out


def disconnect(plan: Plan, first: t.Stmt, second: t.Stmt) -> Plan:
    """The second statement no longer reads the first."""
    return [s.but(ins=tuple(a for a in s.ins if a != first.out)) if s is second else s for s in plan]


def swap(plan: Plan, first: t.Stmt, second: t.Stmt) -> Plan:
    """Two statements of one input each, the second reading the first alone, change places."""
    if second.ins != (first.out,) or len(first.ins) != 1 or len(consumers(plan, first.out)) != 1:
        raise ScriptError("only a statement and its single reader can be swapped")
    a, b = second.but(out=first.out, ins=first.ins), first.but(out=second.out, ins=(first.out,))
    return [a if s is first else b if s is second else s for s in plan]


# -- optional rules
def merge_filters(plan: Plan) -> Plan | None:
    """Two filters in a row, the first read by none else, become one; equal ones become the first."""
    made = producers(plan)
    for s in plan:
        p = made.get(s.ins[0]) if s.kind == "filter" else None
        if p is not None and p.kind == "filter" and consumers(plan, p.out) == [s]:
            by = p["by"] if p["by"] == s["by"] else t.And(p["by"], s["by"])
            return [x for x in (s.but(ins=p.ins, by=by) if x is s else x for x in plan) if x is not p]
    return None


def merge_limits(plan: Plan) -> Plan | None:
    made = producers(plan)
    for s in plan:
        p = made.get(s.ins[0]) if s.kind == "limit" else None
        if p is not None and p.kind == "limit" and consumers(plan, p.out) == [s]:
            return [x for x in (s.but(ins=p.ins, n=min(p["n"], s["n"])) if x is s else x for x in plan) if x is not p]
    return None


def drop_order_before_group(plan: Plan) -> Plan | None:
    """A sort whose only readers form groups or sets has no effect."""
    for s in plan:
        readers = consumers(plan, s.out) if s.kind == "order" else []
        if readers and all(r.kind in ("group", "cogroup", "distinct") for r in readers):
            return remove(plan, s)
    return None


def drop_dead(plan: Plan) -> Plan:
    """Without statements whose results reach no output."""
    live, made = [s for s in plan if not s.out], producers(plan)
    keep = {id(s) for end in live for s in depth_first(plan, end, down=False)}
    return [s for s in plan if id(s) in keep] if live and made else plan


OPTIONAL: list[Rule] = [merge_filters, merge_limits, drop_order_before_group]


def rewritten(plan: Plan, rules: Iterable[Rule], most: int = 1000) -> Plan:
    """Rules applied until none changes the plan. A rule gives a new plan, or None where it doesn't apply."""
    rules = list(rules)
    for _ in range(most):
        for rule in rules:
            new = rule(plan)
            if new is not None and new != plan:
                plan = new
                break
        else:
            return plan
    raise ScriptError("rewriting rules don't come to an end")


# -- rules made from pieces
def when(applies: Callable[[t.Stmt, Plan], bool], change: Callable[[t.Stmt, Plan], Plan | None]) -> Rule:
    """A rule for the first statement that a condition holds for."""

    def rule(plan: Plan) -> Plan | None:
        for s in plan:
            if applies(s, plan) and (new := change(s, plan)) is not None and new != plan:
                return new
        return None

    return rule


def unless(stops: Callable[[t.Stmt, Plan], bool], rule_for: Callable[[t.Stmt, Plan], Plan | None]) -> Rule:
    return when(lambda s, p: not stops(s, p), rule_for)


def to_replace(kind: str, make: Callable[[t.Stmt], t.Stmt | None]) -> Rule:
    return when(lambda s, _: s.kind == kind, lambda s, p: replace(p, s, new) if (new := make(s)) is not None else None)


def to_merge(first: str, second: str, make: Callable[[t.Stmt, t.Stmt], t.Stmt]) -> Rule:
    """A rule that turns a statement and its single reader into one that keeps the reader's alias."""

    def rule(plan: Plan) -> Plan | None:
        made = producers(plan)
        for s in plan:
            p = made.get(s.ins[0]) if s.kind == second and s.ins else None
            if p is not None and p.kind == first and consumers(plan, p.out) == [s]:
                new = make(p, s).but(out=s.out, ins=p.ins)
                return [new if x is s else x for x in plan if x is not p]
        return None

    return rule


def calls(stmt: t.Stmt, function: str) -> bool:
    """Whether a FOREACH calls a function."""
    return stmt.kind == "foreach" and any(isinstance(x, t.Call) and x.name.lower() == function.lower() for x in t.walk(stmt.args))


# -- pictures
def described(plan: Plan) -> str:
    made = producers(plan)
    lines = []
    for s in plan:
        inputs = ", ".join(s.ins)
        lines.append(f"{s.out or '-'} <- {s.kind.upper()}({inputs})" + "".join(f" [{a}: earlier]" for a in s.ins if a not in made))
    return "\n".join(lines)


def dot(plan: Plan) -> str:
    """The plan for Graphviz."""
    made = producers(plan)
    node = {id(s): f"n{i}" for i, s in enumerate(plan)}
    lines = [f'  {node[id(s)]} [label="{(s.out + ": ") if s.out else ""}{s.kind}"];' for s in plan]
    lines += [f'  {node[id(made[a])]} -> {node[id(s)]} [label="{a}"];' for s in plan for a in s.ins if a in made]
    return "digraph plan {\n" + "\n".join(lines) + "\n}"

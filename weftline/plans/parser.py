"""Hand-written lexer and recursive-descent parser. Keywords know no case; semicolons are optional."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..types import BYTEARRAY, SIMPLE, BagType, Field, MapType, MatrixType, ScriptError, TupleType, Type
from . import tree as t

_TOKENS = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)|(?P<code><%.*?%>)|(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)
    |(?P<pos>\$\d+)|(?P<name>\$?[A-Za-z_]\w*)|(?P<single>'(?:[^'\\]|\\.)*')|(?P<double>"(?:[^"\\]|\\.)*")
    |(?P<op>::|==|!=|<=|>=|[-+*/=<>(){}\[\],;.:\#?])""",
    re.S | re.X,
)
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    spaced: bool


def unquoted(s: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _ESCAPE.get(m[1], m[1]), s[1:-1], flags=re.S)


def lex(source: str) -> list[Token]:
    out, at, spaced = [], 0, False
    while at < len(source):
        m = _TOKENS.match(source, at)
        if m is None:
            line = source.count("\n", 0, at) + 1
            raise ScriptError(f"line {line}: can't read {source[at : at + 20]!r}")
        if m.lastgroup == "skip":
            spaced = True
        else:
            out.append(Token(m.lastgroup, m[0], at, m.end(), spaced))
            spaced = False
        at = m.end()
    return [*out, Token("end", "", at, at, True)]


class Parser:
    def __init__(self, source: str):
        self.source, self.tokens, self.i = source, lex(source), 0

    # -- tokens
    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def fail(self, wanted: str):
        line = self.source.count("\n", 0, self.now.start) + 1
        raise ScriptError(f"line {line}: {wanted} expected, found {self.now.text or 'the end'!r}")

    def is_op(self, text: str, ahead: int = 0) -> bool:
        k = self.tokens[min(self.i + ahead, len(self.tokens) - 1)]
        return k.kind == "op" and k.text == text

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        k = self.tokens[min(self.i + ahead, len(self.tokens) - 1)]
        return k.kind == "name" and k.text.lower() in words

    def op(self, text: str) -> None:
        if not self.take_op(text):
            self.fail(repr(text))

    def take_op(self, text: str) -> bool:
        if self.is_op(text):
            self.i += 1
            return True
        return False

    def word(self, *words: str) -> str:
        if not self.is_word(*words):
            self.fail(" or ".join(words))
        return self.next().text.lower()

    def take(self, *words: str) -> str:
        return self.next().text.lower() if self.is_word(*words) else ""

    def next(self) -> Token:
        self.i += 1
        return self.tokens[self.i - 1]

    def name(self) -> str:
        if self.now.kind != "name":
            self.fail("a name")
        return self.next().text

    def string(self) -> str:
        if self.now.kind not in ("single", "double"):
            self.fail("a string")
        return unquoted(self.next().text)

    def integer(self) -> int:
        sign = -1 if self.take_op("-") else 1
        if self.now.kind != "number" or not self.now.text.isdigit():
            self.fail("a whole number")
        return sign * int(self.next().text)

    def many(self, one, separator: str = ",", end: str | None = None) -> list:
        if end is not None and self.is_op(end):
            return []
        out = [one()]
        while self.take_op(separator):
            out.append(one())
        return out

    def bracketed(self, one, left: str = "(", right: str = ")") -> list:
        self.op(left)
        out = self.many(one, end=right)
        self.op(right)
        return out

    # -- expressions
    def expression(self) -> t.Expr:
        e = self.term()
        while self.is_op("+") or self.is_op("-"):
            e = t.Binary(self.next().text, e, self.term())
        return e

    def term(self) -> t.Expr:
        e = self.factor()
        while self.is_op("*") or self.is_op("/"):
            e = t.Binary(self.next().text, e, self.factor())
        return e

    def factor(self) -> t.Expr:
        if self.take_op("-"):
            of = self.factor()
            return t.Lit(-of.value) if isinstance(of, t.Lit) and not isinstance(of.value, (str, bool)) else t.Negative(of)
        if self.is_op("("):
            return self.parenthesis()
        if self.is_op("{"):
            return t.MakeBag(tuple(self.bracketed(self.expression, "{", "}")))
        if self.is_op("["):
            return t.MakeMap(tuple(self.bracketed(self.expression, "[", "]")))
        if self.now.kind == "number":
            text = self.next().text
            return t.Lit(int(text) if text.isdigit() else float(text))
        if self.now.kind in ("single", "double"):
            return t.Lit(self.string())
        if self.is_word("true", "false"):
            return t.Lit(self.next().text.lower() == "true")
        if self.now.kind == "name":
            k = 1
            while self.is_op(".", k) and self.tokens[self.i + k + 1].kind == "name":
                k += 2
            if self.is_op("(", k):
                return self.call(k)
        return self.reference()

    def call(self, length: int) -> t.Expr:
        name = "".join(x.text for x in self.tokens[self.i : self.i + length])
        low = name.lower()
        self.i += length
        if low == "flatten":
            args = self.bracketed(self.expression)
            if len(args) != 1:
                self.fail("one argument of flatten")
            return t.Flatten(args[0])
        if re.fullmatch(r"[sd][di]matrix", low):
            args = self.bracketed(self.expression)
            if len(args) < 3 or not all(isinstance(a, t.Lit) and isinstance(a.value, int) for a in args[:2]):
                self.fail("rows, columns and values of a matrix")
            return t.MakeMatrix(low[:2], args[0].value, args[1].value, tuple(args[2:]))
        if low == "geometry":
            args = self.bracketed(self.expression)
            if not 1 <= len(args) <= 3:
                self.fail("a geometry of one to three arguments")
            return t.MakeGeometry(args[0], tuple(args[1:]))
        return t.Call(name, tuple(self.bracketed(self.expression)))

    def parenthesis(self) -> t.Expr:
        """A cast, a parenthesis or a tuple."""
        k = self.tokens[self.i + 1]
        if k.kind == "name" and (k.text.lower() in SIMPLE and self.is_op(")", 2) or k.text.lower() in ("tuple", "map", "bag") and (self.is_op("(", 2) or self.is_op("[", 2) or self.is_op("{", 2))):
            self.i += 1
            kind = self.cast_type()
            self.op(")")
            return t.Cast(kind, self.factor())
        items = self.bracketed(self.expression)
        return items[0] if len(items) == 1 else t.MakeTuple(tuple(items))

    def cast_type(self) -> Type:
        if self.is_word("tuple") and self.is_op("(", 1):
            self.i += 1
            return TupleType(fields=tuple(Field("", x) for x in self.bracketed(self.cast_type)))
        return self.type()

    def reference(self) -> t.Expr:
        e = self.field_ref()
        while True:
            if self.is_op("#"):
                self.i += 1
                e = t.Lookup(e, self.string())
            elif self.is_op(".") and self.tokens[self.i + 1].kind in ("name", "pos"):
                self.i += 1
                e = t.Deref(e, self.field_ref())
            else:
                return e

    def field_ref(self) -> t.Expr:
        if self.now.kind == "pos":
            return t.Pos(int(self.next().text[1:]))
        parts = [self.name()]
        while self.take_op("::"):
            parts.append(self.name())
        return t.Name(parts[-1], tuple(parts[:-1]))

    # -- predicates
    def predicate(self) -> t.Expr:
        e = self.conjunction()
        while self.take("or"):
            e = t.Or(e, self.conjunction())
        return e

    def conjunction(self) -> t.Expr:
        e = self.negation()
        while self.take("and"):
            e = t.And(e, self.negation())
        return e

    def negation(self) -> t.Expr:
        return t.Not(self.condition()) if self.take("not") else self.condition()

    def condition(self) -> t.Expr:
        """A comparison, a Boolean expression, or a predicate in parentheses."""
        start = self.i
        try:
            left = self.expression()
            for op in ("==", "!=", "<=", ">=", "<", ">"):
                if self.take_op(op):
                    return t.Compare(op, left, self.expression())
            if isinstance(left, t.Call) or isinstance(left, t.Lit) and isinstance(left.value, bool):
                return left
            problem = None
        except ScriptError as e:
            problem = e
        end, self.i = self.i, start
        if self.take_op("("):
            e = self.predicate()
            self.op(")")
            return e
        self.i = end
        if problem:
            raise problem
        self.fail("a comparison")

    # -- types
    def type(self) -> Type:
        if self.now.kind == "name":
            low = self.now.text.lower()
            if low in SIMPLE:
                self.i += 1
                return SIMPLE[low]
            if low == "geometry":
                self.i += 1
                return Type("geometry")
            if re.fullmatch(r"[sd][di]matrix", low):
                self.i += 1
                rows, cols = self.bracketed(self.integer)
                return MatrixType(kind=low[:2], rows=rows, cols=cols)
        if self.is_word("tuple") or self.is_op("("):
            self.take("tuple")
            return TupleType(fields=tuple(self.bracketed(self.field)))
        if self.is_word("bag") or self.is_op("{"):
            self.take("bag")
            self.op("{")
            if self.now.kind == "name" and self.is_op(":", 1):  # a name for the tuple
                self.i += 2
            item = self.type()
            self.op("}")
            return BagType(item=item)
        if self.is_word("map") or self.is_op("["):
            self.take("map")
            self.op("[")
            value = BYTEARRAY if self.is_op("]") else self.type()
            self.op("]")
            return MapType(value=value)
        self.fail("a type")

    def field(self) -> Field:
        name = self.name()
        return Field(name, self.type() if self.take_op(":") else BYTEARRAY)

    def schema(self) -> tuple[Field, ...] | None:
        return tuple(self.bracketed(self.field)) if self.take("as") else None

    # -- clauses
    def param(self):
        """A loader's parameter: a plain value, or (name, value)."""
        if self.now.kind == "name" and self.is_op("=", 1):
            key = self.next().text
            self.i += 1
            return key, self.plain()
        return self.plain()

    def plain(self):
        if self.now.kind in ("single", "double"):
            return self.string()
        if self.is_word("true", "false"):
            return self.next().text.lower() == "true"
        sign = -1 if self.take_op("-") else 1
        if self.now.kind == "number":
            text = self.next().text
            return sign * (int(text) if text.isdigit() else float(text))
        self.fail("a parameter")

    def using(self) -> tuple[str, list] | None:
        if not self.take("using"):
            return None
        return self.name(), self.bracketed(self.param) if self.is_op("(") else []

    def timestamp(self) -> t.Expr | None:
        if not self.take("timestamp"):
            return None
        self.op("(")
        ref = self.field_ref()
        self.op(")")
        return ref

    def keys(self) -> tuple[t.Expr, ...]:
        return tuple(self.bracketed(self.reference)) if self.is_op("(") else (self.reference(),)

    def grouping(self) -> tuple[t.Expr, ...]:
        if self.take("all"):
            return ()
        self.word("by")
        return self.keys()

    def generators(self) -> tuple[t.Generator, ...]:
        return tuple(self.many(self.generator))

    def generator(self) -> t.Generator:
        if self.take_op("*"):
            return t.Generator(t.Star())
        e = self.expression()
        if not self.take("as"):
            return t.Generator(e)
        if self.is_op("("):  # names for the fields of a flattened tuple or bag
            return t.Generator(e, Field("", TupleType(fields=tuple(self.bracketed(self.field)))))
        return t.Generator(e, self.field())

    def order(self) -> tuple[tuple[t.Expr, bool], ...]:
        """(key, ascending) pairs; a star stands for all fields."""
        if self.take_op("*"):
            return ((t.Star(), self.take("asc", "desc") != "desc"),)
        return tuple(self.many(lambda: (self.reference(), self.take("asc", "desc") != "desc")))

    def method(self, *names: str) -> tuple[str, list]:
        return self.word(*names), self.bracketed(self.param)

    def span(self) -> tuple[str, int]:
        """A window's extent: ('range', seconds) or ('rows', count)."""
        if self.word("range", "rows") == "rows":
            return "rows", self.integer()
        n = self.integer()
        return "range", n * (60 if self.word("seconds", "minutes") == "minutes" else 1)

    def pattern(self) -> t.Pattern:
        if self.is_op("(", 1) and self.is_word("seq", "and", "or", "neg"):
            kind = self.next().text.lower()
            parts = tuple(self.bracketed(self.pattern))
            if kind == "neg" and (len(parts) != 1 or parts[0].kind != "simple") or kind != "neg" and len(parts) < 2:
                self.fail("one event for NEG, two patterns at least for SEQ, AND and OR")
            return t.Pattern(kind, parts=parts)
        return t.Pattern("simple", self.name())

    def triple(self) -> tuple:
        def part():
            if self.take_op("?"):
                return t.Var(self.name())
            return t.Lit(self.string()) if self.now.kind in ("single", "double") else self.field_ref()

        return part(), part(), part()

    # -- statements
    def script(self) -> list[t.Stmt]:
        out = []
        while self.now.kind != "end":
            if not self.take_op(";"):
                line = self.source.count("\n", 0, self.now.start) + 1
                out.append(self.statement().but(line=line))
        return out

    def statement(self) -> t.Stmt:
        if self.now.kind == "code":
            code = self.next().text[2:-2]
            parts = code.split("rules:")
            return t.Stmt("embed", args={"code": parts[0], "rules": parts[1] if len(parts) == 2 else None})
        if self.now.kind == "name" and self.is_op("=", 1):
            out = self.name()
            self.i += 1
            return self.definition(out)
        if self.is_word("fs"):
            return self.fs()
        word = self.word("dump", "display", "store", "describe", "split", "register", "define", "set", "materialize", "visualize", "socket_write")
        return getattr(self, f"s_{word}")()

    def fs(self) -> t.Stmt:
        start = self.next().end
        stop = re.compile(r"[;\n]|$").search(self.source, start).start()
        words = self.source[start:stop].split()
        while self.now.start < stop and self.now.kind != "end":
            self.i += 1
        if not words or not words[0].startswith("-"):
            self.fail("a file system command")
        return t.Stmt("fs", args={"command": words[0][1:].lower(), "params": words[1:]})

    def definition(self, out: str) -> t.Stmt:
        word = self.now.text.lower() if self.now.kind == "name" else ""
        found = getattr(self, f"d_{word}", None) if word else None
        if found is None:
            name = self.name()
            args = tuple(self.bracketed(self.reference_or_literal)) if self.is_op("(") else ()
            return t.Stmt("macro", out, (), {"name": name, "params": args})
        self.i += 1
        return found(out)

    def reference_or_literal(self) -> t.Expr:
        return self.factor() if self.now.kind in ("number", "single", "double") or self.is_op("-") or self.is_word("true", "false") else self.reference()

    def s_dump(self):
        a = self.name()
        return t.Stmt("dump", "", (a,), {"mute": bool(self.take("mute"))})

    def s_display(self):
        return t.Stmt("display", "", (self.name(),))

    def s_describe(self):
        return t.Stmt("describe", "", (self.name(),))

    def s_materialize(self):
        return t.Stmt("materialize", "", (self.name(),))

    def s_store(self):
        a = self.name()
        self.word("into")
        return t.Stmt("store", "", (a,), {"file": self.string(), "using": self.using()})

    def s_split(self):
        a = self.name()
        self.word("into")

        def branch():
            out = self.name()
            self.word("if")
            return out, self.predicate()

        return t.Stmt("split", "", (a,), {"branches": tuple(self.many(branch))})

    def s_register(self):
        return t.Stmt("register", args={"file": self.string()})

    def s_set(self):
        key = self.name()
        while self.take_op("."):
            key += "." + self.name()
        return t.Stmt("set", args={"key": key, "value": self.name() if self.now.kind == "name" and not self.is_word("true", "false") else self.plain()})

    def s_define(self):
        name = self.name()
        if self.is_word("returns") or self.is_op("(") and self._macro_ahead():
            params = tuple(self.bracketed(self.name)) if self.is_op("(") else ()
            self.word("returns")
            out = self.name()
            self.op("{")
            body = []
            while not self.take_op("}"):
                if not self.take_op(";"):
                    body.append(self.statement())
            return t.Stmt("defmacro", args={"name": name, "params": params, "returns": out, "body": tuple(body)})
        target = self.name()
        while self.take_op("."):
            target += "." + self.name()
        return t.Stmt("define", args={"name": name, "target": target, "params": tuple(self.bracketed(self.plain)) if self.is_op("(") else ()})

    def _macro_ahead(self) -> bool:
        k = self.i
        while not (self.tokens[k].kind == "op" and self.tokens[k].text == ")") and self.tokens[k].kind != "end":
            k += 1
        return self.tokens[min(k + 1, len(self.tokens) - 1)].text.lower() == "returns"

    def s_visualize(self):
        a = self.name()
        self.word("by")
        ref = self.reference()
        self.word("into")
        path, size = self.string(), 1
        if self.take("with"):
            self.word("pointsize")
            size = self.integer()
        self.word("as")
        width, height = self.bracketed(self.integer)
        return t.Stmt("visualize", "", (a,), {"field": ref, "file": path, "size": size, "width": width, "height": height})

    def s_socket_write(self):
        a = self.name()
        self.word("to")
        address = self.string()
        zmq = bool(self.take("mode") and self.word("zmq"))
        return t.Stmt("socket_write", "", (a,), {"address": address, "zmq": zmq, "using": self.using()})

    def d_load(self, out):
        return t.Stmt("load", out, (), {"file": self.string(), "using": self.using(), "schema": self.schema(), "timestamp": self.timestamp()})

    def d_rdfload(self, out):
        self.op("(")
        file = self.string()
        self.op(")")
        grouped = None
        if self.take("grouped"):
            self.word("on")
            grouped = self.word("subject", "predicate", "object")
        return t.Stmt("rdfload", out, (), {"file": file, "grouped": grouped})

    def d_socket_read(self, out):
        address = self.string()
        zmq = bool(self.take("mode") and self.word("zmq"))
        return t.Stmt("socket_read", out, (), {"address": address, "zmq": zmq, "using": self.using(), "schema": self.schema(), "timestamp": self.timestamp()})

    def d_foreach(self, out):
        a = self.name()
        if not self.take_op("{"):
            self.word("generate")
            return t.Stmt("foreach", out, (a,), {"generate": self.generators(), "block": ()})
        block, generate = [], None
        while not self.take_op("}"):
            if self.take_op(";"):
                continue
            if self.take("generate"):
                generate = self.generators()
            elif generate is not None:
                self.fail("nothing behind GENERATE")
            else:
                name = self.name()
                self.op("=")
                if self.is_word("distinct", "limit", "filter", "order") and self.tokens[self.i + 1].kind in ("name", "pos"):
                    block.append(self.nested(name))
                else:
                    block.append(t.Stmt("project", name, (), {"of": self.reference()}))
        if generate is None:
            self.fail("GENERATE")
        return t.Stmt("foreach", out, (a,), {"generate": generate, "block": tuple(block)})

    def nested(self, name: str) -> t.Stmt:
        kind = self.next().text.lower()
        of = self.reference()
        if kind == "filter":
            self.word("by")
            return t.Stmt("filter", name, (), {"of": of, "by": self.predicate()})
        if kind == "order":
            self.word("by")
            return t.Stmt("order", name, (), {"of": of, "by": self.order()})
        return t.Stmt(kind, name, (), {"of": of, "n": self.integer()} if kind == "limit" else {"of": of})

    def d_accumulate(self, out):
        a = self.name()
        self.word("generate")
        return t.Stmt("accumulate", out, (a,), {"generate": self.generators()})

    def d_filter(self, out):
        a = self.name()
        self.word("by")
        return t.Stmt("filter", out, (a,), {"by": self.predicate()})

    def d_group(self, out):
        a = self.name()
        return t.Stmt("group", out, (a,), {"keys": self.grouping()})

    def d_cogroup(self, out):
        parts = self.many(lambda: (self.name(), self.grouping()))
        return t.Stmt("cogroup", out, tuple(p[0] for p in parts), {"keys": tuple(p[1] for p in parts)})

    def d_distinct(self, out):
        return t.Stmt("distinct", out, (self.name(),))

    def d_limit(self, out):
        a = self.name()
        return t.Stmt("limit", out, (a,), {"n": self.integer()})

    def d_join(self, out):
        def part():
            a = self.name()
            self.word("by")
            return a, self.keys()

        parts = self.many(part)
        return t.Stmt("join", out, tuple(p[0] for p in parts), {"keys": tuple(p[1] for p in parts)})

    def d_cross(self, out):
        return t.Stmt("cross", out, tuple(self.many(self.name)))

    def d_zip(self, out):
        ins = [self.name()]
        if self.is_word("with") and self.is_word("index", ahead=1):
            self.i += 2
            return t.Stmt("zip", out, tuple(ins), {"index": True})
        while self.take("with"):
            ins.append(self.name())
        return t.Stmt("zip", out, tuple(ins), {"index": False})

    def d_union(self, out):
        return t.Stmt("union", out, tuple(self.many(self.name)))

    def d_intersection(self, out):
        return t.Stmt("intersection", out, tuple(self.many(self.name)))

    def d_difference(self, out):
        parts = self.many(lambda: (self.name(), self.keys() if self.take("by") else None))
        if len(parts) != 2 or (parts[0][1] is None) != (parts[1][1] is None):
            self.fail("two inputs, both or neither with BY")
        return t.Stmt("difference", out, tuple(p[0] for p in parts), {"keys": tuple(p[1] for p in parts) if parts[0][1] else None})

    def d_stream(self, out):
        a = self.name()
        self.word("through")
        fn = self.name()
        while self.take_op("."):
            fn += "." + self.name()
        params = tuple(self.bracketed(self.reference_or_literal)) if self.is_op("(") else ()
        return t.Stmt("stream", out, (a,), {"fn": fn, "params": params, "schema": self.schema()})

    def d_sample(self, out):
        a = self.name()
        return t.Stmt("sample", out, (a,), {"fraction": self.expression()})

    def d_order(self, out):
        a = self.name()
        self.word("by")
        return t.Stmt("order", out, (a,), {"by": self.order()})

    def d_cache(self, out):
        a = self.name()
        known = ("none", "memory_only", "memory_and_disk", "memory_only_ser", "memory_and_disk_ser", "disk_only", "memory_only_2", "memory_and_disk_2", "disk_only_2", "memory_only_ser_2", "memory_and_disk_ser_2")
        return t.Stmt("cache", out, (a,), {"mode": self.take(*known) or "none"})

    def d_rscript(self, out):
        a = self.name()
        self.word("using")
        return t.Stmt("rscript", out, (a,), {"script": self.string(), "schema": self.schema()})

    def d_tuplify(self, out):
        a = self.name()
        self.word("on")
        return t.Stmt("tuplify", out, (a,), {"on": self.reference()})

    def d_bgp_filter(self, out):
        a = self.name()
        self.word("by")
        self.op("{")
        triples = [self.triple()]
        while self.take_op("."):
            if not self.is_op("}"):
                triples.append(self.triple())
        self.op("}")
        return t.Stmt("bgp_filter", out, (a,), {"triples": tuple(triples)})

    def d_window(self, out):
        a = self.name()
        size = self.span()
        return t.Stmt("window", out, (a,), {"size": size, "slide": self.span() if self.take("slide") else size})

    def d_match_event(self, out):
        a = self.name()
        self.word("pattern")
        pattern = self.pattern()
        self.word("with")

        def event():
            name = self.name()
            self.op(":")
            return name, self.predicate()

        events = tuple(self.bracketed(event))
        mode = self.word("skip_till_next_match", "skip_till_any_match", "first_match", "recent_match", "cognitive_match", "contiguity") if self.take("mode") else "skip_till_next_match"
        within = None
        if self.take("within"):
            n = self.integer()
            within = n * (60 if self.word("seconds", "minutes") == "minutes" else 1)
        # An extension: matching on its own for each value of a key, in the order of a field.
        by = self.keys() if self.take("by") else ()
        order = None
        if self.take("order"):
            self.word("by")
            order = self.reference()
        return t.Stmt("match_event", out, (a,), {"pattern": pattern, "events": events, "mode": mode, "within": within, "by": by, "order": order})

    def _partition(self):
        if not self.take("partition"):
            return None
        self.word("by")
        return self.method("grid", "bsp")

    def _index(self):
        if not self.take("using"):
            return None
        self.word("index")
        return self.method("rtree")

    def d_spatial_join(self, out):
        a, left = self.name(), self._partition()
        self.op(",")
        b, right = self.name(), self._partition()
        self.word("on")
        predicate = self.word("contains", "containedby", "intersects")
        refs = tuple(self.bracketed(self.reference)) if self.is_op("(") else (t.Pos(0), t.Pos(0))
        return t.Stmt("spatial_join", out, (a, b), {"predicate": predicate, "refs": refs, "partition": (left, right), "index": self._index()})

    def d_spatial_filter(self, out):
        a = self.name()
        self.word("by")
        predicate = self.word("contains", "containedby", "intersects")
        self.op("(")
        ref = self.reference()
        self.op(",")
        geometry = self.factor()
        self.op(")")
        if not isinstance(geometry, t.MakeGeometry):
            self.fail("a geometry")
        return t.Stmt("spatial_filter", out, (a,), {"predicate": predicate, "ref": ref, "geometry": geometry, "index": self._index()})

    def d_index(self, out):
        a = self.name()
        self.word("on")
        ref = self.reference()
        self.word("using")
        return t.Stmt("index", out, (a,), {"on": ref, "method": self.method("rtree")})

    def d_partition(self, out):
        a = self.name()
        self.word("on")
        ref = self.reference()
        self.word("using")
        return t.Stmt("partition", out, (a,), {"on": ref, "method": self.method("grid", "bsp")})

    def d_delay(self, out):
        a = self.name()
        self.word("by")
        self.op("(")
        if self.now.kind == "single":
            m = re.fullmatch(r"(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?", text := self.string(), re.I)
            if not m or not text:
                self.fail("a duration such as '1M30S'")
            wait = int(m[1] or 0) * 3600 + int(m[2] or 0) * 60 + float(m[3] or 0)
        else:
            wait = self.integer() / 1000
        self.op(",")
        factor = self.integer()
        self.op(")")
        return t.Stmt("delay", out, (a,), {"wait": wait, "factor": factor})


def parse(source: str) -> list[t.Stmt]:
    return Parser(source).script()

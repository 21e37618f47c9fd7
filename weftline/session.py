"""Sessions: run scripts statement by statement. Aliases stay defined between calls, nothing runs before an output asks."""

from __future__ import annotations

import subprocess
import shutil
import sys
import time
from collections.abc import Callable
from dataclasses import replace
from itertools import count
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .materialize import OperatorGraph, Store
from .operators import cep, rdf, relational, spatial
from .operators.expressions import Functions, Lower, Relation, RowScope
from .plans import rewrite
from .plans import tree as t
from .plans.parser import parse
from .plans.preprocess import prepared
from .shared import scratch
from .sources import loaders, output
from .streaming import running, windows
from .types import BYTEARRAY, SIMPLE, Field, Schema, ScriptError, from_spark, to_spark

#: Settings that SET may hand to Spark.
_SPARK_SETTINGS = ("spark.sql.",)
#: Statements that a live stream can only take one micro-batch at a time.
_BATCHWISE = frozenset(("order", "limit", "distinct", "zip", "cogroup", "intersection", "difference", "group"))


class Session:
    """``allow_code``: whether embedded Python may run. ``optimize``: whether optional rewriting rules apply.
    ``store``: folder for MATERIALIZE. ``mode``: how STORE treats what is there (errorifexists or overwrite)."""

    def __init__(self, spark: SparkSession, params: dict[str, str] | None = None, *, allow_code: bool = False, optimize: bool = True, store: str | None = None, mode: str = "errorifexists", base: str | Path = ".", seed: int | None = None, mute: bool = False, out=print, profile: bool = False, outdir: str | None = None):
        self.spark, self.params, self.allow_code, self.optimize, self.mode, self.base, self.seed, self.mute, self.out = spark, params or {}, allow_code, optimize, mode, base, seed, mute, out
        self.relations: dict[str, Relation] = {}
        self.signatures: dict[str, str] = {}
        self.shared: dict[str, Relation] = {}
        self.macros: dict[str, t.Stmt] = {}
        self.settings: dict[str, object] = {}
        self.rules: list[rewrite.Rule] = []
        self.operators: dict[str, Callable[..., DataFrame]] = {}
        self.functions = Functions(spark)
        self.queries: list = []
        self.plan: rewrite.Plan = []
        self.outdir = outdir
        self.graph = OperatorGraph() if profile else None
        self._seen: dict[str, Observation] = {}
        self._last: dict[str, str] = {}
        self._inputs: dict[str, list[str]] = {}
        self._store = Store(spark, store) if store else None
        self._fresh = count(1).__next__

    # -- API
    def register(self, name: str, fn: Callable, result: str | None = None) -> None:
        """A Python function of columns (built from Spark functions, or a UDF) for expressions."""
        self.functions.python[name] = (fn, SIMPLE[result] if result else BYTEARRAY)

    def operator(self, name: str, fn: Callable[..., DataFrame]) -> None:
        """A function from a DataFrame and arguments to a DataFrame, for STREAM ... THROUGH."""
        self.operators[name] = fn

    def bind(self, alias: str, df: DataFrame, stream: bool = False, timestamp: str | None = None) -> None:
        """A DataFrame as a bag."""
        r = loaders.from_columns(df, None, df.columns.index(timestamp) if timestamp else None)
        self.relations[alias] = replace(r, stream=stream)
        self.signatures[alias] = f"bound:{alias}:{id(df)}"

    def df(self, alias: str) -> DataFrame:
        """A bag as a DataFrame, under the script's names."""
        if self.relation(alias).deferred:
            raise ScriptError(f"{alias} is made of each micro-batch of a live stream: STORE, DUMP or send it")
        return output.frame(relational.settled(self.relation(alias)))

    def relation(self, alias: str) -> Relation:
        if alias not in self.relations:
            raise ScriptError(f"no bag {alias!r}")
        return self.relations[alias]

    def schema(self, alias: str) -> Schema | None:
        return self.relation(alias).schema

    def run(self, source: str, redefine: bool = False) -> list:
        """Runs a script; what its outputs give: lines of DUMP, text of DESCRIBE and DISPLAY, and started queries.
        ``redefine``: aliases may be defined again, as on a console."""
        plan = self.prepare(source)
        rewrite.check(plan, self.relations)
        if not redefine:
            again = [s.out for s in plan if s.out in self.relations]
            if again:
                raise ScriptError(f"{again[0]} is defined twice")
        results = []
        for s in rewrite.topological(plan):
            got = self.execute(s)
            if got is not None:
                results.append(got)
        return results

    def prepare(self, source: str) -> rewrite.Plan:
        plan = parse(prepared(source, self.params, self.base))
        for s in plan:
            if s.kind == "embed":
                self._embed(s)
        plan = rewrite.expand([s for s in plan if s.kind != "embed"], self.macros, self._fresh)
        plan = rewrite.split_to_filters(plan)
        plan = rewrite.rewritten(plan, [*(rewrite.OPTIONAL if self.optimize else []), *self.rules])
        self.plan = plan
        return plan

    def run_merged(self, sources: list[str]) -> list:
        """Several scripts as one session each, sharing equal parts of their plans."""
        out = []
        for source in sources:
            self.relations, self.signatures = {}, {}
            out.append(self.run(source))
        return out

    # -- statements
    def execute(self, s: t.Stmt):
        try:
            return self._execute(s)
        except ScriptError as e:
            raise ScriptError(f"line {s.line}: {e}" if s.line and not str(e).startswith("line ") else str(e)) from None

    def _execute(self, s: t.Stmt):
        if not s.out:
            work = lambda: getattr(self, f"do_{s.kind}")(s)
            return self._timed(s, work) if s.kind in ("dump", "display", "store") else work()
        sig = t.signature(s, [self.signatures.get(a, a) for a in s.ins])
        kept = self._store.get(sig) if self._store else None
        if sig in self.shared and s.kind not in ("sample", "delay", "cache"):
            r = self.shared[sig]
        else:
            ins = [self.relation(a) for a in s.ins]
            live = next((r for r in ins if r.deferred or r.whole), None)
            if live is None and s.kind in _BATCHWISE and any(r.df.isStreaming and not r.window for r in ins) and not self._streams(s, ins):
                live = ins[0]
            if live is not None:
                # A stored table beside the stream is there for each micro-batch.
                others = {a: x for a, x in zip(s.ins, ins) if x is not live}
                if len(ins) > 1 and (live.window or len(others) < len(ins) - 1 or any(x.df.isStreaming or x.deferred for x in others.values()) or s.kind != "join"):
                    raise ScriptError(f"{s.kind.upper()} of a live stream and another bag needs windows")
                r = replace(live, deferred=(*(live.deferred or ((s.ins[0], replace(live, whole=False)),)), *((a, x) for a, x in others.items()), s))
            else:
                r = getattr(self, f"op_{s.kind}")(s, *ins)
            if kept is not None:
                r = replace(loaders.from_columns(kept, r.schema.fields), window=r.window, stream=r.stream) if r.schema else r
            if self.graph is not None:
                r = self._watched(sig, [self.signatures.get(a, a) for a in s.ins], r)
            self.shared[sig] = r
        self.relations[s.out], self.signatures[s.out] = r, sig
        return None

    def _placed(self, file: str) -> str:
        """A relative path of an output, in the folder for outputs if there is one."""
        return file if self.outdir is None or file.startswith("/") or "://" in file else f"{self.outdir.rstrip('/')}/{file}"

    # -- profiling
    def statistics(self) -> list[str]:
        """A line for each operator that ran: its alias, average seconds, and bytes that it put out."""
        if self.graph is None:
            return []
        alias = {sig: a for a, sig in self.signatures.items()}
        return [f"{alias.get(sig, sig[:8])}: {sum(x) / len(x):.4f} s, {self.graph.sizes.get(sig, 'unknown')} bytes" for sig, x in self.graph.times.items()]

    def _watched(self, sig: str, inputs: list[str], r: Relation) -> Relation:
        """Counts the rows of an operator when it runs: executors count along, no pass of its own."""
        self._inputs[sig] = inputs
        if r.grouped or r.deferred or r.df.isStreaming:
            return r
        seen = self._seen[sig] = Observation()
        return replace(r, df=r.df.observe(seen, F.count(F.lit(1)).alias("rows")))

    def _measured(self, alias: str, seconds: float) -> None:
        """After an output ran: what its operators put out, and its time, dealt out to them by the rows that they took and gave."""
        path, todo = [], [self.signatures[alias]]
        while todo:
            sig = todo.pop()
            if sig not in path and sig in self._inputs:
                path.append(sig)
                todo += self._inputs[sig]
        rows = {}
        for sig in path:
            got = self._seen[sig]._jo.getOrEmpty() if sig in self._seen and self._seen[sig]._jo is not None else None
            if got is not None and not got.isEmpty():
                rows[sig] = int(got.apply("rows"))
        work = {sig: 1 + rows.get(sig, 0) + sum(rows.get(i, 0) for i in self._inputs[sig]) for sig in path}
        total = sum(work.values())
        for sig in reversed(path):
            r = self.shared.get(sig)
            width = 0 if r is None else sum(24 if isinstance(f.dataType, (T.StringType, T.ArrayType, T.MapType, T.StructType)) else 8 for f in r.df.schema)
            self.graph.ran(sig, self._inputs[sig], seconds * work[sig] / total, rows[sig] * width if sig in rows else None)

    def _timed(self, s: t.Stmt, work: Callable[[], object]):
        began = time.perf_counter()
        got = work()
        if self.graph is not None and not self.relation(s.ins[0]).df.isStreaming:
            self._measured(s.ins[0], time.perf_counter() - began)
        return got

    def _streams(self, s: t.Stmt, ins: list[Relation]) -> bool:
        """A GROUP of a live stream is taken on: a FOREACH or ACCUMULATE may run along."""
        return s.kind == "group"

    def op_load(self, s):
        fields = s["schema"]
        ts = s["timestamp"]
        at = None
        if ts is not None:
            if fields is None and not isinstance(ts, t.Pos):
                at = ts
            else:
                at = ts.index if isinstance(ts, t.Pos) else Schema(fields).find(ts.name)
        r = loaders.load(self.spark, s["file"], s["using"], fields, at if isinstance(at, int) else None, int(self.settings.get("max_files_per_trigger", 1)))
        if r.df.isStreaming and "*" not in s["file"]:
            self._last |= output.last_files(self.spark, s["file"])
        if at is not None and r.schema is not None:
            r = replace(r, schema=Schema(r.schema.fields, at if isinstance(at, int) else r.schema.find(at.name)))
        return r

    def op_rdfload(self, s):
        return loaders.rdf_load(self.spark, s["file"], s["grouped"])

    def op_socket_read(self, s):
        at = s["timestamp"]
        at = None if at is None or s["schema"] is None else at.index if isinstance(at, t.Pos) else Schema(s["schema"]).find(at.name)
        return loaders.socket(self.spark, s["address"], s["zmq"], s["using"], s["schema"], at)

    def op_filter(self, s, r):
        return relational.filter_(r, s["by"], self.functions)

    def op_foreach(self, s, r):
        if r.grouped and r.df.isStreaming and not r.window:
            return self._running(s.out, r, s["generate"])
        return relational.foreach(r, s["generate"], s["block"], self.functions)

    def op_accumulate(self, s, r):
        if r.df.isStreaming and not r.window:
            return self._running(s.out, r, s["generate"])
        return relational.accumulate(r, s["generate"], self.functions)

    def _running(self, name_: str, r: Relation, generate) -> Relation:
        """Keys and aggregates of a live stream as state, a row out for each row in."""
        g = r.grouped or relational.Grouped(r, "\0", (), True)
        rows = Lower(RowScope.of(g.base), self.functions)
        df = g.base.df.select("*", *([x.col.alias(f"_k{i}") for i, (_, x, _) in enumerate(g.keys)] or [F.lit(0).alias("_k0")]))
        keys = [f"_k{i}" for i in range(max(1, len(g.keys)))]
        lower = relational._GroupLower(g, self.functions)
        wanted, cols, fields, out = [], [], [], []
        for i, gen in enumerate(generate):
            e = gen.expr
            k = lower.key(e)
            if k is not None:
                cols.append(f"_k{k}")
                fields.append(Field(gen.alias.name if gen.alias else lower.field(e).name, g.keys[k][1].type))
                continue
            if not isinstance(e, t.Call) or e.name.upper() not in running.PARTS or len(e.args) != 1:
                raise ScriptError("a live stream without windows takes keys, COUNT, SUM, AVG, MIN and MAX")
            name = e.name.upper()
            x = None
            if name != "COUNT":
                ref = e.args[0].field if isinstance(e.args[0], t.Deref) and r.grouped else e.args[0]
                x = relational.B.number(rows.expr(ref)) if name in ("SUM", "AVG") else rows.expr(ref)
                df = df.withColumn(f"_x{i}", x.col)
            kind = SIMPLE["long"] if name == "COUNT" or name == "SUM" and x.type.name in ("int", "long") else SIMPLE["double"] if name in ("AVG", "SUM") else x.type
            wanted.append((name, f"_x{i}" if x is not None else "_k0"))
            out.append((f"_o{i}", to_spark(kind)))
            cols.append(f"_o{i}")
            fields.append(Field(gen.alias.name if gen.alias else "", kind))

        def advance(b: Relation, kept: running.Kept, number: int) -> Relation:
            made = running.running(b.df, keys, wanted, out, kept, number)
            return Relation(made.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(cols)]), Schema(tuple(fields)))

        df = df.select(*keys, *dict.fromkeys(c for _, c in wanted if c not in keys))
        return Relation(df, Schema(tuple(fields)), stream=True, deferred=(("\0rows", Relation(df, None)), running.Step(name_, "\0rows", advance)))

    def op_group(self, s, r):
        return relational.group(r, s.ins[0], s["keys"], self.functions)

    def op_cogroup(self, s, *rs):
        return relational.cogroup(list(rs), list(s.ins), list(s["keys"]), self.functions)

    def op_join(self, s, *rs):
        return relational.join(list(rs), list(s.ins), list(s["keys"]), self.functions)

    def op_cross(self, s, *rs):
        return relational.cross(list(rs), list(s.ins))

    def op_zip(self, s, *rs):
        return relational.zip_(list(rs), list(s.ins), s["index"])

    def op_union(self, s, *rs):
        return relational.union(list(rs))

    def op_intersection(self, s, a, b):
        return relational.intersection(a, b)

    def op_difference(self, s, a, b):
        return relational.difference(a, b, s["keys"], self.functions)

    def op_distinct(self, s, r):
        return relational.distinct(r)

    def op_limit(self, s, r):
        return relational.limit(r, s["n"])

    def op_order(self, s, r):
        return relational.order(r, s["by"], self.functions)

    def op_sample(self, s, r):
        return relational.sample(r, s["fraction"], self.functions, self.seed)

    def op_cache(self, s, r):
        return relational.cache(r, s["mode"])

    def op_delay(self, s, r):
        return relational.delay(r, s["wait"], s["factor"])

    def op_tuplify(self, s, r):
        return relational.tuplify(r, s["on"], self.functions)

    def op_window(self, s, r):
        if r.df.isStreaming and s["size"][0] == s["slide"][0] == "rows" and not r.window:
            advance = lambda b, kept, number: windows.counted(b, s["size"][1], s["slide"][1], kept, number)
            first = relational.settled(r)
            return replace(first, window=True, deferred=((s.ins[0], first), running.Step(s.out, s.ins[0], advance)))
        return windows.window(r, s["size"], s["slide"], str(self.settings.get("watermark", "0 seconds")), self._last)

    def op_bgp_filter(self, s, r):
        return rdf.bgp(r, s["triples"])

    def op_match_event(self, s, r):
        return cep.match(r, s["pattern"], s["events"], s["mode"], s["within"], s["by"], s["order"], self.functions)

    def op_spatial_filter(self, s, r):
        return spatial.filter_(r, s["predicate"], s["ref"], s["geometry"], self.functions)

    def op_spatial_join(self, s, a, b):
        return spatial.join([a, b], list(s.ins), s["predicate"], s["refs"], s["partition"], self.functions)

    def op_index(self, s, r):
        return spatial.index(r, s["on"], self.functions)

    def op_partition(self, s, r):
        return spatial.partition(r, s["on"], s["method"], self.functions)

    def op_stream(self, s, r):
        fn = self.operators.get(s["fn"])
        if fn is None:
            raise ScriptError(f"no operator {s['fn']!r}: register it with Session.operator")
        args = [p.value if isinstance(p, t.Lit) else output.names(r)[p.index] if isinstance(p, t.Pos) else p.name for p in s["params"]]
        return loaders.from_columns(fn(output.frame(relational.settled(r)), *args), s["schema"])

    def op_rscript(self, s, r):
        """The bag as a matrix of doubles through Rscript. The language gives the whole bag to one R process, so one task reads it all;
        R's own memory bounds it."""
        if shutil.which("Rscript") is None:
            raise ScriptError("RSCRIPT needs Rscript, which isn't installed")
        r = relational.settled(r)
        script, width = s["script"], len(r.columns)

        def apply(batches):
            rows = [row for b in batches for row in zip(*[c.to_pylist() for c in b.columns])]
            data = ",".join(str(float(v)) for row in zip(*rows) for v in row) if rows else ""
            code = f"x_ <- matrix(c({data}), ncol={width}); " + script.replace("$_", "x_") + "; write.table(as.matrix(res), col.names=FALSE, row.names=FALSE, sep=',')"
            text = subprocess.run(["Rscript", "-e", code], capture_output=True, text=True, check=True).stdout
            import pyarrow as pa

            got = [list(map(float, line.split(","))) for line in text.splitlines() if line]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got)], names=[f"_{i}" for i in range(len(got[0]))])

        fields = s["schema"] or tuple(Field("", SIMPLE["double"]) for _ in range(width))
        df = r.df.select(*[F.col(c).cast("double").alias(c) for c in r.columns]).coalesce(1).mapInArrow(apply, ", ".join(f"_{i} double" for i in range(len(fields))))
        return loaders.from_columns(df, fields)

    # -- outputs
    def _batch(self, r: Relation, work: Callable[[Relation], None]):
        """Starts a query on a live stream. What needs whole micro-batches is run on each of them."""
        checkpoint = self.settings.get("checkpoint")
        wait = bool(self.settings.get("available_now", True))
        deferred = r.deferred
        root = f"{str(checkpoint).rstrip('/')}/weftline" if checkpoint else scratch(self.spark)
        kept = {x: running.Kept(self.spark, f"{root}/{i}") for i, x in enumerate(deferred) if isinstance(x, running.Step)}

        def each(df: DataFrame, number: int) -> None:
            if not deferred:
                work(replace(r, df=df))
                return
            inner = Session(self.spark, seed=self.seed, out=self.out, optimize=False)
            inner.functions, inner.operators = self.functions, self.operators
            alias, first = deferred[0]
            inner.relations[alias] = replace(first, df=df, stream=False)
            for s in deferred[1:]:
                if isinstance(s, running.Step):
                    inner.relations[s.out] = s.advance(inner.relations[s.source], kept[s], number)
                elif isinstance(s, tuple):
                    inner.relations[s[0]] = s[1]
                else:
                    inner.execute(s)
            work(relational.settled(inner.relations[deferred[-1].out]))

        query = running.per_batch(r.df, each, checkpoint, wait)
        self.queries.append(query)
        if wait:
            query.awaitTermination()
        return query

    def do_dump(self, s):
        """All lines are printed by the driver, as the language has it; MUTE and STORE are there for more than it holds."""
        r = relational.settled(self.relation(s.ins[0])) if not self.relation(s.ins[0]).deferred else self.relation(s.ins[0])
        if r.df.isStreaming:
            return self._batch(r, lambda b: [self.out(x.value) for x in output.lines(b).collect()])
        if s["mute"] or self.mute:
            r.df.write.format("noop").mode("overwrite").save()
            return None
        got = [x.value for x in output.lines(r).collect()]
        for line in got:
            self.out(line)
        return got

    def do_display(self, s):
        text = output.display(relational.settled(self.relation(s.ins[0])), None if (n := self.settings.get("display_rows")) is None else int(n))
        self.out(text)
        return text

    def do_describe(self, s):
        r = self.relation(s.ins[0])
        text = f"{s.ins[0]}: {r.schema if r.schema else 'no schema'}"
        self.out(text)
        return text

    def do_store(self, s):
        file = s["file"] if (s["using"] or ("",))[0].lower() == "jdbcstorage" else self._placed(s["file"])
        r = self.relation(s.ins[0])
        r = r if r.deferred else relational.settled(r)
        if r.df.isStreaming:
            return self._batch(r, lambda b: output.store(b, file, s["using"], "append"))
        output.store(r, file, s["using"], self.mode)
        return None

    def do_materialize(self, s):
        if self._store is None:
            raise ScriptError("MATERIALIZE needs a session with a store")
        alias = s.ins[0]
        r = relational.settled(self.relation(alias))
        if r.schema is None:
            raise ScriptError("MATERIALIZE needs a schema")
        sig = self.signatures[alias]
        began = time.perf_counter()
        kept = self._store.put(sig, r.df, self.graph.benefit(sig) if self.graph else 0.0)
        if self.graph is not None:
            self._measured(alias, time.perf_counter() - began)
            if sig in self._store.entries:
                self.graph.sizes[sig] = self._store.entries[sig].size
        if kept is not None:
            self.relations[alias] = self.shared[sig] = replace(r, df=kept.select(*r.df.columns))
        return None

    def do_visualize(self, s):
        data = spatial.picture(self.relation(s.ins[0]), s["field"], s["width"], s["height"], self.functions, s["size"])
        file = self._placed(s["file"])
        Path(file).write_bytes(data)
        return file

    def do_socket_write(self, s):
        import socket

        r = relational.settled(self.relation(s.ins[0]))
        delimiter = loaders.arguments((s["using"] or ("", []))[1], "delim").get("delim", "\t")

        def send(b: Relation) -> None:
            text = (x.value for x in output.lines(b, delimiter).toLocalIterator())
            if s["zmq"]:
                from .streaming.zeromq import publish

                publish(s["address"], text)
                return
            host, _, port = s["address"].rpartition(":")
            with socket.create_connection((host, int(port)), timeout=30) as c:
                for line in text:
                    c.sendall(line.encode() + b"\n")

        if r.df.isStreaming:
            return self._batch(r, send)
        send(r)
        return None

    def do_fs(self, s):
        got = output.fs(self.spark, s["command"], s["params"])
        for line in got:
            self.out(line)
        return got or None

    def do_set(self, s):
        key, value = s["key"], s["value"]
        if key.startswith("spark."):
            if not key.startswith(_SPARK_SETTINGS):
                raise ScriptError(f"{key} can't be set by a script")
            self.spark.conf.set(key, str(value).lower() if isinstance(value, bool) else value)
        elif key == "ansi":
            self.spark.conf.set("spark.sql.ansi.enabled", "true" if value else "false")
        self.settings[key] = value
        return None

    def do_register(self, s):
        file = s["file"]
        if file.endswith(".py"):
            if not self.allow_code:
                raise ScriptError("registering Python files needs Session(allow_code=True)")
            self.spark.sparkContext.addPyFile(file)
            self._python(Path(file).read_text())
        elif file.endswith(".jar"):
            # Executors fetch it, and this session's class loader takes it on, so that DEFINE finds its classes.
            if not self.allow_code:
                raise ScriptError("registering jars needs Session(allow_code=True)")
            self.spark.sql("ADD JAR '" + file.replace("'", "\\'") + "'")
        else:
            raise ScriptError(f"can't register {file!r}")
        return None

    def do_define(self, s):
        self.functions.aliases[s["name"]] = (s["target"], s["params"])
        return None

    # -- embedded code
    def _embed(self, s: t.Stmt) -> None:
        if not self.allow_code:
            raise ScriptError("embedded code needs Session(allow_code=True)")
        self._python(s["code"])
        if s["rules"]:
            space = {"rewrite": rewrite, "tree": t}
            exec(compile(_dedented(s["rules"]), "<rules>", "exec", dont_inherit=True), space)  # noqa: S102
            self.rules += [f for n, f in space.items() if callable(f) and n.startswith("rule")]

    def _python(self, code: str) -> None:
        """Functions with annotated results become Arrow-batched UDFs; those of DataFrames become operators."""
        space: dict = {}
        exec(compile(_dedented(code), "<embedded>", "exec", dont_inherit=True), space)  # noqa: S102
        names = {int: "long", float: "double", str: "chararray", bool: "boolean"}
        for name, fn in list(space.items()):
            if not callable(fn) or name.startswith("_") or not hasattr(fn, "__annotations__"):
                continue
            result = fn.__annotations__.get("return")
            if result in names:
                kind = SIMPLE[names[result]]
                udf = F.udf(fn, to_spark(kind), useArrow=True)
                self.functions.python[name] = (udf, kind)
            else:
                self.operators[name] = fn


def _dedented(code: str) -> str:
    import textwrap

    return textwrap.dedent(code.strip("\n"))


__all__ = ["Session", "from_spark", "sys"]

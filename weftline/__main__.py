"""Command line: run scripts, show plans, or type statements on a console."""

from __future__ import annotations

import argparse
import shlex
import subprocess
import sys
import time
from pathlib import Path

from .plans import rewrite
from .plans.preprocess import parameter_file
from .session import Session
from .types import ScriptError

HELP = "Statements end with a semicolon. DUMP, DISPLAY, STORE and DESCRIBE run at once. Others: help, aliases, rewrite, prettyprint, quit."


def console(session: Session, lines=None, out=print) -> None:
    """Reads statements until their brackets close and a semicolon ends them. Aliases may be defined again."""
    buffer = ""
    for line in lines if lines is not None else _typed():
        word = line.strip().rstrip(";").lower()
        if not buffer and word in ("quit", "exit"):
            return
        if not buffer and word in ("help", "aliases", "rewrite", "prettyprint"):
            out(HELP if word == "help" else "\n".join(sorted(session.relations)) if word == "aliases" else rewrite.described(session.plan))
            continue
        buffer += line if line.endswith("\n") else line + "\n"
        opened = sum(buffer.count(c) for c in "({[") - sum(buffer.count(c) for c in ")}]")
        if opened <= 0 and buffer.rstrip().endswith((";", "%>")) or word.startswith("fs "):
            try:
                session.run(buffer, redefine=True)
            except ScriptError as e:
                out(f"error: {e}")
            buffer = ""


def _typed():
    while True:
        try:
            yield input("weftline> ")
        except EOFError:
            return


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("weftline", description=__doc__)
    p.add_argument("scripts", nargs="*")
    p.add_argument("-i", "--interactive", action="store_true")
    p.add_argument("-m", "--master")
    p.add_argument("-p", "--param", action="append", default=[], help="name=value")
    p.add_argument("--param-file", action="append", default=[])
    p.add_argument("--show-plan", action="store_true")
    p.add_argument("--dot", action="store_true", help="the plan for Graphviz")
    p.add_argument("--no-optimization", action="store_true")
    p.add_argument("--mute-consumer", action="store_true")
    p.add_argument("--allow-code", action="store_true", help="run embedded Python")
    p.add_argument("--profiling", action="store_true")
    p.add_argument("--sequential", action="store_true", help="scripts one by one, without sharing plans")
    p.add_argument("--store", help="folder for MATERIALIZE")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--outdir", help="folder for STORE's and VISUALIZE's relative paths")
    p.add_argument("--log-level", default="WARN", choices=["OFF", "ERROR", "WARN", "INFO", "DEBUG", "TRACE"])
    p.add_argument("--show-stats", action="store_true", help="seconds of each script; with --profiling also rows and seconds of its operators")
    p.add_argument("--notify", metavar="COMMAND", help="run when all is done, with 'ok' or the error as its last argument")
    p.add_argument("--backend-args", action="append", default=[], metavar="NAME=VALUE", help="a Spark setting")
    a = p.parse_args(argv)
    params = {}
    for f in a.param_file:
        params |= parameter_file(f)
    params |= dict(x.partition("=")[::2] for x in a.param)
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("weftline").config("spark.sql.session.timeZone", "UTC")
    for setting in a.backend_args:
        name, _, value = setting.partition("=")
        builder = builder.config(name, value)
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    spark.sparkContext.setLogLevel(a.log_level)
    make = lambda base: Session(spark, params, allow_code=a.allow_code, optimize=not a.no_optimization, mute=a.mute_consumer, store=a.store, mode="overwrite" if a.overwrite else "errorifexists", base=base, profile=a.profiling, outdir=a.outdir, out=(lambda *_: None) if a.quiet else print)
    session = make(".")
    try:
        for script in a.scripts:
            if a.sequential:
                session = make(Path(script).parent)
            session.base = Path(script).parent
            session.relations, session.signatures = {}, {}
            source = Path(script).read_text()
            if a.show_plan or a.dot:
                plan = session.prepare(source)
                print(rewrite.dot(plan) if a.dot else rewrite.described(plan))
            else:
                began = time.perf_counter()
                session.run(source)
                if a.show_stats:
                    print(f"{script}: {time.perf_counter() - began:.3f} s")
                    for line in session.statistics():
                        print(line)
        if a.interactive or not a.scripts:
            console(session)
    except ScriptError as e:
        print(f"error: {e}", file=sys.stderr)
        _notify(a.notify, f"error: {e}")
        return 1
    _notify(a.notify, "ok")
    return 0


def _notify(command: str | None, message: str) -> None:
    if command:
        subprocess.run([*shlex.split(command), message], check=False)


if __name__ == "__main__":
    sys.exit(main())

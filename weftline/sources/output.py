"""Printed form of rows, storers and file system commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.expressions import Relation
from ..types import BagType, MapType, MatrixType, ScriptError, TupleType, Type
from .loaders import arguments, jdbc_append, jdbc_inside, jdbc_options


def printed(c: Column, t: Type) -> Column:
    """A value as text: tuples (a,b), bags {(a),(b)}, maps [k#v]. Nulls are empty."""
    if isinstance(t, TupleType):
        if t.fields is None:
            return F.concat(F.lit("("), F.array_join(c.getField("_raw"), ",", ""), F.lit(")"))
        return F.concat(F.lit("("), F.concat_ws(",", *[F.coalesce(printed(c.getField(f"_{i}"), f.type), F.lit("")) for i, f in enumerate(t.fields)]), F.lit(")"))
    if isinstance(t, BagType):
        return F.concat(F.lit("{"), F.array_join(F.transform(c, lambda x: printed(x, t.item)), ","), F.lit("}"))
    if isinstance(t, MapType):
        entries = F.transform(F.array_sort(F.map_entries(c.cast("map<string,string>") if not isinstance(t.value, (TupleType, BagType, MapType)) else c)), lambda e: F.concat(e.getField("key"), F.lit("#"), F.coalesce(printed(e.getField("value"), t.value), F.lit(""))))
        return F.concat(F.lit("["), F.array_join(entries, ","), F.lit("]"))
    if isinstance(t, MatrixType) or t.name == "geometry":
        return F.to_json(c) if isinstance(t, MatrixType) else c.getField("wkt")
    return c.cast("string")


def lines(r: Relation, delimiter: str = ",") -> DataFrame:
    """Each row as one line, in a column named value."""
    if r.schema is None:
        return r.df.select(F.array_join("_raw", delimiter, "").alias("value"))
    return r.df.select(F.concat_ws(delimiter, *[F.coalesce(printed(F.col(f"_{i}"), f.type), F.lit("")) for i, f in enumerate(r.schema.fields)]).alias("value"))


def names(r: Relation) -> list[str]:
    """Column names of a result: the fields' own where they are there and unique, else with their lineage or position."""
    if r.schema is None:
        return ["_raw"]
    out: list[str] = []
    bare = [f.name for f in r.schema.fields]
    for i, f in enumerate(r.schema.fields):
        n = f.name if f.name and bare.count(f.name) == 1 else "::".join([*f.lineage, f.name]) if f.name else f"_{i}"
        out.append(n if n not in out else f"{n}_{i}")
    return out


def frame(r: Relation) -> DataFrame:
    """The rows under the script's names."""
    return r.df.select(*[F.col(c).alias(n) for c, n in zip(r.columns, names(r))])


def modified(spark: SparkSession, folder: str) -> dict[str, int]:
    """Visible files of a folder with their modification times; none where there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not at.exists(path):
        return {}
    return {s.getPath().getName(): s.getModificationTime() for s in at.listStatus(path) if s.isFile() and not s.getPath().getName().startswith(("_", "."))}


def in_order(spark: SparkSession, folder: str, before: dict[str, int]) -> None:
    """New files get their modification times in the order of their rows. Tasks end in any order, and a live stream takes files by
    these times, so that a bag from ORDER would come out of it in disorder. Stores that keep no such times stay as they are."""
    new = {n: m for n, m in modified(spark, folder).items() if before.get(n) != m}
    times, names_ = sorted(new.values()), sorted(new)
    for i in range(len(times) - 2, -1, -1):
        times[i] = min(times[i], times[i + 1] - 1)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for n, m in zip(names_, times):
        if new[n] != m:
            path = jvm.org.apache.hadoop.fs.Path(folder, n)
            path.getFileSystem(conf).setTimes(path, m, -1)


def last_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """For each job that wrote several files of a folder, the one that a live stream takes last."""
    import re

    from ..streaming.windows import JOB

    found: dict[str, list] = {}
    for n, m in modified(spark, folder).items():
        if job := re.match(JOB, n):
            found.setdefault(job[1], []).append((m, n))
    return {job: max(files)[1] for job, files in found.items() if len(files) > 1}


def store(r: Relation, file: str, using: tuple[str, list] | None, mode: str = "errorifexists") -> None:
    name, params = using or ("PigStorage", [])
    kind = name.lower()
    if kind in ("pigstorage", "textloader", "rdffilestorage", "pigstream"):
        spark, before = r.df.sparkSession, modified(r.df.sparkSession, file)
        lines(r, arguments(params, "delim").get("delim", "," if kind != "rdffilestorage" else " ")).write.mode(mode).text(file)
        in_order(spark, file, before)
    elif kind in ("jsonstorage", "jsonstorage2"):
        frame(r).write.mode(mode).json(file)
    elif kind in ("binstorage", "binstorage2", "parquet", "parquetstorage"):
        frame(r).write.mode(mode).parquet(file)
    elif kind in ("csv", "csvstorage"):
        a = arguments(params, "delim", "header")
        frame(r).write.mode(mode).csv(file, sep=a.get("delim", ","), header=bool(a.get("header", False)))
    elif kind == "orc":
        frame(r).write.mode(mode).orc(file)
    elif kind == "jdbcstorage":
        o = jdbc_options(params, file)
        if jdbc_inside(o):
            jdbc_append(frame(r), o)
        else:
            frame(r).write.mode("append").format("jdbc").options(**o).save()
    else:
        raise ScriptError(f"no storer {name!r}")


def display(r: Relation, rows: int | None = None) -> str:
    """A table for notebooks: a header line and all rows, separated by tabs, fetched one partition at a time. ``rows`` (a script's
    ``SET display_rows``) shows the first ones alone and says so in a last line."""
    head, text = "\t".join(names(r)), lines(r, "\t")
    if rows is None:
        return "%table " + "\n".join([head, *(x.value for x in text.toLocalIterator())])
    got = [x.value for x in text.limit(rows + 1).collect()]
    return "%table " + "\n".join([head, *got[:rows]]) + (f"\nthe first {rows} rows" if len(got) > rows else "")


def fs(spark: SparkSession, command: str, params: list[str]) -> list[str]:
    """File system commands, by Hadoop's own file systems, so that they reach any store Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    at = lambda p: path(p).getFileSystem(conf)
    flags, names_ = [p for p in params if p.startswith("-")], [p for p in params if not p.startswith("-")]

    def need(n: int) -> None:
        if len(names_) < n:
            raise ScriptError(f"fs -{command} needs {n} paths")

    if command in ("copytolocal", "copytoremote", "getmerge"):
        need(2)
        source, target = names_[0], names_[1]
        if command == "copytolocal":
            at(source).copyToLocalFile(path(source), path(target))
        elif command == "copytoremote":
            at(target).copyFromLocalFile(path(source), path(target))
        else:
            got = sorted(str(s.getPath()) for s in at(source).listStatus(path(source)) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
            out = at(target).create(path(target), True)
            for g in got:
                stream = at(g).open(path(g))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 65536, False)
                stream.close()
            out.close()
        return []
    need(1)
    if command in ("rm", "rmdir"):
        for p in names_:
            if command == "rmdir" and len(at(p).listStatus(path(p))):
                raise ScriptError(f"{p} isn't empty")
            at(p).delete(path(p), "-r" in flags)
        return []
    if command == "mkdir":
        for p in names_:
            at(p).mkdirs(path(p))
        return []
    if command == "ls":
        return sorted(str(s.getPath()) for p in names_ for s in at(p).listStatus(path(p)))
    if command == "cat":
        return [x.value for p in names_ for x in spark.read.text(p).collect()]
    raise ScriptError(f"no file system command {command!r}")

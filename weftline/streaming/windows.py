"""Windows over rows: by time for tables and streams, by count for tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.expressions import WINDOW, Relation
from ..operators.relational import indexed, settled
from ..types import ScriptError
from .running import Kept

#: The job that wrote a part file, in its name.
JOB = r"^part-\d+-([0-9a-f]{8}-[0-9a-f-]{27})"


def moment(r: Relation) -> Column:
    """The time of a row: its timestamp field, numbers being seconds; on a stream without one, the time of processing."""
    if r.schema is not None and r.schema.timestamp is not None:
        name = f"_{r.schema.timestamp}"
        kind = r.df.schema[name].dataType
        if isinstance(kind, T.NumericType):
            return F.timestamp_seconds(F.col(name))
        return F.col(name) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.col(name).cast("timestamp")
    if r.df.isStreaming:
        return F.current_timestamp()
    raise ScriptError("a RANGE window needs TIMESTAMP(field)")


def _waiting(df: DataFrame, last: dict[str, str]) -> Column | None:
    """Whether a row of a live stream is in a file of a stored bag (``last``: job that wrote it, its last file) with more to come."""
    # Behind a join a file's name may be another input's.
    if not last or df._jdf.queryExecution().analyzed().collectLeaves().size() > 1:
        return None
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return F.regexp_extract(name, JOB, 1).isin(list(last)) & ~name.isin(list(last.values()))


def window(r: Relation, size: tuple[str, int], slide: tuple[str, int], watermark: str = "0 seconds", last: dict[str, str] | None = None) -> Relation:
    """Each row once for every window it is in; the window is a hidden column until a FOREACH, JOIN or CROSS ends it. The files of one
    stored bag arrived together, in no order of time: the watermark of a live stream goes on when the last of them has been read."""
    r = settled(r)
    if r.window:
        raise ScriptError("the input has windows already")
    if size[0] == slide[0] == "range":
        df = r.df.withColumn("_t", moment(r))
        if df.isStreaming:
            if (waiting := _waiting(df, last or {})) is None:
                df = df.withWatermark("_t", watermark)
            else:
                # The watermark follows a column of its own; the time keeps its mark, by which Spark tells late rows and full windows.
                df = df.withColumn("_h", F.when(waiting, F.timestamp_micros(F.lit(0))).otherwise(F.col("_t").cast("timestamp"))).withWatermark("_h", watermark)
                mark = df.schema["_h"].metadata
                df = df.select(*[c for c in df.columns if c not in ("_t", "_h")], F.col("_t").alias("_t", metadata=mark))
        df = df.withColumn(WINDOW, F.window("_t", f"{size[1]} seconds", f"{slide[1]} seconds"))
        return replace(r, df=df.drop("_t") if not df.isStreaming else df.select(*r.df.columns, WINDOW), window=True)
    if r.df.isStreaming:
        return _live(r, size, slide)
    if size[0] == "rows" and slide[0] == "rows":
        n, step = size[1], slide[1]
        # Without a timestamp rows keep the order that an ORDER or the file gave them.
        timed = r.schema is not None and r.schema.timestamp is not None
        df = _numbered(r, r.df, f"_{r.schema.timestamp}") if timed else indexed(r)
        last = F.floor(F.col("_n") / step)
        first = F.greatest(F.lit(0), F.floor((F.col("_n") - n) / step) + 1)
        df = df.withColumn("_i", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
        return replace(r, df=df.withColumn(WINDOW, F.struct(F.col("_i").cast("bigint").alias("start"))).drop("_n", "_i"), window=True)
    if size[0] == "range":
        # A window of time behind every k-th row.
        df = _numbered(r, r.df.withColumn("_t", moment(r)), "_t").withColumn("_n", F.col("_n") + 1)
        ends = df.where(F.col("_n") % slide[1] == 0).select(F.col("_t").alias("_e"), F.col("_n").alias("_m"))
        inside = (F.col("_t") <= F.col("_e")) & (F.col("_t") > F.col("_e") - F.expr(f"INTERVAL {size[1]} SECONDS")) & (F.col("_n") <= F.col("_m"))
        # Time buckets as long as the window bring a row and its possible ends together.
        bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / size[1])
        ends = ends.withColumn("_b", F.explode(F.array(bucket("_e"), bucket("_e") - 1)))
        df = df.withColumn("_b", bucket("_t")).join(ends, "_b").where(inside)
        return replace(r, df=df.select(*r.df.columns, F.struct(F.col("_m").alias("start")).alias(WINDOW)), window=True)
    # The last n rows at each turn of the clock.
    df = r.df.withColumn("_t", moment(r)).withColumn("_turn", F.window("_t", f"{slide[1]} seconds"))
    df = _numbered(r, df, "_t").withColumn("_n", F.col("_n") + 1)
    turns = df.groupBy("_turn").agg(F.max("_n").alias("_m")).select(F.col("_turn").alias("_end"), "_m", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_m") - size[1] + 1), F.col("_m"))).alias("_n"))
    df = df.drop("_turn").join(turns, "_n")
    return replace(r, df=df.select(*r.df.columns, F.struct(F.col("_m").alias("start")).alias(WINDOW)), window=True)


def counted(r: Relation, size: int, slide: int, kept: Kept, number: int) -> Relation:
    """The windows by count that a micro-batch of a live stream fills, whole. Its rows get their positions in the stream, in the order
    of their times (without times: as they arrive); the state is the rows that a later window needs and two numbers, so that no task
    sees the whole stream."""
    df = r.df
    if r.schema is not None and r.schema.timestamp is not None:
        df = df.withColumn("_t", moment(r)).withColumn("_at", F.monotonically_increasing_id()).orderBy("_t", "_at").select(*r.columns)
    rows, before = indexed(replace(r, df=df)).select(*r.columns, "_n"), kept.before(number)
    total, first = before[1] if before else (0, 0)
    new = rows.select(*r.columns, (F.col("_n") + total).alias("_n"))
    total += rows.count()
    if before:
        new = df.sparkSession.read.schema(new.schema).parquet(before[0]).unionByName(new)
    until = max(first, (total - size) // slide + 1)
    kept.put(number, new.where(F.col("_n") >= until * slide), total, until)
    low = F.greatest(F.lit(first), F.floor((F.col("_n") - size) / slide) + 1)
    high = F.least(F.lit(until - 1), F.floor(F.col("_n") / slide))
    new = new.where(low <= high).withColumn("_i", F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))))
    return replace(r, df=new.select(*r.columns, F.struct(F.col("_i").alias("start")).alias(WINDOW)), window=True)


def _live(r: Relation, size: tuple[str, int], slide: tuple[str, int]) -> Relation:
    """Windows that count rows and seconds of a live stream, in the order of their times. The stream is one
    sequence, so one task keeps the rows that may still be needed as state: the last n, or those of the last n seconds. A window's rows
    come out together when it is full, so that each later step finds whole windows in a micro-batch."""
    columns = r.columns
    timed = r.schema is not None and r.schema.timestamp is not None
    if not timed:
        raise ScriptError("a RANGE window needs TIMESTAMP(field)")
    df = r.df.withColumn("_t", (F.unix_micros(moment(r).cast("timestamp")) / 1e6).cast("double")).withColumn("_one", F.lit(0))
    out = T.StructType([*[f for f in r.df.schema if f.name in columns], T.StructField("_start", T.LongType())])

    def advance(key, parts, state):
        import pickle

        import pandas as pd

        rows, count, turn, ready = pickle.loads(state.get[0]) if state.exists else ([], 0, None, 0)
        part = pd.concat(list(parts), ignore_index=True).sort_values("_t", kind="stable")[["_t", *columns]].astype(object)
        found = []
        for row in part.where(part.notna(), None).itertuples(index=False, name=None):
            if slide[0] == "range":  # the last rows when the clock has gone on to another turn
                now = row[0] // slide[1]
                if turn is not None and now != turn:
                    found += [(*x[1:], ready) for x in rows[-size[1] :]]
                    ready += 1
                turn = now
            rows.append(row)
            count += 1
            if slide[0] == "rows" and count % slide[1] == 0:
                found += [(*x[1:], count) for x in rows if x[0] > row[0] - size[1]]
            rows = rows[-size[1] :] if size[0] == "rows" else [x for x in rows if x[0] > row[0] - size[1]] if count % 64 == 0 else rows
        state.update((pickle.dumps((rows, count, turn, ready)),))
        yield pd.DataFrame(found, columns=[*columns, "_start"])

    got = df.groupBy("_one").applyInPandasWithState(advance, out, T.StructType([T.StructField("state", T.BinaryType())]), "append", "NoTimeout")
    got = got.select(*columns, F.struct(F.col("_start").alias("start")).alias(WINDOW))
    return replace(r, df=got, window=True, whole=True)


def _numbered(r: Relation, df: DataFrame, at: str) -> DataFrame:
    """The rows with their position from 0, _n, in the order of a column and then of all others: a sort by ranges, no single task."""
    return indexed(replace(r, df=df.orderBy(at, *[c for c in r.columns if _sortable(r, c)])))


def _sortable(r: Relation, c: str) -> bool:
    return isinstance(r.df.schema[c].dataType, T.AtomicType)

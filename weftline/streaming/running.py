"""Live streams taken a micro-batch at a time: steps that keep state between batches, and running aggregates, a row out for each row in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import delete

#: Functions of a running aggregate: what it keeps.
PARTS: dict[str, tuple[str, ...]] = {"COUNT": ("rows",), "SUM": ("sum",), "MIN": ("min",), "MAX": ("max",), "AVG": ("sum", "count")}
_OVER = {"rows": F.count, "count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
_AGAIN = {"rows": F.sum, "count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True, eq=False)
class Step:
    """A step with state in the chain of statements that run on each micro-batch: ``advance(relation, kept, number)`` gives a relation."""

    out: str
    source: str
    advance: Callable


class Kept:
    """The state of a step: a table for each micro-batch, with some whole numbers in its name. That of the batch before stays until
    the next one is done, so that a repeated batch starts from what it started from."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _versions(self) -> list[tuple[int, ...]]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        at = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(tuple(map(int, x.getPath().getName().split("-"))) for x in at.listStatus(path)) if at.exists(path) else []

    def before(self, number: int) -> tuple[str, tuple[int, ...]] | None:
        found = [v for v in self._versions() if v[0] < number]
        return (f"{self.root}/{'-'.join(map(str, found[-1]))}", found[-1][1:]) if found else None

    def put(self, number: int, df: DataFrame, *numbers: int) -> None:
        for v in self._versions():
            if v[0] < number - 1:
                delete(self.spark, f"{self.root}/{'-'.join(map(str, v))}")
        df.write.mode("overwrite").parquet(f"{self.root}/{'-'.join(map(str, (number, *numbers)))}")


def running(df: DataFrame, keys: list[str], aggregates: list[tuple[str, str]], out: list[tuple[str, T.DataType]], kept: Kept, number: int) -> DataFrame:
    """``aggregates``: (function, column). A micro-batch's keys, then ``out`` named columns, in the order of its rows. The state is a row
    for each key; a key's rows of one batch pass through one task, which holds none of them."""
    steps = []
    for (name, c), (_, kind) in zip(aggregates, out):
        for part in PARTS[name]:
            x = F.lit(1) if part == "rows" else F.col(c).cast("double" if name == "AVG" else kind) if part == "sum" else F.col(c)
            steps.append((part, x))
    rows = df.withColumn("_at", F.monotonically_increasing_id())
    along = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select(*keys, *[_OVER[part](x).over(along).alias(f"_a{k}") for k, (part, x) in enumerate(steps)])
    sums = rows.groupBy(*keys).agg(*[_OVER[part](x).alias(f"_b{k}") for k, (part, x) in enumerate(steps)])
    if before := kept.before(number):
        prior = df.sparkSession.read.schema(sums.schema).parquet(before[0])
        sums = prior.unionByName(sums).groupBy(*keys).agg(*[_AGAIN[part](f"_b{k}").alias(f"_b{k}") for k, (part, _) in enumerate(steps)])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"p{k}"))
        own = own.join(prior.select(*[F.col(k).alias(f"p{k}") for k in keys], *[f"_b{k}" for k in range(len(steps))]), same, "left")
    else:
        own = own.select("*", *[F.lit(None).cast(sums.schema[f"_b{k}"].dataType).alias(f"_b{k}") for k in range(len(steps))])
    kept.put(number, sums)
    both = []
    for k, (part, _) in enumerate(steps):
        a, b = F.col(f"_a{k}"), F.col(f"_b{k}")
        both.append({"sum": F.coalesce(a + b, a, b), "rows": a + F.coalesce(b, F.lit(0)), "count": a + F.coalesce(b, F.lit(0)), "min": F.least(a, b), "max": F.greatest(a, b)}[part])
    cols, k = [], 0
    for (name, _), (n, kind) in zip(aggregates, out):
        c = both[k] / F.when(both[k + 1] > 0, both[k + 1]) if name == "AVG" else both[k]
        cols.append(c.cast(kind).alias(n))
        k += len(PARTS[name])
    return own.select(*keys, *cols)


def per_batch(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str | None = None, available_now: bool = True):
    """Starts a query that hands each micro-batch to ``work`` as an ordinary frame."""
    writer = df.writeStream.foreachBatch(work)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()

"""Small helpers that several corpus operators share."""

from __future__ import annotations

import math

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..shared import delete as delete
from ..shared import scratch as scratch
from ..shared import written as written

#: Word separators of all operators that split text into words: blank and U+0009 to U+000D.
SEPARATORS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """The stored size of all that the plan reads, from metadata alone."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def parts_for(df: DataFrame, mb_each: float, least: int = 1) -> int:
    """How many groups of about ``mb_each`` MB the plan's estimated bytes make; follows the input without limit."""
    size = plan_bytes(df)
    if size > 1 << 50:  # a plan without statistics
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, math.ceil(size / (mb_each * 1e6)))


def spread(df: DataFrame, mb_each: float = 16.0) -> DataFrame:
    """The rows dealt evenly to all cores where the input is small: a table in one file of few row groups is read by few
    tasks. Inputs of at least ``mb_each`` MB to a core are taken as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan_bytes(df) < cores * mb_each * 1e6 else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it no column of the table."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(sizes, budget: int):
    """Consecutive (start, end) ranges of at most ``budget`` in total, each of one item at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > budget:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def slices_of(batch, at: int, budget: int = 4_000_000):
    """Slices of an Arrow batch with at most ``budget`` bytes of text in column ``at``, unless one text alone has more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    for a, b in slices(sizes, budget):
        yield batch.slice(a, b - a)


def text_slices(batch, at: int, budget: int = 4_000_000):
    """The same slices with their texts, null texts being empty; only one slice's texts are Python strings at a time."""
    for part in slices_of(batch, at, budget):
        yield part, [t or "" for t in part.column(at).to_pylist()]

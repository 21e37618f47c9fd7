"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, scratch


class UnionFind:
    """Sets of integers, each known by its smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            up = parent.get(x, x)
            parent[x] = root
            x = up
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a > b:
            a, b = b, a
        self.parent.setdefault(a, a)
        self.parent[b] = a

    def join_all(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins pairs of two arrays: one partner for each distinct a at a time, dropping the pairs that this joins already."""
        while len(a):
            first = np.unique(a, return_index=True)[1]
            for x, y in zip(a[first].tolist(), b[first].tolist()):
                self.join(x, y)
            root = []
            for c in (a, b):
                values, at = np.unique(c, return_inverse=True)
                root.append(np.array([self.find(x) for x in values.tolist()], np.int64)[at])
            apart = root[0] != root[1]
            a, b = a[apart], b[apart]


def contracted(links: DataFrame) -> DataFrame:
    """The links of each partition as stars, which connect the same: at most one row per id and partition."""

    def run(batches):
        sets = UnionFind()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if a != b:
                    sets.join(a, b)
        ids = [x for x in sets.parent if sets.find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([sets.find(x) for x in ids], pa.int64())], names=["u", "v"])

    a, b = links.columns
    return links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).mapInArrow(run, "u bigint, v bigint")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, stars: bool = False) -> DataFrame:
    """``(id, component_id)`` for every linked id but the smallest of each component, which stands for itself.
    ``stars``: whether each partition's links are stars already. Only two numbers a round, a count and a hash sum, reach
    the driver."""
    a, b = links.columns
    plain = links.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).where("u <> v")
    spark, before, paths = links.sparkSession, None, []

    def kept(df: DataFrame) -> DataFrame:
        """A round as a table; the one before the last is no longer needed."""
        paths.append(scratch(spark))
        df.write.parquet(paths[-1])
        if len(paths) > 1:
            delete(spark, paths[-2])
        return spark.read.schema(df.schema).parquet(paths[-1])

    edges = kept((plain if stars else contracted(links)).distinct())
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        before = state
        edges = kept(_small_star(_large_star(edges).distinct()).distinct())

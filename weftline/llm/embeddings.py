"""Near-duplicate embeddings by an epsilon grid order join (operator 4).

Equal vectors of a label are one class. Unit vectors at cosine c lie at most eps = sqrt(2 - 2c) apart, and an orthonormal
projection brings none of them further apart, so boxes on the leading principal dimensions bound the search. Classes are sorted
by label and by their grid cells of side eps (in lexicographic order, ties by id), by ranges, and the sequence is cut into intervals of at most ``BLOCK`` vectors,
whatever the cells hold. The recursive join of the sequence with itself starts from pairs of coarse intervals, which pass on to the pairs of
their parts only while their boxes are within eps; this works on one box for each interval, never on vectors. What is left is dealt
out: an interval meets a few later ones in a task, and of these only the vectors within eps of its box are sent. In a task the
recursion goes on down to small blocks of vectors, whose cosines are computed.
The principal dimensions come from a bounded sample; they steer speed alone, the result is exact for any.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component, or whose label or id is null, links
with nothing and is kept; its component is its id. Vectors of different lengths don't link. Repeated rows count as vectors of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_for, written
from .components import UnionFind, components

COSINE = 0.98
#: Grid dimensions, vectors and components of an interval, later intervals that meet one in a task, vectors of the sample.
LEADING, BLOCK, COMPONENTS, GUESTS, SAMPLE = 8, 1024, 1 << 20, 8, 4096
#: Intervals of one level that make one of the next; MB of stored vectors to a range of the sort.
FAN, RANGE_MB = 32, 32
_LEAF = 128


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal(sample: np.ndarray, dims: int) -> np.ndarray:
    """Orthonormal leading directions as columns."""
    _, _, v = np.linalg.svd(sample - sample.mean(axis=0), full_matrices=False)
    return v[:dims].T


def _separate(lo_a, hi_a, lo_b, hi_b) -> float:
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(gap @ gap)


def _limit(eps: float) -> float:
    """Squared distance up to which boxes are not apart."""
    return eps * eps * (1 + 1e-9) + 1e-12


class GridOrderJoin:
    """All pairs with cosine of at least ``least`` among the first ``home`` rows, and of these with the others."""

    def __init__(self, x: np.ndarray, lead: np.ndarray, home: int, least: float, eps: float):
        self.x, self.least, self.limit, self.home = x, least, _limit(eps), home
        cells = np.floor(lead / eps).astype(np.int64)
        self.order = np.concatenate([np.lexsort(cells[:home].T[::-1]), home + np.lexsort(cells[home:].T[::-1])])
        self.lead = lead[self.order]
        self.linked: list[tuple[np.ndarray, np.ndarray]] = []

    def box(self, a: int, b: int):
        part = self.lead[a:b]
        return part.min(axis=0), part.max(axis=0)

    def join(self, a: int, b: int, c: int, d: int) -> None:
        """Intervals [a, b) and [c, d) of the sequence; the same interval, or the first one earlier."""
        same = (a, b) == (c, d)
        if b - a <= 0 or d - c <= 0 or not same and _separate(*self.box(a, b), *self.box(c, d)) > self.limit:
            return
        if b - a <= _LEAF and d - c <= _LEAF:
            i, j = self.order[a:b], self.order[c:d]
            p, q = np.nonzero(self.x[i] @ self.x[j].T >= self.least)
            if same:
                p, q = p[p < q], q[p < q]
            if len(p):
                self.linked.append((i[p], j[q]))
            return
        m, n = (a + b) // 2, (c + d) // 2
        if same:
            self.join(a, m, a, m)
            self.join(a, m, m, b)
            self.join(m, b, m, b)
        elif b - a > _LEAF and d - c > _LEAF:
            for k, l in ((a, m), (m, b)):
                self.join(k, l, c, n)
                self.join(k, l, n, d)
        elif b - a > _LEAF:
            self.join(a, m, c, d)
            self.join(m, b, c, d)
        else:
            self.join(a, b, c, n)
            self.join(a, b, n, d)

    def pairs(self, within: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
        """The pairs, block by block; ``within``: also those among the first rows."""
        if within:
            self.join(0, self.home, 0, self.home)
        self.join(0, self.home, self.home, len(self.order))
        return self.linked


def _matrix(column: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    """Some rows of a list column, all of the same length, as a matrix."""
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)


def _gap(a: str, b: str) -> Column:
    """Squared distance of two boxes, or of a point and a box, given as arrays of least and greatest coordinates."""
    x, y = f"zip_with({a}lo, {b}hi, (p, q) -> greatest(0D, p - q))", f"zip_with({b}lo, {a}hi, (p, q) -> greatest(0D, p - q))"
    return F.expr(f"aggregate(zip_with({x}, {y}, (p, q) -> greatest(p, q)), 0D, (s, p) -> s + p * p)")


def _near_intervals(boxes: DataFrame, ranges: int, limit: float) -> DataFrame:
    """Pairs ``x <= y`` of intervals whose boxes are no further apart than eps, by recursion over pairs of coarser intervals."""
    corner = lambda f, c: F.array(*[f(F.get(c, F.lit(d))) for d in range(LEADING)]).alias(c)
    levels = [boxes.select(F.col("interval").alias("node"), F.col("range").alias("up"), "l0", "l1", "lo", "hi")]
    width = 1
    while True:
        up = F.floor(F.col("range") / (width * FAN)).cast("bigint")
        levels.append(boxes.groupBy(F.floor(F.col("range") / width).cast("bigint").alias("node")).agg(F.min(up).alias("up"), F.min("l0").alias("l0"), F.max("l1").alias("l1"), corner(F.min, "lo"), corner(F.max, "hi")))
        if ranges <= width:
            break
        width *= FAN
    top = levels.pop().select("node")
    pairs = top.select(F.col("node").alias("x"), F.col("node").alias("y"))
    for level in reversed(levels):
        a, b = (level.select(*[F.col(c).alias(f"{side}{c}") for c in level.columns]) for side in "ab")
        met = pairs.join(a, F.col("x") == F.col("aup")).join(b, F.col("y") == F.col("bup"))
        met = met.where((F.col("anode") == F.col("bnode")) | (F.col("anode") < F.col("bnode")) & (F.col("al1") >= F.col("bl0")) & (F.col("bl1") >= F.col("al0")) & (_gap("a", "b") <= limit))
        pairs = met.select(F.col("anode").alias("x"), F.col("bnode").alias("y"))
    return pairs


def links(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per vector: ``n_links``, ``component_id`` and ``kept``."""
    eps = math.sqrt(2 - 2 * cosine)
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"), F.col(label).alias("l"))
    sound = F.expr("id IS NOT NULL AND l IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = written(rows.where("sound").groupBy("l", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    # A bounded sample: at most SAMPLE vectors reach the driver, to choose directions.
    sample = [r.v for r in classes.orderBy(F.xxhash64("rep")).select("v").limit(SAMPLE).collect()]
    bases = {}
    for size in {len(v) for v in sample}:
        same = unit([v for v in sample if len(v) == size])
        bases[size] = principal(same, min(LEADING, size, len(same)))

    def lead(x: np.ndarray) -> np.ndarray:
        # Lengths that the sample lacks are ordered and pruned by their first components.
        basis = bases.get(x.shape[1])
        found = x[:, :LEADING] if basis is None else x @ basis
        return np.pad(found, ((0, 0), (0, LEADING - found.shape[1])))

    def project(batches):
        for batch in batches:
            column = batch.column(1)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            found = np.zeros((batch.num_rows, LEADING))
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                found[at] = lead(unit(_matrix(column, at, size)))
            offsets = pa.array(np.arange(batch.num_rows + 1) * LEADING, pa.int32())
            flat = lambda x, t: pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), t))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), flat(found, pa.float64()), flat(np.floor(found / eps).astype(np.int32), pa.int32())], names=[*batch.schema.names, "size", "lead", "cell"])

    def cut(batches):
        """Numbers the intervals of a sorted range; labels and lengths don't mix in one."""
        number, rows_in, before = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            kinds = list(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()))
            out = np.zeros(batch.num_rows, np.int64)
            for i, kind in enumerate(kinds):
                if before is not None and (kind != before or rows_in >= BLOCK or rows_in * kind[1] >= COMPONENTS):
                    number, rows_in = number + 1, 0
                before, rows_in = kind, rows_in + 1
                out[i] = number
            keep = [batch.column(batch.schema.names.index(c)) for c in ("l", "v", "rep", "n", "lead")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out)], names=["l", "v", "rep", "n", "lead", "interval"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    led = classes.select("l", "v", "rep", "n").mapInArrow(project, f"{ddl}, size int, lead array<double>, cell array<int>")
    ranges = parts_for(classes, RANGE_MB, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["l", "size", "cell", "rep"]
    placed = written(led.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(cut, f"{ddl}, lead array<double>, interval bigint"))
    side = lambda f, c: F.array(*[f(F.get("lead", F.lit(d))) for d in range(LEADING)]).alias(c)
    boxes = written(placed.groupBy("interval").agg(F.first("l").alias("l0"), F.first("l").alias("l1"), F.max(F.size("v")).alias("size"), side(F.min, "lo"), side(F.max, "hi")).withColumn("range", F.shiftright("interval", 32)))
    near = _near_intervals(boxes, ranges, _limit(eps))
    own = boxes.select(F.col("interval").alias("x"), F.col("size").alias("xs"), "lo", "hi")
    near = near.join(own, "x").join(boxes.select(F.col("interval").alias("y"), F.col("size").alias("ys")), "y").where("xs = ys")
    # An interval meets those later ones in a task that are of the same ``GUESTS`` in a row.
    near = written(near.select("x", "y", F.floor(F.col("y") / GUESTS).cast("bigint").alias("g"), "lo", "hi"))
    cast = placed.select(F.col("interval").alias("i"), "v", "rep", "n", "lead")
    home = near.groupBy("x", "g").agg(F.max(F.col("x") == F.col("y")).alias("own")).join(cast, F.col("x") == F.col("i")).select("x", "g", "own", F.lit(True).alias("home"), "v", "rep", "n", "lead")
    point = F.expr(f"aggregate(zip_with(zip_with(lead, hi, (p, q) -> greatest(0D, p - q)), zip_with(lo, lead, (p, q) -> greatest(0D, p - q)), (p, q) -> greatest(p, q)), 0D, (s, p) -> s + p * p) <= {_limit(eps)!r}D")
    guests = near.where("x <> y").join(cast, F.col("y") == F.col("i")).where(point).select("x", "g", F.lit(False).alias("own"), F.lit(False).alias("home"), "v", "rep", "n", "lead")

    def compare(task: pa.Table) -> pa.Table:
        task = task.combine_chunks().sort_by([("home", "descending"), ("rep", "ascending")])
        at_home = task.column("home").to_numpy()
        home = int(at_home.sum())
        column = task.column("v").combine_chunks()
        size = len(column[0])
        x = unit(_matrix(column, np.arange(len(column)), size))
        lead = task.column("lead").combine_chunks().flatten().to_numpy().reshape(-1, LEADING)
        blocks = GridOrderJoin(x, lead, home, cosine, eps).pairs(bool(task.column("own")[0].as_py()))
        rep, n = task.column("rep").to_numpy(), task.column("n").to_numpy()
        linked, sets = np.zeros(len(rep), np.int64), UnionFind()
        for p, q in blocks:
            linked += np.bincount(p, n[q], len(rep)).astype(np.int64) + np.bincount(q, n[p], len(rep)).astype(np.int64)
            sets.join_all(rep[p], rep[q])
        some = np.flatnonzero(linked)
        return pa.table({"rep": rep[some], "linked": linked[some], "root": pa.array([sets.find(a) for a in rep[some].tolist()], pa.int64())})

    found = written(home.unionAll(guests).groupBy("x", "g").applyInArrow(compare, "rep bigint, linked bigint, root bigint"))
    joined = components(found.where("rep <> root").select("rep", "root"), stars=True)
    counted = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    classes = classes.join(counted, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.select("l", "v", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.where("sound").select("id", "l", "v").join(classes, ["l", "v"]).select("id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionAll(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))

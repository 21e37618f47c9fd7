"""Geometries as well-known text: predicates, grid joins, filters, partitioning and pictures.

A grid join gives each geometry the cells its bounding box touches and joins on cells; a pair is kept only in the cell
that holds the lower left corner of its boxes' intersection, so that no second exchange has to drop repeats. Boxes are compared by Spark, what
is left by an Arrow-batched predicate. Where both geometries have a time, it has to satisfy the predicate too; where one
has and the other hasn't, nothing matches.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from dataclasses import replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from ..plans import tree as t
from ..types import GEOMETRY, INT, Field, Schema, ScriptError
from .expressions import Functions, Lower, Relation, RowScope
from .relational import _joined, positional, settled

_NUMBERS = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


class Shape:
    """Rings or paths of points; ``area``: whether the first ring holds an area and the others are its holes."""

    __slots__ = ("kind", "parts")

    def __init__(self, kind: str, parts: list[list[tuple[float, float]]]):
        self.kind, self.parts = kind, parts

    @property
    def area(self) -> bool:
        return self.kind == "POLYGON"

    def points(self):
        return [p for part in self.parts for p in part]

    def box(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*self.points())
        return min(xs), min(ys), max(xs), max(ys)

    def segments(self):
        return [(a, b) for part in self.parts for a, b in zip(part, part[1:])]


@lru_cache(20_000)
def parse(wkt: str) -> Shape:
    m = re.fullmatch(r"\s*(POINT|LINESTRING|POLYGON)\s*\((.*)\)\s*", wkt, re.I | re.S)
    if not m:
        raise ScriptError(f"not a POINT, LINESTRING or POLYGON: {wkt[:60]!r}")
    kind = m[1].upper()
    rings = re.findall(r"\(([^()]*)\)", m[2]) if kind == "POLYGON" else [m[2]]
    parts = []
    for ring in rings:
        flat = [list(map(float, _NUMBERS.findall(p))) for p in ring.split(",")]
        if not flat or any(len(p) < 2 for p in flat):
            raise ScriptError(f"not a geometry: {wkt[:60]!r}")
        parts.append([(p[0], p[1]) for p in flat])
    if not parts:
        raise ScriptError(f"not a geometry: {wkt[:60]!r}")
    return Shape(kind, parts)


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on(p, a, b) -> bool:
    return _turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _cross(a, b, c, d, proper: bool = False) -> bool:
    s = [_turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)]
    if (s[0] > 0) != (s[1] > 0) and (s[2] > 0) != (s[3] > 0) and all(s):
        return True
    return not proper and (_on(c, a, b) or _on(d, a, b) or _on(a, c, d) or _on(b, c, d))


def _in_ring(p, ring) -> int:
    """1 inside, 0 on the ring, -1 outside."""
    inside = False
    for a, b in zip(ring, ring[1:]):
        if _on(p, a, b):
            return 0
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
            inside = not inside
    return 1 if inside else -1


def _covers_point(s: Shape, p) -> bool:
    if s.kind == "POINT":
        return s.parts[0][0] == p
    if s.kind == "LINESTRING":
        return any(_on(p, a, b) for a, b in s.segments())
    return _in_ring(p, s.parts[0]) >= 0 and all(_in_ring(p, hole) <= 0 for hole in s.parts[1:])


def intersects(a: Shape, b: Shape) -> bool:
    return any(_covers_point(b, p) for p in a.points()) or any(_covers_point(a, p) for p in b.points()) or any(_cross(*x, *y) for x in a.segments() for y in b.segments())


def contains(a: Shape, b: Shape) -> bool:
    """Whether no point of b lies outside a."""
    if not all(_covers_point(a, p) for p in b.points()):
        return False
    if not a.area:
        middle = [((p[0] + q[0]) / 2, (p[1] + q[1]) / 2) for p, q in b.segments()]
        return not b.area and all(_covers_point(a, p) for p in middle)
    for p, q in b.segments():  # between crossings of a's rings a segment is all in or all out
        cuts = {0.0, 1.0}
        for c, d in a.segments():
            den = (q[0] - p[0]) * (d[1] - c[1]) - (q[1] - p[1]) * (d[0] - c[0])
            if den:
                cuts.add(((c[0] - p[0]) * (d[1] - c[1]) - (c[1] - p[1]) * (d[0] - c[0])) / den)
            else:
                for e in (c, d):
                    if _turn(p, q, e) == 0 and p != q:
                        cuts.add(((e[0] - p[0]) * (q[0] - p[0]) + (e[1] - p[1]) * (q[1] - p[1])) / ((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2))
        at = sorted(x for x in cuts if 0 <= x <= 1)
        for u, v in zip(at, at[1:]):
            w = (u + v) / 2
            m = (p[0] + w * (q[0] - p[0]), p[1] + w * (q[1] - p[1]))
            if not _covers_point(a, m) and v - u > 1e-12:
                return False
    # A hole of a inside b takes something from it.
    return not b.area or not any(all(_in_ring(p, b.parts[0]) > 0 or _in_ring(p, b.parts[0]) == 0 for p in hole) and not any(all(_in_ring(p, h) >= 0 for p in hole) for h in b.parts[1:]) for hole in a.parts[1:])


def _apart(a: Shape, b: Shape) -> float:
    if intersects(a, b):
        return 0.0

    def to_segment(p, s):
        (x1, y1), (x2, y2) = s
        n = (x2 - x1) ** 2 + (y2 - y1) ** 2
        u = 0 if n == 0 else max(0, min(1, ((p[0] - x1) * (x2 - x1) + (p[1] - y1) * (y2 - y1)) / n))
        return math.hypot(p[0] - x1 - u * (x2 - x1), p[1] - y1 - u * (y2 - y1))

    sides = [s.segments() or [(s.points()[0],) * 2] for s in (a, b)]
    return min(min(to_segment(p, s) for p in x.points() for s in sides[1 - i]) for i, x in enumerate((a, b)))


_TEST = {"intersects": intersects, "contains": contains, "containedby": lambda a, b: contains(b, a)}


def _tested(name: str):
    test = _TEST[name]

    @F.pandas_udf(BooleanType())
    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and test(parse(x), parse(y)) for x, y in zip(a, b)], dtype="boolean")

    return check


@F.pandas_udf(DoubleType())
def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _apart(parse(x), parse(y)) for x, y in zip(a, b)], dtype="float64")


_N = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_POINT = rf"^\s*[Pp][Oo][Ii][Nn][Tt]\s*\(\s*({_N})\s+({_N})[^()]*\)\s*$"


def point(wkt: Column, k: int) -> Column:
    """Coordinate k (1 or 2) of a point, null for other shapes."""
    got = F.regexp_extract(wkt, _POINT, k)
    return F.when(got != "", got).cast("double")


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two geometries; that of two points stays in Spark's own code."""
    p, q = a.getField("wkt"), b.getField("wkt")
    flat = F.hypot(point(p, 1) - point(q, 1), point(p, 2) - point(q, 2))
    return F.coalesce(flat, _distances(F.when(flat.isNull(), p), F.when(flat.isNull(), q)))


def boxed(df: DataFrame, geometry: Column, prefix: str) -> DataFrame:
    """The frame with the bounding box of a geometry. Numbers are taken from the text by Spark's own functions."""
    numbers = F.transform(F.regexp_extract_all(geometry.getField("wkt"), F.lit(f"({_N})\\s+({_N})"), F.lit(1)), lambda x: x.cast("double"))
    others = F.transform(F.regexp_extract_all(geometry.getField("wkt"), F.lit(f"({_N})\\s+({_N})"), F.lit(2)), lambda x: x.cast("double"))
    df = df.withColumn(f"{prefix}xs", numbers).withColumn(f"{prefix}ys", others)
    return df.select(
        *[c for c in df.columns if c not in (f"{prefix}xs", f"{prefix}ys")],
        F.array_min(f"{prefix}xs").alias(f"{prefix}x0"), F.array_min(f"{prefix}ys").alias(f"{prefix}y0"), F.array_max(f"{prefix}xs").alias(f"{prefix}x1"), F.array_max(f"{prefix}ys").alias(f"{prefix}y1"),
    )


def _times(a: Column, b: Column, name: str) -> Column:
    s, e, u, v = a.getField("t_start"), a.getField("t_end"), b.getField("t_start"), b.getField("t_end")
    inside = {"intersects": (s <= v) & (u <= e), "contains": (s <= u) & (v <= e), "containedby": (u <= s) & (e <= v)}[name]
    return F.when(s.isNull() & u.isNull(), True).when(s.isNull() | u.isNull(), False).otherwise(inside)


def _boxes(name: str, a: str, b: str) -> Column:
    c = F.col
    if name == "contains":
        return (c(f"{a}x0") <= c(f"{b}x0")) & (c(f"{a}y0") <= c(f"{b}y0")) & (c(f"{a}x1") >= c(f"{b}x1")) & (c(f"{a}y1") >= c(f"{b}y1"))
    if name == "containedby":
        return _boxes("contains", b, a)
    return (c(f"{a}x0") <= c(f"{b}x1")) & (c(f"{b}x0") <= c(f"{a}x1")) & (c(f"{a}y0") <= c(f"{b}y1")) & (c(f"{b}y0") <= c(f"{a}y1"))


def _geometry(r: Relation, ref: t.Expr, functions: Functions) -> Column:
    x = Lower(RowScope.of(r), functions).expr(ref)
    if x.type != GEOMETRY:
        raise ScriptError(f"a geometry is needed, not {x.type}")
    return x.col


def filter_(r: Relation, predicate: str, ref: t.Expr, geometry: t.MakeGeometry, functions: Functions) -> Relation:
    """Rows whose geometry satisfies the predicate with a given one; boxes first."""
    r = settled(r)
    own = _geometry(r, ref, functions)
    other = Lower(RowScope.of(r), functions).expr(geometry).col
    df = boxed(r.df.withColumn("_g", own).withColumn("_h", other), F.col("_g"), "a")
    df = boxed(df, F.col("_h"), "b").where(_boxes(predicate, "a", "b") & _times(F.col("_g"), F.col("_h"), predicate))
    df = df.where(_tested(predicate)(F.col("_g").getField("wkt"), F.col("_h").getField("wkt")))
    return replace(r, df=df.select(*r.df.columns))


#: Rows to a cell of a join's grid, and cells to a side at most in BSP.
CELL_ROWS, SIDES = 1000, 256


def _sizes(df: DataFrame, p: str):
    """The box of all boxes, their number, and their mean width and height: one row."""
    return df.agg(F.min(f"{p}x0"), F.min(f"{p}y0"), F.max(f"{p}x1"), F.max(f"{p}y1"), F.count(f"{p}x0"), F.avg(F.col(f"{p}x1") - F.col(f"{p}x0")), F.avg(F.col(f"{p}y1") - F.col(f"{p}y0"))).first()


def _around(got: list) -> tuple[float, float, float, float]:
    got = [g for g in got if g[0] is not None]
    return (min(g[0] for g in got), min(g[1] for g in got), max(g[2] for g in got), max(g[3] for g in got)) if got else (0.0, 0.0, 1.0, 1.0)


def _extent(frames: list[tuple[DataFrame, str]]) -> tuple[float, float, float, float]:
    """The box of all boxes: one row of four numbers from each input."""
    return _around([_sizes(df, p) for df, p in frames])


def _fineness(got: list, extent) -> int:
    """Cells to a side: about ``CELL_ROWS`` rows of the larger input to a cell, but no cell smaller than an average box, so that
    boxes are not copied to many. Crowded cells are split by the join itself (adaptive skew handling)."""
    rows = max(g[4] for g in got)
    width, height = (max((g[i] or 0.0) for g in got) for i in (5, 6))
    most = min([(extent[2] - extent[0]) / width if width > 0 else 1e9, (extent[3] - extent[1]) / height if height > 0 else 1e9])
    return max(1, min(math.ceil(math.sqrt(rows / CELL_ROWS)), int(most), 1 << 15))


def _cells(df: DataFrame, p: str, extent, n: int) -> DataFrame:
    """A row for each grid cell that a box touches."""
    w, h = (max(extent[2] - extent[0], 1e-9) / n, max(extent[3] - extent[1], 1e-9) / n)
    cx = lambda c: F.floor((F.col(c) - extent[0]) / w).cast("int")
    cy = lambda c: F.floor((F.col(c) - extent[1]) / h).cast("int")
    df = df.withColumn(f"{p}cx", F.explode(F.sequence(cx(f"{p}x0"), cx(f"{p}x1"))))
    return df.withColumn(f"{p}cy", F.explode(F.sequence(cy(f"{p}y0"), cy(f"{p}y1"))))


def options(method: tuple[str, list] | None) -> dict:
    return dict(p for p in method[1] if isinstance(p, tuple)) if method else {}


def unlaid(r: Relation) -> Relation:
    """The rows from before a PARTITION or INDEX: these lay rows out, and a join by cells deals them out anew anyway."""
    while r.laid is not None and r.laid[0] is r.df:
        r = replace(r, df=r.laid[1].df, laid=r.laid[1].laid)
    return r


def _laid(r: Relation, df: DataFrame) -> Relation:
    return replace(r, df=df, laid=(df, r))


def join(rs: list[Relation], aliases: list[str], predicate: str, refs, partition, functions: Functions) -> Relation:
    """Pairs that satisfy the predicate, found in the cells of a grid. An index that a script names is what sorts a stored table by
    place; a join needs none, as cells bring the candidates together."""
    rs = [unlaid(settled(r)) for r in rs]
    frames = []
    for r, ref, m in zip(rs, refs, ("a", "b")):
        g = _geometry(r, ref, functions)
        df = r.df.select(*[F.col(c).alias(f"{m}{c}") for c in r.df.columns], g.alias(f"{m}g"))
        frames.append(boxed(df, F.col(f"{m}g"), m).where(f"{m}x0 IS NOT NULL"))
    got = [_sizes(df, m) for df, m in zip(frames, ("a", "b"))]
    extent = _around(got)
    given = next((options(p).get("partitionsPerDimension") for p in partition if options(p).get("partitionsPerDimension")), None)
    n = int(given) if given else _fineness(got, extent)
    left, right = _cells(frames[0], "a", extent, n), _cells(frames[1], "b", extent, n)
    w, h = (max(extent[2] - extent[0], 1e-9) / n, max(extent[3] - extent[1], 1e-9) / n)
    df = left.join(right, (F.col("acx") == F.col("bcx")) & (F.col("acy") == F.col("bcy")) & _boxes(predicate, "a", "b"))
    first = (F.floor((F.greatest("ax0", "bx0") - extent[0]) / w) == F.col("acx")) & (F.floor((F.greatest("ay0", "by0") - extent[1]) / h) == F.col("acy"))
    df = df.where(first & _times(F.col("ag"), F.col("bg"), predicate))
    df = df.where(_tested(predicate)(F.col("ag").getField("wkt"), F.col("bg").getField("wkt")))
    return _joined(df, rs, aliases, ["a", "b"])


def _given(method: tuple[str, list], *names: str) -> dict:
    """Parameters by name; plain ones take the names in order. Any other is an error."""
    named, free = options(method), list(names)
    plain = [p for p in method[1] if not isinstance(p, tuple)]
    free = [n for n in free if n not in named]
    if len(plain) > len(free) or set(named) - set(names):
        raise ScriptError(f"{method[0].upper()} takes {', '.join(names)}")
    return named | dict(zip(free, plain))


def halves(counts: np.ndarray, most: float) -> np.ndarray:
    """The number of the part that each cell belongs to: the plane is cut in two where the halves come closest, along either axis,
    until a part holds at most ``most`` or is one cell."""
    parts, todo, number = np.zeros(counts.shape, np.int64), [(0, counts.shape[0], 0, counts.shape[1])], 0
    while todo:
        x0, x1, y0, y1 = todo.pop()
        part = counts[x0:x1, y0:y1]
        if part.sum() <= most or part.size == 1:
            parts[x0:x1, y0:y1] = number
            number += 1
            continue
        cuts = []
        for axis, n in ((0, x1 - x0), (1, y1 - y0)):
            if n > 1:
                left = np.cumsum(part.sum(axis=1 - axis))[:-1]
                k = int(np.abs(2 * left - part.sum()).argmin())
                cuts.append((abs(2 * int(left[k]) - int(part.sum())), axis, k + 1))
        _, axis, k = min(cuts)
        todo += [(x0, x0 + k, y0, y1), (x0 + k, x1, y0, y1)] if axis == 0 else [(x0, x1, y0, y0 + k), (x0, x1, y0 + k, y1)]
    return parts


def partition(r: Relation, ref: t.Expr, method: tuple[str, list], functions: Functions) -> Relation:
    """Rows dealt by their boxes' centres. GRID(partitionsPerDimension, withExtent): the cells of a grid over all centres, or with
    withExtent over all boxes. BSP(sideLength, maxCost): cells of ``sideLength`` (at most ``SIDES`` to a side) are counted and the plane
    is cut in two until a part holds at most ``maxCost`` rows or is one cell; one count for each cell reaches the driver."""
    r = settled(r)
    df = boxed(r.df.withColumn("_g", _geometry(r, ref, functions)), F.col("_g"), "a")
    df = df.withColumn("_x", (F.col("ax0") + F.col("ax1")) / 2).withColumn("_y", (F.col("ay0") + F.col("ay1")) / 2)
    if method[0] == "grid":
        given = _given(method, "partitionsPerDimension", "withExtent")
        nx = ny = int(given.get("partitionsPerDimension", 8))
        e = _extent([(df, "a")]) if str(given.get("withExtent", False)).lower() == "true" else _around([df.agg(F.min("_x"), F.min("_y"), F.max("_x"), F.max("_y")).first()])
    else:
        given = _given(method, "sideLength", "maxCost")
        e = _around([df.agg(F.min("_x"), F.min("_y"), F.max("_x"), F.max("_y")).first()])
        side = float(given["sideLength"]) if "sideLength" in given else max(e[2] - e[0], e[3] - e[1], 1e-9) / SIDES
        nx, ny = (max(1, min(SIDES, math.ceil((e[i + 2] - e[i]) / side))) for i in (0, 1))
    place = lambda c, i, n: F.coalesce(F.least(F.floor((F.col(c) - e[i]) / (max(e[i + 2] - e[i], 1e-9) / n)), F.lit(n - 1)), F.lit(0)).cast("int")
    df = df.withColumn("_cx", place("_x", 0, nx)).withColumn("_cy", place("_y", 1, ny))
    if method[0] == "grid":
        return _laid(r, df.repartition(nx * ny, F.col("_cx") * ny + F.col("_cy")).select(*r.df.columns))
    counts = np.zeros((nx, ny), np.int64)
    for x in df.groupBy("_cx", "_cy").count().collect():
        counts[x["_cx"], x["_cy"]] = x["count"]
    parts = halves(counts, float(given.get("maxCost", max(1, counts.sum() // 64))))
    table = df.sparkSession.createDataFrame([(i, j, int(parts[i, j])) for i, j in zip(*map(lambda a: a.tolist(), np.nonzero(counts)))] or [(0, 0, 0)], "_cx int, _cy int, _part bigint")
    df = df.join(F.broadcast(table), ["_cx", "_cy"])  # at most SIDES * SIDES rows
    return _laid(r, df.repartition(int(parts.max()) + 1, "_part").select(*r.df.columns))


def index(r: Relation, ref: t.Expr, functions: Functions) -> Relation:
    """Rows sorted by place within ranges of place, which later scans of a stored table can skip by."""
    r = settled(r)
    df = boxed(r.df.withColumn("_g", _geometry(r, ref, functions)), F.col("_g"), "a")
    return _laid(r, df.repartitionByRange(F.col("ax0"), F.col("ay0")).sortWithinPartitions("ax0", "ay0").select(*r.df.columns))


def picture(r: Relation, ref: t.Expr, width: int, height: int, functions: Functions, size: int = 1) -> bytes:
    """A PNG of the geometries' first corners. Spark counts by pixel: the driver gets one number a pixel at most."""
    r = settled(r)
    df = boxed(r.df.withColumn("_g", _geometry(r, ref, functions)), F.col("_g"), "a")
    e = _extent([(df, "a")])
    x = F.least(F.floor((F.col("ax0") - e[0]) / max(e[2] - e[0], 1e-9) * width), F.lit(width - 1)).cast("int").alias("x")
    y = F.least(F.floor((F.col("ay0") - e[1]) / max(e[3] - e[1], 1e-9) * height), F.lit(height - 1)).cast("int").alias("y")
    image = np.full((height, width), 255, np.uint8)
    for p in df.where("ax0 IS NOT NULL").groupBy(x, y).count().collect():
        shade = max(0, 160 - 20 * int(math.log2(p["count"])))
        top = height - 1 - p.y
        image[max(0, top - size + 1) : top + 1, p.x : p.x + size] = shade
    return png(image)


def png(image: np.ndarray) -> bytes:
    """A grey image as a PNG file."""
    height, width = image.shape
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    raw = b"".join(b"\0" + image[i].tobytes() for i in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


__all__ = ["INT", "Field", "Schema", "positional"]

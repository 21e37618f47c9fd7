"""Geometries: predicates by hand and against brute force, joins, partitions, distances and pictures."""

import random
import zlib

import pytest

from weftline.operators import spatial
from weftline.session import Session
from weftline.types import ScriptError

P = spatial.parse
SQUARE, HOLED = P("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"), P("POLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))")


def test_predicates():
    assert spatial.contains(SQUARE, P("POINT(1 1)")) and spatial.contains(SQUARE, P("POINT(4 2)")) and not spatial.contains(SQUARE, P("POINT(5 1)"))
    assert spatial.contains(P("POINT(1 1)"), P("POINT(1 1)")) and not spatial.contains(P("POINT(1 1)"), P("POINT(1 2)"))
    assert not spatial.contains(HOLED, P("POINT(4 4)")) and spatial.contains(HOLED, P("POINT(1 1)")) and not spatial.contains(HOLED, P("LINESTRING(1 1, 8 8)"))
    assert spatial.contains(P("LINESTRING(0 0, 4 4)"), P("LINESTRING(1 1, 2 2)")) and not spatial.contains(HOLED, P("POLYGON((2 2, 7 2, 7 7, 2 7, 2 2))"))
    assert spatial.intersects(P("LINESTRING(-1 2, 9 2)"), SQUARE) and not spatial.intersects(P("LINESTRING(-1 5, 9 5)"), SQUARE) and spatial.intersects(P("LINESTRING(0 0, 2 2)"), P("LINESTRING(0 2, 2 0)"))
    with pytest.raises(ScriptError):
        P("CIRCLE(1 1)")


def test_join_is_like_all_pairs(spark):
    r = random.Random(6)
    box = lambda: (r.uniform(0, 90), r.uniform(0, 90), r.uniform(1, 30), r.uniform(1, 30))
    text = lambda x, y, w, h: f"POLYGON(({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y}))"
    a, b = [(i, text(*box())) for i in range(60)], [(i, text(*box())) for i in range(60)]
    s = Session(spark, out=lambda *_: None)
    s.bind("a0", spark.createDataFrame(a, "i int, g string"))
    s.bind("b0", spark.createDataFrame(b, "k int, h string"))
    s.run("a = FOREACH a0 GENERATE i, geometry(g) AS g; b = FOREACH b0 GENERATE k, geometry(h) AS h;")
    for name, test in (("intersects", spatial.intersects), ("contains", spatial.contains), ("containedBy", lambda x, y: spatial.contains(y, x))):
        s.run(f"j_{name} = SPATIAL_JOIN a PARTITION BY GRID(partitionsPerDimension=5), b ON {name}(g, h); p_{name} = FOREACH j_{name} GENERATE i, k;")
        assert sorted(map(tuple, s.df(f"p_{name}").collect())) == [(i, k) for i, x in a for k, y in b if test(P(x), P(y))]


def test_filter_time_and_nulls(spark):
    s = Session(spark, out=lambda *_: None)
    s.bind("t", spark.createDataFrame([(1, "POINT(1 1)", 5.0), (2, "POINT(9 9)", 5.0), (3, None, 5.0)], "i int, g string, at double"))
    s.run("""a = FOREACH t GENERATE i, geometry(g) AS g; b = SPATIAL_FILTER a BY containedBy(g, geometry("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))")) USING INDEX RTREE(order=5);
    c = FOREACH t GENERATE i, geometry(g, at) AS g; d = SPATIAL_FILTER c BY intersects(g, geometry("POINT(1 1)", 4, 6)); e = SPATIAL_FILTER c BY intersects(g, geometry("POINT(1 1)", 6, 7)); f = SPATIAL_FILTER c BY intersects(g, geometry("POINT(1 1)"));
    h = FOREACH a GENERATE i, S_DISTANCE(g, geometry("LINESTRING(0 2, 9 2)")) AS x;""")
    ids = lambda n: [r.i for r in s.df(n).select("i").collect()]
    assert ids("b") == ids("d") == [1] and ids("e") == ids("f") == [] and {r.i: r.x for r in s.df("h").collect()} == {1: 1.0, 2: 7.0, 3: None}


def test_partitions_and_index(spark):
    s = Session(spark, out=lambda *_: None)
    s.bind("t", spark.createDataFrame([(i, f"POINT({i % 7} {i % 5})") for i in range(100)], "i int, g string"))
    s.run("a = FOREACH t GENERATE i, geometry(g) AS g; b = PARTITION a ON g USING GRID(partitionsPerDimension=3); c = PARTITION a ON g USING BSP(maxCost=9); d = INDEX a ON g USING RTREE(order=5);")
    assert s.df("b").rdd.getNumPartitions() == 9 and s.df("b").count() == s.df("c").count() == s.df("d").count() == 100


def test_picture(spark, tmp_path):
    s = Session(spark, out=lambda *_: None)
    s.bind("t", spark.createDataFrame([("POINT(0 0)",), ("POINT(3 3)",), (None,)], "g string"))
    s.run(f"a = FOREACH t GENERATE geometry(g) AS g; VISUALIZE a BY g INTO '{tmp_path}/p.png' AS (4, 4);")
    data = (tmp_path / "p.png").read_bytes()
    raw = zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8])
    assert data.startswith(b"\x89PNG") and [i for i, v in enumerate(raw) if i % 5 and v < 255] == [4, 16]


def test_plane_cut_in_halves():
    import numpy as np

    counts = np.zeros((8, 8), np.int64)
    counts[0, 0], counts[7, 7], counts[3, 2:6] = 100, 20, 10
    parts = spatial.halves(counts, 25)
    sizes = {int(p): int(counts[parts == p].sum()) for p in np.unique(parts)}
    assert sum(sizes.values()) == counts.sum() and all(n <= 25 or (parts == p).sum() == 1 for p, n in sizes.items())


def test_partition_parameters(spark):
    s = Session(spark, out=lambda *_: None)
    s.bind("t", spark.createDataFrame([(i, f"POINT({i % 10} {i // 10})") for i in range(100)], "i int, g string"))
    s.run("a = FOREACH t GENERATE i, geometry(g) AS g; b = PARTITION a ON g USING BSP(sideLength=1, maxCost=10); c = PARTITION a ON g USING GRID(2, withExtent=true);")
    assert s.df("b").rdd.getNumPartitions() >= 10 and s.df("b").count() == 100 and s.df("c").rdd.getNumPartitions() == 4
    with pytest.raises(ScriptError, match="takes"):
        s.run("d = PARTITION a ON g USING BSP(nothing=3);")


def test_a_join_takes_rows_from_before_their_layout(spark):
    """PARTITION and INDEX deal rows out by place; a join by cells does so itself and needs neither exchange."""
    from weftline.session import Session

    s = Session(spark, out=lambda *_: None)
    s.bind("e", spark.range(2000).selectExpr("id", "id % 50 AS x", "id % 40 AS y"))
    s.run("""p = FOREACH e GENERATE id, geometry("POINT(" + x + " " + y + ")") AS g; f = FILTER e BY id == 7; c = FOREACH f GENERATE id AS n, geometry("POLYGON((0 0, 9 0, 9 9, 0 9, 0 0))") AS h;
    q = PARTITION p ON g USING BSP(sideLength=2, maxCost=5); i = INDEX q ON g USING RTREE(order=5); j = SPATIAL_JOIN i, c ON containedBy(g, h); k = FILTER i BY id > 1000; m = SPATIAL_JOIN k, c ON containedBy(g, h);""")
    inside = [n for n in range(2000) if n % 50 <= 9 and n % 40 <= 9]
    assert sorted(r[0] for r in s.df("j").collect()) == inside
    assert sorted(r[0] for r in s.df("m").collect()) == [n for n in inside if n > 1000]
    assert "Repartition" not in s.df("j")._jdf.queryExecution().optimizedPlan().toString()

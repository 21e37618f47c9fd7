"""Streams from files: stateless steps, running aggregates, windows, whole micro-batches, and tables taken as streams."""

import socket
import threading

import pytest

from weftline.session import Session
from weftline.types import ScriptError


@pytest.fixture
def stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def session(*files):
        import os

        for i, text in enumerate(files):
            (folder / f"{i}").write_text(text)
            os.utime(folder / f"{i}", (1_700_000_000 + i, 1_700_000_000 + i))
        return Session(spark, {"d": str(folder), "o": str(tmp_path / "out")}, out=lambda *_: None)

    session.lines = lambda: sorted(x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().split("\n") if x)
    return session


def test_stateless(stream):
    s = stream("1,a\n2,b\n", "3,c\n")
    s.run("e = LOAD '$d' USING PigStream(',') AS (n: int, k: chararray); f = FILTER e BY n > 1; g = FOREACH f GENERATE k, n * 2; STORE g INTO '$o';")
    assert stream.lines() == ["b,4", "c,6"]


def test_running_aggregates(stream):
    s = stream("1,1\n1,2\n", "2,5\n1,4\n")
    s.run("e = LOAD '$d' USING PigStream(',') AS (k: int, n: int); g = GROUP e BY k; r = FOREACH g GENERATE group, COUNT(e), SUM(e.n), AVG(e.n); STORE r INTO '$o';")
    assert stream.lines() == ["1,1,1,1.0", "1,2,3,1.5", "1,3,7,2.3333333333333335", "2,1,5,5.0"]


def test_running_accumulate(stream):
    s = stream("4\n1\n", "9\n")
    s.run("e = LOAD '$d' USING PigStream() AS (n: int); a = ACCUMULATE e GENERATE MIN(n), MAX(n), SUM(n), COUNT(n); STORE a INTO '$o';")
    assert stream.lines() == ["1,4,5,2", "1,9,14,3", "4,4,4,1"]


def test_micro_batches(stream):
    s = stream("b\na\nb\n", "c\na\n")
    s.run("e = LOAD '$d' USING TextStream() AS (k: chararray); d = DISTINCT e; o = ORDER d BY k DESC; STORE o INTO '$o';")
    assert stream.lines() == ["a", "a", "b", "c"]


def test_windows_with_watermark(stream):
    s = stream("1,10\n2,20\n1,50\n", "1,70\n", "3,500\n", "3,501\n")
    s.run("e = LOAD '$d' USING PigStream(',') AS (k: int, ts: long) TIMESTAMP(ts); w = WINDOW e RANGE 60 SECONDS; g = GROUP w BY k; c = FOREACH g GENERATE group, COUNT(w); STORE c INTO '$o';")
    assert stream.lines() == ["1,1", "1,2", "2,1"]


def test_tables_as_streams(stream):
    s = stream("1\n3\n2\n")
    s.run("e = LOAD '$d' USING Replay('PigStorage') AS (n: int) TIMESTAMP(n); a = ACCUMULATE e GENERATE SUM(n) AS s, MAX(n) AS m;")
    assert sorted(map(tuple, s.df("a").collect())) == [(1, 1), (3, 2), (6, 3)]


def test_window_kinds(spark):
    s = Session(spark, out=lambda *_: None)
    s.bind("e", spark.createDataFrame([(i, i * 10) for i in range(10)], "n int, ts long"), timestamp="ts")
    s.run("""a = WINDOW e RANGE 40 SECONDS SLIDE ROWS 5; ga = GROUP a ALL; ca = FOREACH ga GENERATE MIN(a.n) AS lo, MAX(a.n) AS hi;
    b = WINDOW e ROWS 3 SLIDE RANGE 50 SECONDS; gb = GROUP b ALL; cb = FOREACH gb GENERATE MIN(b.n) AS lo, MAX(b.n) AS hi;
    c = WINDOW e ROWS 4; gc = GROUP c ALL; cc = FOREACH gc GENERATE MIN(c.n) AS lo, MAX(c.n) AS hi; x = WINDOW e RANGE 50 SECONDS; y = WINDOW e RANGE 50 SECONDS; z = CROSS x, y; j = JOIN x BY n, y BY n;""")
    got = {k: sorted(map(tuple, s.df(k).collect())) for k in ("ca", "cb", "cc")}
    assert got == {"ca": [(1, 4), (6, 9)], "cb": [(2, 4), (7, 9)], "cc": [(0, 3), (4, 7), (8, 9)]}
    assert s.df("z").count() == 50 and s.df("j").count() == 10
    with pytest.raises(ScriptError, match="windows"):
        s.run("q = JOIN x BY n, e BY n;")


def test_sockets(spark):
    server = socket.create_server(("127.0.0.1", 0))
    got = []

    def take():
        c, _ = server.accept()
        with c, c.makefile() as f:
            got.extend(f.read().split())

    t = threading.Thread(target=take)
    t.start()
    s = Session(spark, out=lambda *_: None)
    s.bind("e", spark.createDataFrame([(1, "a"), (2, "b")], "n int, k string"))
    s.run(f"SOCKET_WRITE e TO '127.0.0.1:{server.getsockname()[1]}' USING PigStorage(',');")
    t.join(30)
    server.close()
    assert sorted(got) == ["1,a", "2,b"]


def test_zeromq_is_named_where_it_is_missing(spark):
    try:
        import zmq  # noqa: F401
    except ImportError:
        with pytest.raises(ScriptError, match="pyzmq"):
            Session(spark).run("e = SOCKET_READ '127.0.0.1:9' MODE ZMQ;")


def test_live_windows_by_count(stream):
    s = stream("1,a\n2,b\n3,a\n", "4,a\n5,b\n", "6,b\n7,a\n")
    s.run("e = LOAD '$d' USING PigStream(',') AS (n: int, k: chararray); w = WINDOW e ROWS 3 SLIDE ROWS 2; g = GROUP w ALL; c = FOREACH g GENERATE COUNT(w), MIN(w.n), MAX(w.n); STORE c INTO '$o';")
    assert stream.lines() == ["3,1,3", "3,3,5", "3,5,7"]


def test_live_windows_by_count_and_key(stream):
    s = stream("1,a\n2,b\n3,a\n", "4,b\n")
    s.run("e = LOAD '$d' USING PigStream(',') AS (n: int, k: chararray); w = WINDOW e ROWS 2; g = GROUP w BY k; c = FOREACH g GENERATE group, SUM(w.n); STORE c INTO '$o';")
    assert stream.lines() == ["a,1", "a,3", "b,2", "b,4"]


def test_live_mixed_windows(stream):
    s = stream("1,0\n2,10\n3,20\n", "4,35\n5,90\n", "6,95\n")
    s.run("e = LOAD '$d' USING PigStream(',') AS (n: int, ts: long) TIMESTAMP(ts); w = WINDOW e RANGE 30 SECONDS SLIDE ROWS 2; g = GROUP w ALL; c = FOREACH g GENERATE COUNT(w), MIN(w.n), MAX(w.n); STORE c INTO '$o';")
    assert stream.lines() == ["2,1,2", "2,5,6", "3,2,4"]


def test_live_windows_by_the_clock(stream):
    s = stream("1,0\n2,10\n3,20\n", "4,35\n5,90\n", "6,95\n")
    s.run("e = LOAD '$d' USING PigStream(',') AS (n: int, ts: long) TIMESTAMP(ts); w = WINDOW e ROWS 2 SLIDE RANGE 30 SECONDS; g = GROUP w ALL; c = FOREACH g GENERATE COUNT(w), MIN(w.n), MAX(w.n); STORE c INTO '$o';")
    assert stream.lines() == ["2,2,3", "2,3,4"]


def test_a_stored_order_is_the_order_of_a_stream(spark, tmp_path):
    """Modification times follow the rows, whichever task ends last."""

    def slow(batches):
        import time

        for b in batches:
            time.sleep(1.5 - 0.5 * b.column("n")[0].as_py() / 10)
            yield b

    s = Session(spark, {"o": str(tmp_path / "out")}, out=lambda *_: None)
    s.bind("e", spark.range(0, 40, 1, 4).selectExpr("id AS n").mapInArrow(slow, "n long"))
    s.run("STORE e INTO '$o';")
    files = sorted((tmp_path / "out").glob("part-*"), key=lambda p: p.stat().st_mtime_ns)
    assert [p.read_text().split("\n")[0] for p in files] == ["0", "10", "20", "30"]


def test_windows_over_a_stored_bag_lose_no_row(spark, tmp_path):
    """Its files come in no order of time: rows of the first times, in the last file, aren't late."""
    import os

    s = Session(spark, {"d": str(tmp_path / "in"), "o": str(tmp_path / "out")}, out=lambda *_: None)
    s.bind("a", spark.range(0, 400, 1, 4).selectExpr("400 - id AS ts", "'k' AS k"))
    s.run("STORE a INTO '$d';")
    now = max(p.stat().st_mtime for p in (tmp_path / "in").glob("part-*"))
    for i in (1, 2):
        (tmp_path / "in" / f"zz{i}").write_text(f"{100_000 + i},end\n")
        os.utime(tmp_path / "in" / f"zz{i}", (now + i, now + i))
    s.run("e = LOAD '$d' USING PigStream(',') AS (ts: long, k: chararray) TIMESTAMP(ts); w = WINDOW e RANGE 60 SECONDS; g = GROUP w BY k; c = FOREACH g GENERATE group, COUNT(w); STORE c INTO '$o';")
    lines = [x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().split("\n") if x]
    assert sum(int(x.split(",")[1]) for x in lines if x.startswith("k,")) == 400


def test_running_aggregates_over_batches_are_no_python(stream):
    """Each batch is summed by Spark, with the sums of those before."""
    s = stream("1,5\n,1\n", "1,0\n,2\n", "1,7\n2,3\n")
    s.run("e = LOAD '$d' USING PigStream(',') AS (k: chararray, n: int); g = GROUP e BY k; r = FOREACH g GENERATE group, COUNT(e), SUM(e.n), MIN(e.n); f = FILTER r BY $1 > 1; STORE f INTO '$o';")
    assert stream.lines() == [",2,3,1", "1,2,5,0", "1,3,12,0"]
    assert "ApplyInPandasWithState" not in s.relation("r").df._jdf.queryExecution().logical().toString()
    with pytest.raises(ScriptError, match="micro-batch"):
        s.df("r")


def test_live_windows_by_count_are_no_single_task(stream):
    """Windows over several batches, and one that none fills, from positions."""
    s = stream("1\n2\n", "3\n", "4\n5\n6\n7\n")
    s.run("e = LOAD '$d' USING PigStream(',') AS (n: int); w = WINDOW e ROWS 4 SLIDE ROWS 1; g = GROUP w ALL; c = FOREACH g GENERATE COUNT(w), MIN(w.n), MAX(w.n); STORE c INTO '$o';")
    assert stream.lines() == ["4,1,4", "4,2,5", "4,3,6", "4,4,7"]
    assert "InPandasWithState" not in s.relation("w").df._jdf.queryExecution().logical().toString()

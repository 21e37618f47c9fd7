"""Queries that take more than one script: what is stored and loaded again, live streams, kept results, embedded code, outputs.

Each gets a fresh scratch path in the shared folder, ``$t``. A step is a script, or a function of the session and the path."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .session import Session
from .shared import scratch

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
Step = str | Callable[[Session, str], object]
STEPS: dict[str, tuple[list[Step], str, dict]] = {}


def _add(name: str, *steps: Step, sql: str, **options) -> None:
    STEPS[name] = (list(steps), sql, options)


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    steps, _, options = STEPS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = scratch(spark)
        more = {k: f"{t}/{v}" if k == "store" else v for k, v in options.items()}
        s = Session(spark, {"d": sf_dir, "t": t}, out=lambda *_: None, seed=7, **more)
        import re

        for table in TABLES:
            if any(isinstance(x, str) and re.search(rf"\b{table}\b", x) for x in steps):
                s.run(f"{table} = LOAD '$d/{table}.parquet' USING Parquet()" + (" TIMESTAMP(ts);" if table == "events" else ";"))
        for step in steps:
            if isinstance(step, str):
                s.run(step)
            else:
                step(s, t)
        return s.df("out")

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query(name) for name in STEPS}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql, _) in STEPS.items()}


def _lines(name: str, script: str):
    """What an output of a script gives, as a table with one column, line."""

    def step(s: Session, t: str) -> None:
        got = s.run(script)
        lines = [x for g in got for x in (g if isinstance(g, list) else str(g).split("\n"))]
        s.bind(name, s.spark.createDataFrame([(x,) for x in lines], "line string"))

    return step


_ORDERS = "SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders"
_KEPT = "o = FOREACH orders GENERATE o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p;\n"
_AS = " AS (k: long, s: chararray, p: double);"
_add("storage_text", _KEPT + "STORE o INTO '$t/a' USING PigStorage('|');", r"out = LOAD '$t/a' USING PigStorage('\\|')" + _AS, sql=_ORDERS)
_add(
    "storage_options",
    "n = FOREACH nation GENERATE n_nationkey, n_name; h = FOREACH region GENERATE '# ' + r_name AS c; STORE n INTO '$t/a' USING PigStorage(';'); STORE h INTO '$t/b';",
    "fs -mkdir $t/c;\nfs -getmerge $t/a $t/c/1;\nfs -getmerge $t/b $t/c/2;\n",
    "out = LOAD '$t/c' USING PigStorage(';', comments='#', skipEmpty=true) AS (k: int, n: chararray);",
    sql="SELECT n_nationkey AS k, n_name AS n FROM nation",
)
_add("storage_binary", _KEPT + "STORE o INTO '$t/a' USING BinStorage();", "out = LOAD '$t/a' USING BinStorage();", sql=_ORDERS)
_add("storage_json", _KEPT + "STORE o INTO '$t/a' USING JsonStorage2();", "out = LOAD '$t/a' USING JsonStorage2()" + _AS, sql=_ORDERS)
_add(
    "storage_json_nested",
    "g = GROUP nation BY n_regionkey; a = FOREACH g { o = ORDER nation BY n_nationkey; GENERATE group AS k, o AS members; }; STORE a INTO '$t/a' USING JsonStorage2();",
    "b = LOAD '$t/a' USING JsonStorage2(); out = FOREACH b GENERATE k, COUNT(members) AS n;",
    sql="SELECT CAST(n_regionkey AS BIGINT) AS k, count(*) AS n FROM nation GROUP BY 1",
)
_add("storage_csv", _KEPT + "STORE o INTO '$t/a' USING CSV(',');", "out = LOAD '$t/a' USING CSV(',')" + _AS, sql=_ORDERS)
_add("storage_orc", _KEPT + "STORE o INTO '$t/a' USING ORC();", "out = LOAD '$t/a' USING ORC();", sql=_ORDERS)
_add("text_loader", "n = FOREACH nation GENERATE n_nationkey, n_name, n_regionkey; STORE n INTO '$t/a';", "out = LOAD '$t/a' USING TextLoader();", sql="SELECT n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation")
_add(
    "printed_forms",
    """g = GROUP nation BY n_regionkey; a = FOREACH g { o = ORDER nation BY n_nationkey; p = o.n_nationkey; GENERATE group AS k, p AS b; }; b = FOREACH a GENERATE (k, 'x') AS t, b, TOMAP('k', k) AS m; STORE b INTO '$t/a';""",
    "out = LOAD '$t/a' USING TextLoader();",
    sql="SELECT '(' || n_regionkey || ',x),{' || string_agg('(' || n_nationkey || ')', ',' ORDER BY n_nationkey) || '},[k#' || n_regionkey || ']' AS line FROM nation GROUP BY n_regionkey",
)
_TRIPLES = """a = FOREACH nation GENERATE 'n' + n_nationkey AS s, 'name' AS p, '"' + n_name + '"' AS o; b = FOREACH nation GENERATE 'n' + n_nationkey AS s, 'region' AS p, 'r' + n_regionkey AS o;
    c = FOREACH region GENERATE 'r' + r_regionkey AS s, 'name' AS p, '"' + r_name + '"' AS o; t = UNION a, b, c; STORE t INTO '$t/a' USING RDFFileStorage();"""
_add("rdf_file", _TRIPLES, "out = LOAD '$t/a' USING RDFFileStorage();", sql="""SELECT 'n' || n_nationkey AS subject, 'name' AS predicate, '"' || n_name || '"' AS object FROM nation UNION ALL SELECT 'n' || n_nationkey, 'region', 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'name', '"' || r_name || '"' FROM region""")
_add("rdfload_grouped", _TRIPLES, "g = RDFLOAD('$t/a') GROUPED ON subject; out = FOREACH g GENERATE subject, COUNT(stmts) AS n;", sql="SELECT 'n' || n_nationkey AS subject, CAST(2 AS BIGINT) AS n FROM nation UNION ALL SELECT 'r' || r_regionkey, 1 FROM region")
_add("bgp_over_groups", _TRIPLES, "g = RDFLOAD('$t/a') GROUPED ON subject; out = BGP_FILTER g BY { ?n 'region' ?r . ?r 'name' ?name };", sql="""SELECT 'n' || n_nationkey AS n, '"' || r_name || '"' AS name, 'r' || r_regionkey AS r FROM nation JOIN region ON n_regionkey = r_regionkey""")
_add("bgp_single_over_groups", _TRIPLES, "g = RDFLOAD('$t/a') GROUPED ON subject; h = BGP_FILTER g BY { ?n 'region' 'r2' }; out = FOREACH h GENERATE subject, COUNT(stmts) AS n;", sql="SELECT 'n' || n_nationkey AS subject, CAST(2 AS BIGINT) AS n FROM nation WHERE n_regionkey = 2")
_add(
    "tuplify_repeats",
    "t = FOREACH nation GENERATE 'r' + n_regionkey AS subject, 'holds' AS predicate, n_name AS object; u = TUPLIFY t ON subject; out = FOREACH u GENERATE subject, values#'holds' AS first, COUNT(pairs) AS n;",
    sql="SELECT 'r' || n_regionkey AS subject, min(n_name) AS first, count(*) AS n FROM nation GROUP BY 1",
)
_add("dump", _lines("out", "n = FOREACH nation GENERATE n_nationkey, n_name; DUMP n;"), "x = LIMIT nation 1;", sql="SELECT n_nationkey || ',' || n_name AS line FROM nation")
_add("display", _lines("out", "n = FOREACH nation GENERATE n_nationkey AS k, n_name AS n; DISPLAY n;"), "x = LIMIT nation 1;", sql="SELECT '%table k' || chr(9) || 'n' AS line UNION ALL SELECT n_nationkey || chr(9) || n_name FROM nation")
_add("describe", _lines("out", "g = GROUP region BY r_regionkey; DESCRIBE g;"), "x = LIMIT region 1;", sql="SELECT 'g: {group: int, region: {(r_regionkey: int, r_name: chararray)}}' AS line")
_add(
    "file_commands",
    "n = FOREACH region GENERATE r_name; STORE n INTO '$t/a';",
    "fs -mkdir $t/b;\nfs -getmerge $t/a $t/b/all;\nfs -rm -r $t/a;\n",
    _lines("out", "fs -cat $t/b/all;\n"),
    sql="SELECT r_name AS line FROM region",
)
_add(
    "jdbc",
    lambda s, t: s.params.update(j=f"jdbc:derby:memory:{Path(t).name};create=true"),
    "n = FOREACH nation GENERATE n_nationkey AS K, n_name AS N; STORE n INTO 'NATIONS' USING JdbcStorage('org.apache.derby.iapi.jdbc.AutoloadedDriver', '$j');",
    "out = LOAD 'NATIONS' USING JdbcStorage('org.apache.derby.iapi.jdbc.AutoloadedDriver', '$j') AS (k: int, n: chararray);",
    sql="SELECT n_nationkey AS k, n_name AS n FROM nation",
)
_add("bags_empty_or_not", "c = COGROUP nation BY n_nationkey, supplier BY s_nationkey; a = FILTER c BY ISEMPTY(supplier); b = FILTER c BY NONEMPTY(supplier); x = FOREACH a GENERATE group AS k, 'none' AS w; y = FOREACH b GENERATE group AS k, 'some' AS w; out = UNION x, y;", sql="SELECT n_nationkey AS k, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'some' ELSE 'none' END AS w FROM nation")
_add(
    "join_null_keys",
    "a = FOREACH nation GENERATE n_name, TOMAP('n0', n_nationkey, 'n1', n_regionkey) AS m; b = FOREACH a GENERATE n_name, m#'n0' AS k, m#'none' AS z; c = FOREACH b GENERATE n_name AS c_name, k, z; j = JOIN b BY z, c BY z; i = JOIN b BY k, c BY k; x = FOREACH j GENERATE b::n_name AS n, 'null' AS w; y = FOREACH i GENERATE b::n_name AS n, 'key' AS w; out = UNION x, y;",
    sql="SELECT n_name AS n, 'key' AS w FROM nation",
)
_add("nested_outer_reference", "g = GROUP orders BY o_custkey; out = FOREACH g { a = orders.o_totalprice; o = FILTER orders BY o_orderstatus == 'O'; b = o.o_totalprice; GENERATE group AS k, COUNT(a) AS n, COUNT(b) AS open; };", sql="SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY 1")
_add("sample_bounds", "a = SAMPLE lineitem 0.1; g = GROUP a ALL; c = FOREACH g GENERATE COUNT(a) AS n; h = GROUP lineitem ALL; b = FOREACH h GENERATE COUNT(lineitem) AS m; x = CROSS c, b; y = FILTER x BY n * 100 > m * 8 AND n * 100 < m * 12; out = FOREACH y GENERATE 'fair' AS share;", sql="SELECT 'fair' AS share")
_add("sample_all_or_none", "a = SAMPLE nation 1.0; b = SAMPLE region 0.0; x = FOREACH a GENERATE n_name AS n; y = FOREACH b GENERATE r_name AS n; out = UNION x, y;", sql="SELECT n_name AS n FROM nation")
_add("stream_through", lambda s, t: s.operator("above", lambda df, name, least: df.where(f"{name} > {least}")), "a = FOREACH part GENERATE p_partkey, p_size; out = STREAM a THROUGH above(p_size, 25);", sql="SELECT p_partkey, p_size FROM part WHERE p_size > 25")
_add("embedded_code", "<% def plus(n: int, m: int) -> int:\n    return n + m\n%> out = FOREACH nation GENERATE n_nationkey AS k, plus(n_nationkey, n_regionkey) AS p;", sql="SELECT n_nationkey AS k, CAST(n_nationkey + n_regionkey AS BIGINT) AS p FROM nation", allow_code=True)
_add(
    "embedded_rules",
    "<%\nrules:\ndef rule_more(plan):\n    for s in plan:\n        if s.kind == 'limit' and s['n'] == 1:\n            return rewrite.replace(plan, s, s.but(n=1000))\n%> out = LIMIT nation 1;",
    sql="SELECT * FROM nation",
    allow_code=True,
)


def _module(s: Session, t: str) -> None:
    import tempfile

    path = Path(tempfile.mkdtemp(prefix="weftline-")) / "helpers.py"  # the driver ships it to the executors
    path.write_text("def thrice(n: int) -> int:\n    return 3 * n\n")
    s.params["py"] = str(path)


_add("register_python", _module, "REGISTER '$py'; out = FOREACH region GENERATE r_regionkey AS k, thrice(r_regionkey) AS n;", sql="SELECT r_regionkey AS k, CAST(3 * r_regionkey AS BIGINT) AS n FROM region", allow_code=True)


def _import(s: Session, t: str) -> None:
    import tempfile

    path = Path(tempfile.mkdtemp(prefix="weftline-")) / "part.script"
    path.write_text("DEFINE keyed(b) RETURNS r { $r = FOREACH $b GENERATE r_regionkey + $more AS k; };\n")
    s.base = path.parent


_add("import_declare", _import, "%declare more 5\nIMPORT 'part.script';\nout = keyed(region);", sql="SELECT r_regionkey + 5 AS k FROM region")
_add("set_ansi", "SET spark.sql.ansi.enabled false;", "out = FOREACH region GENERATE r_regionkey AS k, (int) r_name AS n;", lambda s, t: (s.bind("fixed", s.df("out").persist()), s.df("fixed").count(), s.run("SET spark.sql.ansi.enabled true;")), sql="SELECT r_regionkey AS k, CAST(NULL AS INTEGER) AS n FROM region")
_add("materialize", "a = FILTER orders BY o_totalprice > 100000.0; MATERIALIZE a; out = FOREACH a GENERATE o_orderkey;", sql="SELECT o_orderkey FROM orders WHERE o_totalprice > 100000", store="kept")


def _later(s: Session, t: str) -> None:
    """Another session with the same store reads what the first one kept, whatever its aliases."""
    again = Session(s.spark, s.params, out=lambda *_: None, store=f"{t}/kept")
    again.run("orders = LOAD '$d/orders.parquet' USING Parquet(); kept = FILTER orders BY o_totalprice > 100000.0; o = FOREACH kept GENERATE o_orderkey;")
    plan = again.df("o")._jdf.queryExecution().optimizedPlan().toString()
    if "o_totalprice#" in plan and "Filter" in plan:
        raise AssertionError("the kept result wasn't used")
    s.bind("out", again.df("o"))


_add("materialize_again", "a = FILTER orders BY o_totalprice > 100000.0; MATERIALIZE a;", _later, sql="SELECT o_orderkey FROM orders WHERE o_totalprice > 100000", store="kept")
_add(
    "spatial_times",
    """p = FOREACH events GENERATE event_id, geometry("POINT(" + value + " " + user_id + ")", event_id) AS g; f = SPATIAL_FILTER p BY containedBy(g, geometry("POLYGON((0 0, 60 0, 60 50, 0 50, 0 0))", 100, 700)); out = FOREACH f GENERATE event_id;""",
    sql="SELECT event_id FROM events WHERE value BETWEEN 0 AND 60 AND user_id BETWEEN 0 AND 50 AND event_id BETWEEN 100 AND 700",
)
_POINTS = 'p = FOREACH events GENERATE event_id, geometry("POINT(" + value + " " + user_id + ")") AS g;\n'
_SQUARES = """b = FOREACH nation GENERATE n_nationkey, n_nationkey * 4 AS x, n_nationkey * 3 AS y;
    c = FOREACH b GENERATE n_nationkey, geometry("POLYGON((" + x + " " + y + ", " + (x + 9) + " " + y + ", " + (x + 9) + " " + (y + 9) + ", " + x + " " + (y + 9) + ", " + x + " " + y + "))") AS h;\n"""
_IN = "SELECT event_id, n_nationkey FROM events JOIN nation ON value BETWEEN n_nationkey * 4 AND n_nationkey * 4 + 9 AND user_id BETWEEN n_nationkey * 3 AND n_nationkey * 3 + 9"
_add("spatial_join_grid", _POINTS + _SQUARES + "j = SPATIAL_JOIN p PARTITION BY GRID(partitionsPerDimension=7), c ON containedBy(g, h); out = FOREACH j GENERATE event_id, n_nationkey;", sql=_IN)
_add("spatial_bsp_index_join", _POINTS + _SQUARES + "q = PARTITION p ON g USING BSP(sideLength=2, maxCost=300); i = INDEX q ON g USING RTREE(order=5); j = SPATIAL_JOIN i, c ON containedBy(g, h) USING INDEX RTREE(order=5); out = FOREACH j GENERATE event_id, n_nationkey;", sql=_IN)


def _parts(s: Session, t: str) -> None:
    """Rows of the largest partition and their number in all: BSP bounds the first unless a cell alone holds more."""
    from pyspark.sql import functions as F

    r = s.relation("q")
    sizes = r.df.groupBy(F.spark_partition_id().alias("p")).count()
    s.bind("out", sizes.agg(F.sum("count").alias("n"), (F.count("*") > 4).alias("cut")))


_add("partition_bsp", _POINTS + "q = PARTITION p ON g USING BSP(sideLength=2, maxCost=50);", _parts, sql="SELECT count(*) AS n, true AS cut FROM events")


def _png(s: Session, t: str) -> None:
    import tempfile

    path = Path(tempfile.mkdtemp(prefix="weftline-")) / "p.png"
    s.run(f"VISUALIZE p BY g INTO '{path}' AS (40, 30);")
    head = path.read_bytes()[16:24]
    s.bind("out", s.spark.createDataFrame([(int.from_bytes(head[:4], "big"), int.from_bytes(head[4:], "big"))], "width int, height int"))


_add("visualize", _POINTS, _png, sql="SELECT 40 AS width, 30 AS height")
_add(
    "window_range_by_rows",
    "e = FOREACH events GENERATE event_id AS n, ts; f = ORDER e BY n; w = WINDOW events RANGE 30 MINUTES SLIDE ROWS 100; g = GROUP w ALL; out = FOREACH g GENERATE COUNT(w) AS n, MAX(w.event_id) AS hi;",
    sql="""WITH e AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id, user_id, event_type, value, props) AS n FROM events), k AS (SELECT * FROM e WHERE n % 100 = 0)
    SELECT count(*) AS n, max(e.event_id) AS hi FROM k JOIN e ON e.n <= k.n AND e.ts > k.ts - INTERVAL 30 MINUTES GROUP BY k.n""",
)
_add(
    "window_rows_by_range",
    "w = WINDOW events ROWS 50 SLIDE RANGE 60 MINUTES; g = GROUP w ALL; out = FOREACH g GENERATE COUNT(w) AS n, MIN(w.event_id) AS lo;",
    sql="""WITH e AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id, user_id, event_type, value, props) AS n FROM events), t AS (SELECT max(n) AS m FROM e GROUP BY time_bucket(INTERVAL '60 minutes', ts, TIMESTAMP '1970-01-01'))
    SELECT count(*) AS n, min(event_id) AS lo FROM t JOIN e ON e.n <= t.m AND e.n > t.m - 50 GROUP BY t.m""",
)


def _live(script: str, files: str = "e") -> list[Step]:
    """Events stored as text, read as a live stream by micro-batches, stored again, and loaded."""
    return ["a = FOREACH events GENERATE event_id, user_id, event_type, value; o = ORDER a BY event_id; STORE o INTO '$t/in';", "fs -rm -r $t/in/_SUCCESS;\n", "s = LOAD '$t/in' USING PigStream(',') AS (id: long, u: long, kind: chararray, v: double);\n" + script]


_add("live_filter", *_live("f = FILTER s BY kind == 'click'; p = FOREACH f GENERATE id, v; STORE p INTO '$t/out';"), "out = LOAD '$t/out' USING PigStorage(',') AS (id: long, v: double);", sql="SELECT event_id AS id, value AS v FROM events WHERE event_type = 'click'")
_add(
    "live_running_group",
    *_live("g = GROUP s BY u; p = FOREACH g GENERATE group, COUNT(s), MAX(s.id); STORE p INTO '$t/out';"),
    "x = LOAD '$t/out' USING PigStorage(',') AS (u: long, n: long, m: long); y = GROUP x BY u; out = FOREACH y GENERATE group AS u, MAX(x.n) AS n, MAX(x.m) AS m, COUNT(x) AS rows;",
    sql="SELECT user_id AS u, count(*) AS n, max(event_id) AS m, count(*) AS rows FROM events GROUP BY 1",
)
_add("live_accumulate", *_live("p = ACCUMULATE s GENERATE COUNT(id), MAX(id), MIN(id); STORE p INTO '$t/out';"), "x = LOAD '$t/out' USING PigStorage(',') AS (n: long, hi: long, lo: long); y = GROUP x ALL; out = FOREACH y GENERATE MAX(x.n) AS n, MAX(x.hi) AS hi, MIN(x.lo) AS lo, COUNT(x) AS rows;", sql="SELECT count(*) AS n, max(event_id) AS hi, min(event_id) AS lo, count(*) AS rows FROM events")
_add("live_sample", *_live("p = SAMPLE s 1.0; q = FOREACH p GENERATE id; STORE q INTO '$t/out';"), "out = LOAD '$t/out' USING PigStorage(',') AS (id: long);", sql="SELECT event_id AS id FROM events")
_add(
    "live_events",
    *_live("m = MATCH_EVENT s PATTERN SEQ(A, B) WITH (A: kind == 'view', B: kind == 'click') MODE skip_till_next_match BY u ORDER BY id; p = FOREACH m GENERATE id; STORE p INTO '$t/out';"),
    "out = LOAD '$t/out' USING PigStorage(',') AS (id: long);",
    sql="""WITH e AS (SELECT *, min(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ni FROM events)
    SELECT unnest([event_id, ni]) AS id FROM e WHERE event_type = 'view' AND ni IS NOT NULL""",
)
_add(
    "live_window_rows",
    *_live("w = WINDOW s ROWS 40 SLIDE ROWS 20; g = GROUP w BY kind; c = FOREACH g GENERATE group, COUNT(w), MIN(w.id), MAX(w.id); STORE c INTO '$t/out';"),
    "x = LOAD '$t/out' USING PigStorage(',') AS (kind: chararray, n: long, lo: long, hi: long); y = GROUP x ALL; out = FOREACH y GENERATE SUM(x.n) AS n;",
    sql="SELECT CAST(40 * ((count(*) - 40) // 20 + 1) AS BIGINT) AS n FROM events",
)


def _socket_write(s: Session, t: str) -> None:
    """The lines that a listener of our own got."""
    import socket
    import threading

    server, got = socket.create_server(("127.0.0.1", 0)), []

    def take() -> None:
        c, _ = server.accept()
        with c, c.makefile() as f:
            got.extend(f.read().splitlines())

    listener = threading.Thread(target=take, daemon=True)
    listener.start()
    s.run(f"SOCKET_WRITE n TO '127.0.0.1:{server.getsockname()[1]}' USING PigStorage(',');")
    listener.join(60)
    server.close()
    s.bind("out", s.spark.createDataFrame([(x,) for x in got], "line string"))


_add("socket_write", "n = FOREACH nation GENERATE n_nationkey, n_name;", _socket_write, sql="SELECT n_nationkey || ',' || n_name AS line FROM nation")


def _socket_read(s: Session, t: str) -> None:
    """Rows sent by a server of our own, read as a live stream until all are stored."""
    import socket
    import threading
    import time

    lines = [f"{r.n_nationkey},{r.n_name}" for r in s.df("n").collect()]
    server, done = socket.create_server(("127.0.0.1", 0)), threading.Event()

    def serve() -> None:
        c, _ = server.accept()
        with c:
            c.sendall("".join(x + "\n" for x in lines).encode())
            done.wait(120)

    threading.Thread(target=serve, daemon=True).start()
    s.run(f"SET available_now false; r = SOCKET_READ '127.0.0.1:{server.getsockname()[1]}' USING PigStream(',') AS (k: int, n: chararray); f = FILTER r BY k >= 5; STORE f INTO '{t}/out';")
    query, until, seen = s.queries[-1], time.time() + 60, 0
    while seen < len(lines) and time.time() < until:
        query.processAllAvailable()
        seen = sum(p["numInputRows"] for p in query.recentProgress)
        time.sleep(0.1)
    query.stop()
    done.set()
    server.close()


_add("socket_read", "n = FOREACH nation GENERATE n_nationkey, n_name;", _socket_read, "out = LOAD '$t/out' USING PigStorage(',') AS (k: int, n: chararray);", sql="SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey >= 5")


def _rdf_server(s: Session, t: str) -> None:
    """Triples behind an address, served by this process."""
    import http.server
    import threading

    body = "".join(f'n{r.n_nationkey} name "{r.n_name}"\n' for r in s.df("n").collect()).encode()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    s.run(f"out = RDFLOAD('http://127.0.0.1:{server.server_address[1]}/triples.nt');")
    server.shutdown()
    server.server_close()


_add("rdfload_remote", "n = FOREACH nation GENERATE n_nationkey, n_name;", _rdf_server, sql="""SELECT 'n' || n_nationkey AS subject, 'name' AS predicate, '"' || n_name || '"' AS object FROM nation""")


def _command(s: Session, t: str) -> None:
    """A script file through the command line, with a parameter."""
    import tempfile

    from . import __main__ as cli

    script = Path(tempfile.mkdtemp(prefix="weftline-")) / "s.script"
    script.write_text("n = LOAD '$d/nation.parquet' USING Parquet(); f = FILTER n BY n_regionkey == $region; g = FOREACH f GENERATE n_name; STORE g INTO 'names';")
    zone = s.spark.conf.get("spark.sql.session.timeZone")
    failed = cli.main(["-p", f"d={s.params['d']}", "-p", "region=3", "--outdir", t, "--quiet", "--log-level", "ERROR", str(script)])
    s.spark.conf.set("spark.sql.session.timeZone", zone)
    if failed:
        raise AssertionError("the script failed")


_add("command_line", _command, "out = LOAD '$t/names' USING TextLoader();", sql="SELECT n_name AS line FROM nation WHERE n_regionkey = 3")


def _profile(s: Session, t: str) -> None:
    """Bytes that each operator put out, as observed while it ran: 8 for each number of each row."""
    sizes = s.graph.sizes
    s.bind("out", s.spark.createDataFrame([(a, sizes[s.signatures[a]]) for a in ("a", "b", "c")], "alias string, size bigint"))


_add(
    "profiling",
    "a = FOREACH lineitem GENERATE l_orderkey, l_quantity; b = FILTER a BY l_quantity > 30.0; c = FOREACH b GENERATE l_orderkey; STORE c INTO '$t/a';",
    _profile,
    sql="SELECT 'a' AS alias, 16 * count(*) AS size FROM lineitem UNION ALL SELECT 'b', 16 * count(*) FROM lineitem WHERE l_quantity > 30 UNION ALL SELECT 'c', 8 * count(*) FROM lineitem WHERE l_quantity > 30",
    profile=True,
)
_add(
    "live_window",
    "a = FOREACH events GENERATE event_id * 60, event_type; STORE a INTO '$t/in'; b = FOREACH region GENERATE 900000000 + r_regionkey, 'end'; c = LIMIT b 1; STORE c INTO '$t/late'; STORE b INTO '$t/later';",
    # Later files close the last windows of those before.
    "fs -rm $t/in/_SUCCESS;\nfs -getmerge $t/late $t/in/zz1;\n",
    lambda s, t: __import__("time").sleep(1.1),
    "fs -getmerge $t/later $t/in/zz2;\n",
    "s = LOAD '$t/in' USING PigStream(',') AS (ts: long, kind: chararray) TIMESTAMP(ts); SET watermark '2000000 seconds'; w = WINDOW s RANGE 60 MINUTES; g = GROUP w BY kind; r = FOREACH g GENERATE group, COUNT(w); STORE r INTO '$t/out';",
    "out = LOAD '$t/out' USING PigStorage(',') AS (kind: chararray, n: long);",
    sql="SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type, event_id * 60 // 3600",
)

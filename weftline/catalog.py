"""Queries for each operator, as scripts over the test tables, with SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog_steps
from .session import Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Name: (script whose last alias is ``out``, SQL or None).
SCRIPTS: dict[str, tuple[str, str | None]] = {}


def _add(name: str, script: str, sql: str | None) -> None:
    SCRIPTS[name] = (script, sql)


def session(spark: SparkSession, sf_dir: str, script: str, **options) -> Session:
    """A session that ran a script; tables that it names are loaded under their names."""
    s = Session(spark, {"d": sf_dir}, out=lambda *_: None, **options)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", script)]
    s.run("".join(f"{t} = LOAD '{sf_dir}/{t}.parquet' USING Parquet()" + (" TIMESTAMP(ts)" if t == "events" else "") + ";\n" for t in used) + script)
    return s


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    script = SCRIPTS[name][0]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return session(spark, sf_dir, script, seed=7).df("out")

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query(name) for name in SCRIPTS} | catalog_steps.queries()


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in SCRIPTS.items() if sql} | catalog_steps.oracle_sql()


_add(
    "pricing_summary",
    """f = FILTER lineitem BY l_shipdate <= '1998-09-02';
    v = FOREACH f GENERATE l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross;
    g = GROUP v BY (l_returnflag, l_linestatus);
    out = FOREACH g GENERATE FLATTEN(group) AS (flag, status), SUM(v.l_quantity) AS qty, round(SUM(v.l_extendedprice), 2) AS base, round(SUM(v.net), 2) AS net, round(SUM(v.gross), 2) AS gross, round(AVG(v.l_quantity), 6) AS avg_qty, round(AVG(v.l_discount), 6) AS avg_disc, COUNT(v) AS n;""",
    """SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS gross, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
_add("load_project", "out = FOREACH lineitem GENERATE l_orderkey, l_linenumber, l_quantity;", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
_add(
    "filter_bool",
    "f = FILTER part BY (p_size > 10 AND p_size <= 30 OR p_brand == 'Brand#2') AND NOT (p_retailprice < 950.0); out = FOREACH f GENERATE p_partkey, p_size, p_brand;",
    "SELECT p_partkey, p_size, p_brand FROM part WHERE (p_size > 10 AND p_size <= 30 OR p_brand = 'Brand#2') AND NOT p_retailprice < 950",
)
_add(
    "split_into",
    """SPLIT orders INTO big IF o_totalprice > 200000.0, open IF o_orderstatus == 'O';
    a = FOREACH big GENERATE o_orderkey, 'big' AS branch; b = FOREACH open GENERATE o_orderkey, 'open' AS branch;
    out = UNION a, b;""",
    "SELECT o_orderkey, 'big' AS branch FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, 'open' FROM orders WHERE o_orderstatus = 'O'",
)
_add(
    "foreach_arith_intdiv",
    "out = FOREACH lineitem GENERATE l_orderkey, l_linenumber, (l_orderkey - 5000) / 7 AS d, l_linenumber / 2 AS h, l_orderkey * 2 + l_linenumber - 1 AS m, -l_linenumber AS neg, l_quantity / 4 AS q;",
    "SELECT l_orderkey, l_linenumber, (l_orderkey - 5000) // 7 AS d, l_linenumber // 2 AS h, l_orderkey * 2 + l_linenumber - 1 AS m, -l_linenumber AS neg, l_quantity / 4 AS q FROM lineitem",
)
_add(
    "string_funcs",
    """out = FOREACH customer GENERATE c_custkey, UPPER(c_mktsegment) AS u, LOWER(c_name) AS l, SUBSTRING(c_name, 2, 5) AS s, SUBSTRING(c_name, 3) AS rest, STRLEN(c_name) AS n, CONCAT(c_name, c_mktsegment) AS c,
    STARTSWITH(c_mktsegment, 'B') AS st, ENDSWITH(c_mktsegment, 'E') AS en, STRCONTAINS(c_name, '1') AS co, TRIM(c_name + "  ") AS t, ISEMPTY(c_name) AS e;""",
    """SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_name) AS l, substr(c_name, 3, 3) AS s, substr(c_name, 4) AS rest, CAST(length(c_name) AS INTEGER) AS n, c_name || c_mktsegment AS c,
    starts_with(c_mktsegment, 'B') AS st, ends_with(c_mktsegment, 'E') AS en, contains(c_name, '1') AS co, trim(c_name) AS t, length(c_name) = 0 AS e FROM customer""",
)
_add(
    "casts",
    "out = FOREACH part GENERATE p_partkey, (int) p_retailprice AS i, (chararray) p_size AS c, (double) p_size AS d, (long) p_size AS l, TODOUBLE((chararray) p_size) AS td, TOINT((chararray) p_partkey) AS ti;",
    "SELECT p_partkey, CAST(trunc(p_retailprice) AS INTEGER) AS i, CAST(p_size AS VARCHAR) AS c, CAST(p_size AS DOUBLE) AS d, CAST(p_size AS BIGINT) AS l, CAST(p_size AS DOUBLE) AS td, CAST(p_partkey AS INTEGER) AS ti FROM part",
)
_add(
    "math_funcs",
    "out = FOREACH supplier GENERATE s_suppkey, round(SQRT(s_suppkey), 9) AS r, POW(s_suppkey, 2) AS p, abs(s_acctbal) AS a;",
    "SELECT s_suppkey, round(sqrt(s_suppkey), 9) AS r, pow(s_suppkey, 2) AS p, abs(s_acctbal) AS a FROM supplier",
)
_add("join2", "j = JOIN orders BY o_orderkey, lineitem BY l_orderkey; out = FOREACH j GENERATE o_orderkey, l_linenumber, o_totalprice;", "SELECT o_orderkey, l_linenumber, o_totalprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
_add(
    "join_nway_same_key",
    "j = JOIN customer BY c_nationkey, supplier BY s_nationkey, nation BY n_nationkey; g = GROUP j BY n_name; out = FOREACH g GENERATE group AS name, COUNT(j) AS n;",
    "SELECT n_name AS name, count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
_add(
    "join_composite_key",
    "a = FILTER lineitem BY l_quantity > 40.0; b = FILTER lineitem BY l_discount > 0.05; j = JOIN a BY (l_orderkey, l_linenumber), b BY (l_orderkey, l_linenumber); out = FOREACH j GENERATE a::l_orderkey AS k, b::l_linenumber AS n;",
    "SELECT a.l_orderkey AS k, b.l_linenumber AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 40 AND b.l_discount > 0.05",
)
_add(
    "self_join_lineage",
    "x = FOREACH nation GENERATE n_nationkey, n_regionkey; y = FOREACH nation GENERATE n_nationkey, n_regionkey; j = JOIN x BY n_regionkey, y BY n_regionkey; f = FILTER j BY x::n_nationkey < y::n_nationkey; out = FOREACH f GENERATE x::n_nationkey AS a, y::n_nationkey AS b;",
    "SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey WHERE x.n_nationkey < y.n_nationkey",
)
_add(
    "three_table_join",
    "a = JOIN nation BY n_regionkey, region BY r_regionkey; b = FOREACH a GENERATE n_nationkey AS nk, r_name; c = JOIN customer BY c_nationkey, b BY nk; g = GROUP c BY b::r_name; out = FOREACH g GENERATE group AS region_name, COUNT(c) AS n, round(SUM(c.customer::c_acctbal), 2) AS total;",
    "SELECT r_name AS region_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
)
_add("cross", "c = CROSS nation, region; out = FOREACH c GENERATE n_name, r_name;", "SELECT n_name, r_name FROM nation CROSS JOIN region")
_add("cross_many", "a = FOREACH region GENERATE r_regionkey AS k; b = FOREACH region GENERATE r_name AS n; d = FOREACH region GENERATE r_regionkey + 1 AS m; out = CROSS a, b, d;", "SELECT a.r_regionkey AS k, b.r_name AS n, d.r_regionkey + 1 AS m FROM region a, region b, region d")
_add("theta_join", "c = CROSS nation, supplier; out = FILTER c BY nation::n_nationkey > supplier::s_nationkey;", "SELECT * FROM nation JOIN supplier ON n_nationkey > s_nationkey")
_add(
    "cogroup",
    "c = COGROUP customer BY c_nationkey, supplier BY s_nationkey; out = FOREACH c GENERATE group AS k, COUNT(customer) AS nc, COUNT(supplier) AS ns;",
    "SELECT coalesce(a.k, b.k) AS k, coalesce(nc, 0) AS nc, coalesce(ns, 0) AS ns FROM (SELECT c_nationkey AS k, count(*) AS nc FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS ns FROM supplier GROUP BY 1) b ON a.k = b.k",
)
_add(
    "cogroup_multi_key",
    "c = COGROUP lineitem BY (l_returnflag, l_linestatus), orders BY (o_orderpriority, o_orderstatus); out = FOREACH c GENERATE group.l_returnflag AS a, group.l_linestatus AS b, COUNT(lineitem) AS nl, COUNT(orders) AS no;",
    "SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, coalesce(nl, 0) AS nl, coalesce(no, 0) AS no FROM (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS nl FROM lineitem GROUP BY 1, 2) x FULL JOIN (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS no FROM orders GROUP BY 1, 2) y ON x.a = y.a AND x.b = y.b",
)
_add(
    "group_bag_size",
    "g = GROUP orders BY o_custkey; f = FILTER g BY COUNT(orders) > 5; out = FOREACH f GENERATE group AS k, COUNT(orders) AS n, round(SUM(orders.o_totalprice), 2) AS t;",
    "SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY 1 HAVING count(*) > 5",
)
_add("group_all", "g = GROUP orders ALL; out = FOREACH g GENERATE group AS k, COUNT(orders) AS n, MAX(orders.o_totalprice) AS m;", "SELECT 'all' AS k, count(*) AS n, max(o_totalprice) AS m FROM orders")
_add(
    "group_multi_key",
    "g = GROUP orders BY (o_orderstatus, o_orderpriority); out = FOREACH g GENERATE group.o_orderstatus AS s, group.$1 AS p, COUNT(orders) AS n, MIN(orders.o_totalprice) AS lo, MAX(orders.o_totalprice) AS hi;",
    "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1, 2",
)
_add("group_key_column", "g = GROUP customer BY c_nationkey; out = FOREACH g GENERATE customer.c_nationkey AS k, round(AVG(customer.c_acctbal), 6) AS a;", "SELECT c_nationkey AS k, round(avg(c_acctbal), 6) AS a FROM customer GROUP BY 1")
_add(
    "accumulate",
    "out = ACCUMULATE lineitem GENERATE MIN(l_quantity) AS lo, MAX(l_extendedprice) AS hi, SUM(l_linenumber) AS s, COUNT(l_orderkey) AS n, AVG(l_linenumber) AS a;",
    "SELECT min(l_quantity) AS lo, max(l_extendedprice) AS hi, CAST(sum(l_linenumber) AS BIGINT) AS s, count(*) AS n, avg(l_linenumber) AS a FROM lineitem",
)
_add(
    "median_upper",
    "g = GROUP lineitem BY l_returnflag; out = FOREACH g GENERATE group AS f, MEDIAN(lineitem.l_extendedprice) AS m;",
    "SELECT l_returnflag AS f, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS m FROM lineitem GROUP BY 1",
)
_add(
    "nested_distinct_count",
    "g = GROUP orders BY o_custkey; out = FOREACH g { p = orders.o_orderpriority; d = DISTINCT p; GENERATE group AS k, COUNT(d) AS n; };",
    "SELECT o_custkey AS k, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1",
)
_add(
    "nested_filter_count",
    "g = GROUP lineitem BY l_orderkey; out = FOREACH g { r = FILTER lineitem BY l_returnflag == 'R'; big = FILTER r BY l_quantity > 25.0; GENERATE group AS k, COUNT(r) AS r, COUNT(big) AS b, COUNT(lineitem) AS n, SUM(r.l_quantity) AS q; };",
    "SELECT l_orderkey AS k, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) AS b, count(*) AS n, sum(l_quantity) FILTER (l_returnflag = 'R') AS q FROM lineitem GROUP BY 1",
)
_add(
    "nested_order_limit",
    "g = GROUP orders BY o_custkey; out = FOREACH g { s = ORDER orders BY o_totalprice DESC, o_orderkey; t = LIMIT s 2; GENERATE group AS k, FLATTEN(t.o_orderkey) AS o; };",
    "SELECT o_custkey AS k, o_orderkey AS o FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2",
)
_add("flatten_bag", "g = GROUP orders BY o_custkey; out = FOREACH g GENERATE group AS k, FLATTEN(orders.o_orderkey) AS o;", "SELECT o_custkey AS k, o_orderkey AS o FROM orders")
_add(
    "flatten_two_bags",
    "c = COGROUP nation BY n_regionkey, region BY r_regionkey; out = FOREACH c GENERATE group AS k, FLATTEN(nation.n_name) AS n, FLATTEN(region.r_name) AS r;",
    "SELECT r_regionkey AS k, n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey",
)
_add("flatten_tuple", "t = FOREACH nation GENERATE n_nationkey, (n_name, n_regionkey) AS t; out = FOREACH t GENERATE n_nationkey, FLATTEN(t) AS (a, b);", "SELECT n_nationkey, n_name AS a, n_regionkey AS b FROM nation")
_add(
    "order_multi_dir",
    "o = ORDER orders BY o_orderpriority DESC, o_totalprice ASC, o_orderkey; l = LIMIT o 50; out = FOREACH l GENERATE o_orderkey, o_orderpriority;",
    "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 50",
)
_add("limit", "f = FILTER lineitem BY l_quantity > 10.0; l = LIMIT f 1500; g = GROUP l ALL; out = FOREACH g GENERATE COUNT(l) AS n;", "SELECT count(*) AS n FROM (SELECT * FROM lineitem WHERE l_quantity > 10 LIMIT 1500)")
_add("top_k", "o = ORDER customer BY c_acctbal DESC, c_custkey; l = LIMIT o 10; out = FOREACH l GENERATE c_custkey, c_acctbal;", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
_add("zip_with_index", "o = ORDER supplier BY s_acctbal, s_suppkey; z = ZIP o WITH INDEX; out = FOREACH z GENERATE s_suppkey, index AS i;", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS i FROM supplier")
_add(
    "zip_bags",
    "a = ORDER nation BY n_nationkey; b = ORDER nation BY n_name; z = ZIP a WITH b; out = FOREACH z GENERATE a::n_nationkey AS k, b::n_name AS n;",
    "SELECT k, n FROM (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) JOIN (SELECT n_name AS n, row_number() OVER (ORDER BY n_name) AS i FROM nation) USING (i)",
)
_add(
    "union_bag",
    "a = FOREACH customer GENERATE c_nationkey AS k, c_acctbal AS b; b = FOREACH supplier GENERATE s_nationkey, s_acctbal; d = FOREACH nation GENERATE n_nationkey, n_regionkey; out = UNION a, b, d;",
    "SELECT c_nationkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier UNION ALL SELECT n_nationkey, CAST(n_regionkey AS DOUBLE) FROM nation",
)
_add("intersection_dedup", "a = FOREACH customer GENERATE c_nationkey AS k; b = FOREACH supplier GENERATE s_nationkey AS k; out = INTERSECTION a, b;", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_add(
    "difference_bag",
    "a = FOREACH customer GENERATE c_nationkey AS k; s = FILTER supplier BY s_acctbal > 5000.0; b = FOREACH s GENERATE s_nationkey AS k; out = DIFFERENCE a, b;",
    "SELECT c_nationkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 5000 AND s_nationkey IS NOT DISTINCT FROM c_nationkey)",
)
_add("difference_by_key", "d = DIFFERENCE customer BY c_custkey, orders BY o_custkey; out = FOREACH d GENERATE c_custkey;", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_add("distinct", "p = FOREACH lineitem GENERATE l_returnflag, l_linestatus, l_linenumber; out = DISTINCT p;", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
_add(
    "tokenize_wordcount",
    "w = FOREACH documents GENERATE FLATTEN(TOKENIZE(text)) AS word; g = GROUP w BY word; out = FOREACH g GENERATE group AS word, COUNT(w) AS n;",
    r"""SELECT word, count(*) AS n FROM (SELECT unnest(CASE WHEN text = '' THEN [''] WHEN regexp_replace(text, '([, "])+$', '') = '' THEN [] ELSE string_split_regex(regexp_replace(text, '([, "])+$', ''), '[, "]') END) AS word FROM documents) GROUP BY 1""",
)
_add("strsplit", 'p = FOREACH customer GENERATE c_custkey, STRSPLIT(c_name, "_") AS t; out = FOREACH p GENERATE c_custkey, t.$0 AS a, t.$1 AS b;', "SELECT c_custkey, string_split(c_name, '_')[1] AS a, string_split(c_name, '_')[2] AS b FROM customer")
_add(
    "map_lookup",
    'm = FOREACH events GENERATE event_id, ["type", event_type, "user", (chararray) user_id] AS m; out = FOREACH m GENERATE event_id, m#"type" AS t, m#"user" AS u, m#"none" AS n;',
    "SELECT event_id, event_type AS t, CAST(user_id AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS n FROM events",
)
_add(
    "constructors",
    "c = FOREACH supplier GENERATE s_suppkey AS k, {s_acctbal, 1.5} AS b, (s_name, s_nationkey) AS t, TOMAP('a', s_nationkey) AS m; out = FOREACH c GENERATE k, COUNT(b) AS n, MAX(b) AS hi, t.$0 AS name, t.s_nationkey AS nation_key, m#'a' AS a;",
    "SELECT s_suppkey AS k, CAST(2 AS BIGINT) AS n, greatest(s_acctbal, 1.5) AS hi, s_name AS name, s_nationkey AS nation_key, s_nationkey AS a FROM supplier",
)
_add(
    "matrix",
    "m = FOREACH part GENERATE p_partkey, ddmatrix(2, 2, p_size, p_retailprice, 0, 1) AS m, simatrix(1, 3, 0, p_size, 0) AS s; out = FOREACH m GENERATE p_partkey, (double) get_json_object(to_json(m), '$.values[0]') AS u, (double) get_json_object(to_json(m), '$.values[1]') AS v, (int) get_json_object(to_json(s), '$.at[0]') AS at;",
    "SELECT p_partkey, CAST(p_size AS DOUBLE) AS u, p_retailprice AS v, 1 AS at FROM part",
)
_TRIPLES = """n1 = FOREACH nation GENERATE 'n' + n_nationkey AS subject, 'name' AS predicate, n_name AS object;
    n2 = FOREACH nation GENERATE 'n' + n_nationkey AS subject, 'region' AS predicate, 'r' + n_regionkey AS object;
    r1 = FOREACH region GENERATE 'r' + r_regionkey AS subject, 'name' AS predicate, r_name AS object;
    c1 = FOREACH customer GENERATE 'c' + c_custkey AS subject, 'nation' AS predicate, 'n' + c_nationkey AS object;
    c2 = FOREACH customer GENERATE 'c' + c_custkey AS subject, 'segment' AS predicate, c_mktsegment AS object;
    t = UNION n1, n2, r1, c1, c2;\n"""
_add("bgp_single", _TRIPLES + "out = BGP_FILTER t BY { ?s 'region' 'r1' };", "SELECT 'n' || n_nationkey AS subject, 'region' AS predicate, 'r1' AS object FROM nation WHERE n_regionkey = 1")
_add("bgp_star", _TRIPLES + "out = BGP_FILTER t BY { ?c 'nation' ?n . ?c 'segment' ?seg };", "SELECT 'c' || c_custkey AS c, 'n' || c_nationkey AS n, c_mktsegment AS seg FROM customer")
_add(
    "bgp_path",
    _TRIPLES + "out = BGP_FILTER t BY { ?c 'nation' ?n . ?n 'region' ?r . ?r 'name' ?name };",
    "SELECT 'c' || c_custkey AS c, 'n' || c_nationkey AS n, r_name AS name, 'r' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
_add(
    "bgp_general",
    _TRIPLES + "out = BGP_FILTER t BY { ?c 'nation' ?n . ?c 'segment' 'BUILDING' . ?n 'region' ?r . ?n 'name' ?name };",
    "SELECT 'c' || c_custkey AS c, 'n' || c_nationkey AS n, n_name AS name, 'r' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'",
)
_add(
    "group_of_triples",
    _TRIPLES + "g = GROUP t BY subject; h = FOREACH g { m = FILTER t BY predicate == 'nation'; GENERATE group AS s, COUNT(m) AS n, COUNT(t) AS all_; }; out = FILTER h BY n > 0;",
    "SELECT 'c' || c_custkey AS s, CAST(1 AS BIGINT) AS n, CAST(2 AS BIGINT) AS all_ FROM customer",
)
_add(
    "tuplify",
    _TRIPLES + "u = TUPLIFY t ON subject; out = FOREACH u GENERATE subject, values#'name' AS name, values#'segment' AS segment;",
    "SELECT 'n' || n_nationkey AS subject, n_name AS name, NULL AS segment FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, NULL FROM region UNION ALL SELECT 'c' || c_custkey, NULL, c_mktsegment FROM customer",
)
_CEP = "e = FOREACH events GENERATE event_id, user_id, event_type, value, ts;\nm = MATCH_EVENT e PATTERN {} MODE {} {} BY user_id ORDER BY event_id; out = FOREACH m GENERATE event_id, user_id;"
_TYPES = "WITH (A: event_type == 'view', B: event_type == 'click', C: event_type == 'purchase')"
_add(
    "cep_contiguity",
    _CEP.format(f"SEQ(A, B) {_TYPES}", "contiguity", ""),
    """WITH e AS (SELECT *, lead(event_type) OVER w AS nt, lead(event_id) OVER w AS ni FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT unnest([event_id, ni]) AS event_id, user_id FROM e WHERE event_type = 'view' AND nt = 'click'""",
)
_add(
    "cep_next",
    _CEP.format(f"SEQ(A, B) {_TYPES}", "skip_till_next_match", ""),
    """WITH e AS (SELECT *, min(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ni FROM events)
    SELECT unnest([event_id, ni]) AS event_id, user_id FROM e WHERE event_type = 'view' AND ni IS NOT NULL""",
)
_add("cep_any", _CEP.format(f"SEQ(A, B) {_TYPES}", "skip_till_any_match", ""), "SELECT unnest([a.event_id, b.event_id]) AS event_id, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id WHERE a.event_type = 'view' AND b.event_type = 'click'")
#: For each event, the next one of each type for the same user.
_NEXT = "n AS (SELECT event_id, user_id, event_type, " + ", ".join(f"min(CASE WHEN event_type = '{k}' THEN event_id END) OVER w AS {c}" for k, c in (("view", "a"), ("click", "b"), ("purchase", "c"))) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"
# One run at a time: the first view, the next click, the next purchase, then from there on again.
_add(
    "cep_first",
    _CEP.format(f"SEQ(A, B, C) {_TYPES}", "first_match", ""),
    f"""WITH RECURSIVE {_NEXT}, f AS (SELECT user_id, min(event_id) AS a FROM events WHERE event_type = 'view' GROUP BY 1),
    m AS (SELECT x.user_id, x.event_id AS a, x.b, y.c FROM f JOIN n x ON x.event_id = f.a JOIN n y ON y.event_id = x.b WHERE y.c IS NOT NULL
    UNION ALL SELECT x.user_id, x.event_id, x.b, y.c FROM m JOIN n z ON z.event_id = m.c JOIN n x ON x.event_id = z.a JOIN n y ON y.event_id = x.b WHERE y.c IS NOT NULL)
    SELECT unnest([a, b, c]) AS event_id, user_id FROM m""",
)
# A view whose next view or click is a click: later views replace it before.
_add("cep_recent", _CEP.format(f"SEQ(A, B) {_TYPES}", "recent_match", ""), f"WITH {_NEXT} SELECT unnest([event_id, b]) AS event_id, user_id FROM n WHERE event_type = 'view' AND b IS NOT NULL AND (a IS NULL OR b < a)")
# Complete matches use up their rows: all views before a click go with the first click behind them.
_add("cep_cognitive", _CEP.format(f"SEQ(A, B) {_TYPES}", "cognitive_match", ""), f"WITH {_NEXT} SELECT unnest([event_id, b]) AS event_id, user_id FROM n WHERE event_type = 'view' AND b IS NOT NULL")
_add(
    "cep_within",
    "e = FOREACH events GENERATE event_id, user_id, event_type, ts;\nm = MATCH_EVENT e PATTERN SEQ(A, NEG(C), B) " + _TYPES + " MODE skip_till_next_match WITHIN 600 SECONDS BY user_id ORDER BY ts; out = FOREACH m GENERATE event_id, user_id;",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    m AS (SELECT v.event_id AS a, v.user_id, v.ts AS t, v.i, (SELECT min(x.i) FROM n x WHERE x.user_id = v.user_id AND x.i > v.i AND x.event_type IN ('click', 'purchase')) AS j FROM n v WHERE v.event_type = 'view')
    SELECT unnest([m.a, n.event_id]) AS event_id, m.user_id FROM m JOIN n ON n.user_id = m.user_id AND n.i = m.j WHERE n.event_type = 'click' AND n.ts <= m.t + INTERVAL 600 SECONDS""",
)
# Each order of the alternatives is a sequence whose runs each take the next fitting row.
_add(
    "cep_or_and",
    _CEP.format(f"SEQ(A, OR(B, C), AND(A, C)) {_TYPES}", "skip_till_next_match", ""),
    f"WITH {_NEXT} " + " UNION ALL ".join(f"SELECT unnest([v.event_id, v.{x}, p.{y}, q.{z}]) AS event_id, v.user_id FROM n v JOIN n p ON p.event_id = v.{x} JOIN n q ON q.event_id = p.{y} WHERE v.event_type = 'view' AND q.{z} IS NOT NULL" for x in "bc" for y, z in ("ac", "ca")),
)
_POINTS = 'p = FOREACH events GENERATE event_id, geometry("POINT(" + value + " " + user_id + ")") AS g;\n'
_add("spatial_filter", _POINTS + 'f = SPATIAL_FILTER p BY containedBy(g, geometry("POLYGON((10 10, 60 10, 60 50, 10 50, 10 10))")); out = FOREACH f GENERATE event_id;', "SELECT event_id FROM events WHERE value BETWEEN 10 AND 60 AND user_id BETWEEN 10 AND 50")
_add(
    "spatial_join",
    _POINTS + """b = FOREACH nation GENERATE n_nationkey, n_nationkey * 4 AS x, n_nationkey * 3 AS y;
    c = FOREACH b GENERATE n_nationkey, geometry("POLYGON((" + x + " " + y + ", " + (x + 9) + " " + y + ", " + (x + 9) + " " + (y + 9) + ", " + x + " " + (y + 9) + ", " + x + " " + y + "))") AS h;
    j = SPATIAL_JOIN p, c ON containedBy(g, h); out = FOREACH j GENERATE event_id, n_nationkey;""",
    "SELECT event_id, n_nationkey FROM events JOIN nation ON value BETWEEN n_nationkey * 4 AND n_nationkey * 4 + 9 AND user_id BETWEEN n_nationkey * 3 AND n_nationkey * 3 + 9",
)
_add("spatial_intersects", _POINTS + 'f = SPATIAL_FILTER p BY intersects(g, geometry("LINESTRING(0 5, 100 5)")); out = FOREACH f GENERATE event_id;', "SELECT event_id FROM events WHERE user_id = 5 AND value BETWEEN 0 AND 100")
_add("spatial_partition", _POINTS + "q = PARTITION p ON g USING GRID(partitionsPerDimension=3); i = INDEX q ON g USING RTREE(order=5); out = FOREACH i GENERATE event_id;", "SELECT event_id FROM events")
_add("s_distance", _POINTS + 'out = FOREACH p GENERATE event_id, round(S_DISTANCE(g, geometry("POINT(3 4)")), 6) AS d;', "SELECT event_id, round(sqrt((value - 3) * (value - 3) + (user_id - 4) * (user_id - 4)), 6) AS d FROM events")
_add(
    "window_tumbling",
    "w = WINDOW events RANGE 60 MINUTES; g = GROUP w BY event_type; out = FOREACH g GENERATE group AS type, COUNT(w) AS n, round(SUM(w.value), 4) AS s;",
    "SELECT event_type AS type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY event_type, time_bucket(INTERVAL '60 minutes', ts, TIMESTAMP '1970-01-01')",
)
_add(
    "window_sliding",
    "w = WINDOW events RANGE 60 MINUTES SLIDE RANGE 30 MINUTES; g = GROUP w BY user_id; out = FOREACH g GENERATE group AS u, COUNT(w) AS n;",
    "SELECT user_id AS u, count(*) AS n FROM (SELECT user_id, unnest([time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') - INTERVAL '30 minutes']) AS w FROM events) GROUP BY user_id, w",
)
_add(
    "window_rows",
    "e = FOREACH events GENERATE event_id, value; o = ORDER e BY event_id; w = WINDOW o ROWS 100; g = GROUP w ALL; out = FOREACH g GENERATE COUNT(w) AS n, MIN(w.event_id) AS lo, MAX(w.event_id) AS hi;",
    "SELECT count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS b FROM events) GROUP BY b",
)
_add(
    "window_join",
    """a = FILTER events BY event_type == 'view'; b = FILTER events BY event_type == 'click'; wa = WINDOW a RANGE 60 MINUTES; wb = WINDOW b RANGE 60 MINUTES;
    j = JOIN wa BY user_id, wb BY user_id; out = FOREACH j GENERATE wa::event_id AS a, wb::event_id AS b;""",
    "SELECT x.event_id AS a, y.event_id AS b FROM events x JOIN events y ON x.user_id = y.user_id AND time_bucket(INTERVAL '60 minutes', x.ts, TIMESTAMP '1970-01-01') = time_bucket(INTERVAL '60 minutes', y.ts, TIMESTAMP '1970-01-01') WHERE x.event_type = 'view' AND y.event_type = 'click'",
)
_add(
    "window_distinct",
    "p = FOREACH events GENERATE user_id, event_type, ts; q = FOREACH p GENERATE user_id, event_type; w = WINDOW events RANGE 60 MINUTES; g = GROUP w BY event_type; out = FOREACH g { u = w.user_id; d = DISTINCT u; GENERATE group AS type, COUNT(d) AS n; };",
    "SELECT event_type AS type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type, time_bucket(INTERVAL '60 minutes', ts, TIMESTAMP '1970-01-01')",
)
_REPLAY = "e = LOAD '$d/events.parquet' USING Replay('Parquet') TIMESTAMP(event_id);\n"
_add(
    "stream_accumulate",
    _REPLAY + "g = GROUP e BY user_id; out = ACCUMULATE g GENERATE MIN(e.event_id) AS lo, MAX(e.event_id) AS hi, COUNT(e.event_id) AS n;",
    "SELECT min(event_id) OVER w AS lo, max(event_id) OVER w AS hi, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
)
_add(
    "stream_accumulate_all",
    _REPLAY + "out = ACCUMULATE e GENERATE MIN(value) AS lo, MAX(event_id) AS hi, SUM(user_id) AS s, COUNT(value) AS n, AVG(user_id) AS a;",
    "SELECT min(value) OVER w AS lo, max(event_id) OVER w AS hi, CAST(sum(user_id) OVER w AS BIGINT) AS s, count(*) OVER w AS n, avg(user_id) OVER w AS a FROM events WINDOW w AS (ORDER BY event_id)",
)
_add(
    "stream_group_running",
    _REPLAY + "g = GROUP e BY event_type; out = FOREACH g GENERATE group AS type, COUNT(e) AS n, round(SUM(e.value), 4) AS s;",
    "SELECT event_type AS type, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)",
)
_add(
    "macro",
    "DEFINE scaled(bag_in, factor) RETURNS res { $res = FOREACH $bag_in GENERATE s_suppkey AS k, s_acctbal * $factor AS b; }; out = scaled(supplier, 2);",
    "SELECT s_suppkey AS k, s_acctbal * 2 AS b FROM supplier",
)
_add("define_alias", 'DEFINE shout CONCAT("!"); out = FOREACH region GENERATE shout(r_name) AS s;', "SELECT '!' || r_name AS s FROM region")
_add("cache", "c = CACHE nation MEMORY_AND_DISK; out = FOREACH c GENERATE n_name;", "SELECT n_name FROM nation")
_add("sample", "out = SAMPLE lineitem 0.1;", None)
_add("delay", "d = DELAY region BY (1, 3); out = FOREACH d GENERATE r_name;", "SELECT r_name FROM region, range(3)")
_add(
    "taxi_style",
    """f = FILTER lineitem BY l_quantity > 5.0; v = FOREACH f GENERATE l_suppkey, l_extendedprice / l_quantity AS unit; g = GROUP v BY l_suppkey;
    a = FOREACH g GENERATE group AS k, AVG(v.unit) AS m; j = JOIN a BY k, supplier BY s_suppkey; h = FILTER j BY a::m > 100.0; out = FOREACH h GENERATE k, s_name, round(m, 4) AS m;""",
    "SELECT k, s_name, round(m, 4) AS m FROM (SELECT l_suppkey AS k, avg(l_extendedprice / l_quantity) AS m FROM lineitem WHERE l_quantity > 5 GROUP BY 1) JOIN supplier ON k = s_suppkey WHERE m > 100",
)
_add(
    "two_branch_self_join",
    """a = FOREACH orders GENERATE o_custkey AS c, o_totalprice AS p, o_orderstatus AS s; x = FILTER a BY s == 'O'; y = FILTER a BY s == 'F'; gx = GROUP x BY c; gy = GROUP y BY c;
    ax = FOREACH gx GENERATE group AS c, AVG(x.p) AS m; ay = FOREACH gy GENERATE group AS c, AVG(y.p) AS m; j = JOIN ax BY c, ay BY c; out = FOREACH j GENERATE ax::c AS c, round(ax::m - ay::m, 4) AS d;""",
    "SELECT c, round(a - b, 4) AS d FROM (SELECT o_custkey AS c, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS a, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS b FROM orders GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL",
)

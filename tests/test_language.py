"""Scripts end to end on small files: loaders, nesting, functions, outputs, macros, embedded code, console and command line."""

import json
import math

import pytest

from weftline import __main__ as cli
from weftline.session import Session
from weftline.types import ScriptError


@pytest.fixture
def make(spark, tmp_path):
    def session(**options):
        return Session(spark, {"d": str(tmp_path)}, out=lambda *_: None, **options)

    return session


@pytest.fixture
def put(tmp_path):
    def write(name, *lines):
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))

    return write


def rows(s, alias):
    return sorted(map(tuple, s.df(alias).collect()), key=str)


def printed(s, alias):
    return s.run(f"DUMP {alias};")[0]


def test_storage_options(make, put):
    put("t", "a|1|", "", "# no", "a|1|", "b|2|x")
    s = make()
    s.run(r"a = LOAD '$d/t' USING PigStorage('\\|', skipEmpty=true, comments='#') AS (k: chararray, n: int, z: chararray);")
    assert rows(s, "a") == [("a", 1, ""), ("a", 1, ""), ("b", 2, "x")]
    # The header goes by value: every line that equals the first one.
    s.run(r"b = LOAD '$d/t' USING PigStorage('\\|', true, true, '#') AS (k: chararray, n: int);")
    assert rows(s, "b") == [("b", 2)]


def test_without_schema(make, put):
    put("t", "1\t2", "3\t4\t5")
    s = make()
    s.run("a = LOAD '$d/t'; b = FILTER a BY $0 > 1; c = FOREACH a GENERATE $1, $0 + $1; j = JOIN a BY $0, b BY $0;")
    assert printed(s, "b") == ["3,4,5"] and sorted(printed(s, "c")) == ["2,3.0", "4,7.0"] and printed(s, "j") == ["3,4,5,3,4,5"]
    with pytest.raises(ScriptError, match="schema"):
        s.run("e = FILTER a BY x > 1;")


def test_text_and_complex_loads(make, put, tmp_path):
    put("t", "mary had", "a lamb")
    put("c", "(1,x)\t{(1),(2)}\t[k#5,j#6]")
    s = make()
    s.run("a = LOAD '$d/t' USING TextLoader(); b = FOREACH a GENERATE line AS l; c = LOAD '$d/c' AS (t: tuple(p: int, q: chararray), b: bag{tuple(n: int)}, m: map[int]); e = FOREACH c GENERATE t.p, t.$1, SUM(b.n) AS s, m#'j' AS j;")
    assert rows(s, "b") == [("a lamb",), ("mary had",)] and rows(s, "e") == [(1, "x", 3, 6)]


def test_json(make, put):
    put("j", '{"name": "n", "address": {"city": "c", "zip": 3}, "list": [{"x": 1}]}', '{"name": null}')
    s = make()
    s.run("a = LOAD '$d/j' USING JsonStorage2() AS (name: chararray, address: tuple(city: chararray, zip: int), list: bag{tuple(x: int)}); b = FOREACH a GENERATE name, address.zip AS z, COUNT(list) AS n; c = LOAD '$d/j' USING JsonStorage(); d = FOREACH c GENERATE name;")
    assert ("n", 3, 1) in rows(s, "b") and len(rows(s, "d")) == 2


def test_triples(make, put):
    put("r", '<s1> name "a b" .', '<s1> knows <s2> .', "<s2> name \"c\" .", "", "# note")
    s = make()
    s.run("t = RDFLOAD('$d/r'); g = RDFLOAD('$d/r') GROUPED ON subject; a = BGP_FILTER t BY { ?x 'knows' ?y . ?y 'name' ?n }; b = BGP_FILTER g BY { ?x 'knows' ?y }; c = FOREACH b GENERATE subject, COUNT(stmts) AS n; d = BGP_FILTER g BY { ?x 'knows' ?y . ?y 'name' ?n }; e = BGP_FILTER t BY { ?x ?p ?x };")
    assert s.df("a").columns == ["n", "x", "y"] and rows(s, "a") == rows(s, "d") == [('"c"', "<s1>", "<s2>")] and rows(s, "c") == [("<s1>", 2)] and rows(s, "e") == []


def test_stored_rows_come_back(make, put, tmp_path):
    put("t", "1,a", "2,b")
    s = make()
    s.run("a = LOAD '$d/t' USING PigStorage(',') AS (n: int, k: chararray); STORE a INTO '$d/o1'; STORE a INTO '$d/o2' USING JsonStorage(); STORE a INTO '$d/o3' USING BinStorage(); STORE a INTO '$d/o4' USING PigStorage('|');")
    s.run("b = LOAD '$d/o1' USING PigStorage(',') AS (n: int, k: chararray); c = LOAD '$d/o2' USING JsonStorage2() AS (n: int, k: chararray); e = LOAD '$d/o3' USING BinStorage();")
    assert rows(s, "b") == rows(s, "c") == rows(s, "e") == [(1, "a"), (2, "b")]
    assert sorted(x for p in tmp_path.glob("o4/part-*") for x in p.read_text().split()) == ["1|a", "2|b"]
    with pytest.raises(Exception, match="(?i)exists"):
        s.run("STORE a INTO '$d/o1';")
    Session(s.spark, {"d": str(tmp_path)}, mode="overwrite").run("x = LOAD '$d/t'; STORE x INTO '$d/o1';")


def test_printed_forms(make, put):
    put("t", "1,2,n")
    s = make()
    s.run("a = LOAD '$d/t' USING PigStorage(',') AS (x: int, y: int, n: chararray); b = FOREACH a GENERATE (x, y), {x, y}, ['k', n], ddmatrix(2, 1, x, y), geometry('POINT(1 2)');")
    (line,) = printed(s, "b")
    assert line.startswith("(1,2),{(1),(2)},[k#n],") and line.endswith(",POINT(1 2)") and '"rows":2' in line
    s.run("g = GROUP a BY (x, y); h = GROUP a ALL; e = FILTER a BY x > 5; i = GROUP e ALL; j = FOREACH i GENERATE group AS k, COUNT(e) AS n;")
    assert printed(s, "g") == ["(1,2),{(1,2,n)}"] and printed(s, "h") == ["all,{(1,2,n)}"] and printed(s, "i") == ["all,{}"] and rows(s, "j") == [("all", 0)]
    assert s.run("DESCRIBE g;")[0] == "g: {group: (x: int, y: int), a: {(x: int, y: int, n: chararray)}}"
    assert s.run("DISPLAY a;")[0] == "%table x\ty\tn\n1\t2\tn" and s.run("DUMP a MUTE;") == []


def test_nested_block(make, put):
    put("t", *[f"{k},{v}" for k, v in [(1, 5), (1, 3), (1, 5), (2, ""), (2, 7)]])
    s = make()
    s.run("""a = LOAD '$d/t' USING PigStorage(',') AS (k: int, v: chararray); c = FOREACH a GENERATE k, v; g = GROUP c BY k;
    b = FOREACH g { x = c.v; d = DISTINCT x; o = ORDER c BY v DESC; l = LIMIT o 1; f = FILTER c BY v == '5'; GENERATE group AS k, COUNT(d) AS n, FLATTEN(l.v) AS top, COUNT(f) AS fives, ISEMPTY(f) AS none; };
    e = FOREACH g GENERATE group, FLATTEN(c), COUNT(c) AS n; p = FOREACH g GENERATE c.k AS k, COUNT(c) AS n;""")
    assert rows(s, "b") == [(1, 2, "5", 2, False), (2, 2, "7", 0, True)] and len(rows(s, "e")) == 5 and rows(s, "p") == [(1, 3), (2, 2)]


def test_functions(make, put):
    put("t", "x, y,,\t, ,\t\t-7")
    s = make()
    s.run("""a = LOAD '$d/t' AS (s: chararray, seps: chararray, e: chararray, n: int);
    b = FOREACH a GENERATE TOKENIZE(s) AS t, TOKENIZE(seps) AS u, TOKENIZE(e) AS v, n / 2 AS h, n / 2.0 AS q, SUBSTRING(s, 0, 1) AS c, TRIM("\\t q \\n") AS w, TOMAP('k', n) AS m, SQRT(n) AS r, n + s AS cat, abs(n) AS p;
    c = FOREACH b GENERATE COUNT(t) AS t, COUNT(u) AS u, COUNT(v) AS v, h, q, c, w, m#'k' AS k, r, cat, p;""")
    (r,) = s.df("c").collect()
    assert (r.t, r.u, r.v, r.h, r.q, r.c, r.w, r.k, r.cat, r.p) == (3, 0, 1, -3, -3.5, "x", "q", -7, "-7x, y,,", 7) and math.isnan(r.r)
    with pytest.raises(ScriptError, match="no function"):
        s.run("z = FOREACH a GENERATE NOSUCH(s);")


def test_median_is_the_upper_one(make, put):
    put("t", "1", "2", "3", "4")
    s = make()
    s.run("a = LOAD '$d/t' AS (v: int); g = GROUP a ALL; b = FOREACH g GENERATE MEDIAN(a.v) AS m; c = FOREACH g { o = ORDER a BY v; GENERATE MEDIAN(o.v) AS m; };")
    assert [tuple(r) for r in s.df("b").collect()] == [tuple(r) for r in s.df("c").collect()] == [(3,)]


def test_sets_keep_or_drop_repeats(make, put):
    put("a", "1,x", "1,x", "2,y", ",z")
    put("b", "2,y", "2,y", ",z")
    s = make()
    s.run("a = LOAD '$d/a' USING PigStorage(',') AS (n: chararray, k: chararray); b = LOAD '$d/b' USING PigStorage(',') AS (n: chararray, k: chararray); u = UNION a, b; i = INTERSECTION a, b; d = DIFFERENCE a, b; e = DIFFERENCE a BY k, b BY k; x = DISTINCT u;")
    assert len(rows(s, "u")) == 7 and rows(s, "i") == [("", "z"), ("2", "y")] and rows(s, "d") == rows(s, "e") == [("1", "x")] * 2 and len(rows(s, "x")) == 3


def test_composite_keys_do_not_run_together(make, put):
    put("a", "a,bc")
    put("b", "ab,c")
    s = make()
    s.run("a = LOAD '$d/a' USING PigStorage(',') AS (x: chararray, y: chararray); b = LOAD '$d/b' USING PigStorage(',') AS (x: chararray, y: chararray); j = JOIN a BY (x, y), b BY (x, y); k = JOIN a BY x, a BY x; c = COGROUP a BY (x, y), b BY (x, y);")
    assert rows(s, "j") == [] and len(rows(s, "k")) == 1 and len(rows(s, "c")) == 2


def test_names_after_joins(make, put):
    put("a", "1,2", "1,3")
    s = make()
    s.run("a = LOAD '$d/a' USING PigStorage(',') AS (k: int, v: int); b = FOREACH a GENERATE *; j = JOIN a BY k, b BY k; c = FOREACH j GENERATE a::v AS x, b::v AS y; f = FILTER j BY a::v < b::v;")
    assert len(rows(s, "c")) == 4 and len(rows(s, "f")) == 1 and s.df("f").columns == ["a::k", "a::v", "b::k", "b::v"]
    with pytest.raises(ScriptError, match="ambiguous"):
        s.run("z = FILTER j BY v > 1;")


def test_order_zip_and_windows_by_count(make, put):
    put("a", "b,1", "a,2", "b,3", "c,0")
    s = make()
    s.run("a = LOAD '$d/a' USING PigStorage(',') AS (k: chararray, n: int); o = ORDER a BY k DESC, n; z = ZIP o WITH INDEX; p = FOREACH a GENERATE n; y = ZIP o WITH p; w = WINDOW o ROWS 3 SLIDE ROWS 2; g = GROUP w ALL; c = FOREACH g GENERATE COUNT(w) AS n;")
    assert [tuple(r) for r in s.df("z").orderBy("index").collect()] == [("c", 0, 0), ("b", 1, 1), ("b", 3, 2), ("a", 2, 3)] and len(rows(s, "y")) == 4 and rows(s, "c") == [(2,), (3,)]


def test_casts_and_ansi(make, put):
    put("a", "1.5,x")
    s = make()
    s.run("a = LOAD '$d/a' USING PigStorage(',') AS (f: double, s: chararray); b = FOREACH a GENERATE (int) f AS i, (chararray) f AS c, (tuple(int, chararray)) (f, s) AS t; d = FOREACH b GENERATE i, c, t.$0 AS t;")
    assert rows(s, "d") == [(1, "1.5", 1)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        s.run("x = FOREACH a GENERATE (int) s AS i; DUMP x;")


def test_macros_aliases_and_settings(make, put):
    put("a", "1", "5")
    s = make()
    s.run("DEFINE over(b, n) RETURNS r { $r = FILTER $b BY v > $n; }; DEFINE hi CONCAT('hi '); SET my.own 3; a = LOAD '$d/a' AS (v: int); b = over(a, 2); c = FOREACH b GENERATE hi((chararray) v) AS t;")
    assert rows(s, "c") == [("hi 5",)] and s.settings["my.own"] == 3
    with pytest.raises(ScriptError, match="can't be set"):
        s.run("SET spark.master 'x';")


def test_embedded_python(make, put):
    put("a", "1", "5")
    code = "<% def twice(n: int) -> int:\n    return 2 * n\n%> a = LOAD '$d/a' AS (v: int); b = FOREACH a GENERATE twice(v) AS w;"
    s = make(allow_code=True)
    s.run(code)
    assert rows(s, "b") == [(10,), (2,)]
    with pytest.raises(ScriptError, match="allow_code"):
        make().run(code)


def test_own_rules_and_operators(make, put):
    put("a", "1", "5", "7")
    s = make(allow_code=True)
    s.run("<% def pick(df, n):\n    return df.where(df.columns[0] + f' > {n}')\nrules:\ndef rule_more(plan):\n    for s in plan:\n        if s.kind == 'limit' and s['n'] == 1:\n            return rewrite.replace(plan, s, s.but(n=2))\n%> a = LOAD '$d/a' AS (v: int); b = STREAM a THROUGH pick(4); c = LIMIT a 1;")
    assert rows(s, "b") == [(5,), (7,)] and len(rows(s, "c")) == 2
    t = make()
    t.operator("first", lambda df: df.limit(1))
    t.register("neg", lambda c: -c, "int")
    t.bind("x", s.spark.createDataFrame([(3,)], "v int"))
    t.run("y = STREAM x THROUGH first(); z = FOREACH y GENERATE neg(v) AS n;")
    assert rows(t, "z") == [(-3,)]


def test_unknown_things(make, put):
    put("a", "1")
    s = make()
    for text, what in (("x = FILTER nope BY $0 > 1;", "no bag"), ("x = LOAD 'f' USING Nope();", "no loader"), ("a = LOAD '$d/a'; STORE a INTO 'f' USING Nope();", "no storer"), ("b = RDFLOAD('http://127.0.0.1:9/y');", "remote")):
        with pytest.raises(ScriptError, match=what):
            make().run(text)
    s.run("a = LOAD '$d/a' AS (v: int); r = FILTER a BY v == 1;")
    with pytest.raises(ScriptError, match="twice"):
        s.run("r = LIMIT a 1;")
    s.run("r = LIMIT a 0;", redefine=True)
    assert rows(s, "r") == []


def test_file_commands(make, put, tmp_path):
    put("a", "1")
    s = make()
    s.run("fs -mkdir $d/sub;\nfs -copyToRemote $d/a $d/sub/b;\n")
    assert s.run("fs -ls $d/sub;") [0][0].endswith("/sub/b") and s.run("fs -cat $d/sub/b;") == [["1"]]
    with pytest.raises(ScriptError, match="isn't empty"):
        s.run("fs -rmdir $d/sub;")
    s.run("fs -getmerge $d/sub $d/merged;\nfs -rm -r $d/sub;\n")
    assert (tmp_path / "merged").read_text() == "1\n" and not (tmp_path / "sub").exists()
    with pytest.raises(ScriptError, match="no file system command"):
        s.run("fs -nope $d/a;")


def test_console(make, put):
    put("a", "1", "2")
    out = []
    s = make()
    s.out = out.append
    cli.console(s, ["a = LOAD '$d/a' AS (v: int);\n", "b = FOREACH a {\n", "GENERATE v; };\n", "a = LIMIT b 1;\n", "aliases\n", "DUMP b;\n", "DUMP zz;\n", "help\n", "quit\n", "DUMP a;\n"], out.append)
    assert out[0] == "a\nb" and sorted(out[1:3]) == ["1", "2"] and out[3].startswith("error: ") and out[4] == cli.HELP and len(out) == 5


def test_command_line(spark, put, tmp_path, capsys):
    put("a", "1", "2")
    put("s.pig", "a = LOAD '$d/a' AS (v: int); b = FILTER a BY v > $lo; STORE b INTO '$d/out'; DUMP b;")
    assert cli.main(["-p", f"d={tmp_path}", "-p", "lo=1", "--show-plan", str(tmp_path / "s.pig")]) == 0
    assert "b <- FILTER(a)" in capsys.readouterr().out and not (tmp_path / "out").exists()
    assert cli.main(["-p", f"d={tmp_path}", "-p", "lo=1", str(tmp_path / "s.pig")]) == 0 and capsys.readouterr().out.strip().endswith("2")
    put("bad.pig", "DUMP nothing;")
    assert cli.main([str(tmp_path / "bad.pig")]) == 1


def test_delay_sample_cache(make, put):
    put("a", *map(str, range(200)))
    s = make(seed=3)
    s.run("a = LOAD '$d/a' AS (v: int); b = DELAY a BY ('1S', 2); c = DELAY a BY (0, -4); d = SAMPLE a 0.5; e = CACHE a DISK_ONLY_2; f = SAMPLE a v / 400.0; DUMP e MUTE;")
    assert s.df("b").count() == 400 and 20 < s.df("c").count() < 90 and 60 < s.df("d").count() < 140 and s.df("e").storageLevel.useDisk and 20 < s.df("f").count() < 90
    with pytest.raises(ScriptError, match="fraction"):
        s.run("g = SAMPLE a 2.0;")


def test_materialize(make, put, tmp_path):
    put("a", "1", "2")
    script = "a = LOAD '$d/a' AS (v: int); b = FILTER a BY v > 1; MATERIALIZE b; c = FOREACH b GENERATE v + 1 AS w;"
    s = make(store=str(tmp_path / "kept"))
    s.run(script)
    assert rows(s, "c") == [(3,)] and len(json.loads((tmp_path / "kept" / "manifest.json").read_text())) == 1
    # A later session finds the result by what it computes, whatever its name.
    put("a", "7", "8")
    again = make(store=str(tmp_path / "kept"))
    again.run("x = LOAD '$d/a' AS (v: int); y = FILTER x BY v > 1;")
    assert rows(again, "y") == [(2,)]
    with pytest.raises(ScriptError, match="store"):
        make().run(script)


def test_merged_scripts_share_plans(make, put):
    put("a", "1", "2")
    s = make()
    s.run_merged(["a = LOAD '$d/a' AS (v: int); b = FILTER a BY v > 1;", "p = LOAD '$d/a' AS (v: int); q = FILTER p BY v > 1; r = LIMIT q 1;"])
    assert rows(s, "q") == [(2,)] and len([k for k in s.shared]) == 3


def test_command_line_outputs(spark, put, tmp_path, capsys):
    put("a", "1", "2")
    put("s.pig", "a = LOAD '$d/a' AS (v: int); b = FILTER a BY v > 1; STORE b INTO 'kept';")
    note = tmp_path / "note"
    done = f"""sh -c 'echo "$0" > {note}'"""
    assert cli.main(["-p", f"d={tmp_path}", "--outdir", str(tmp_path / "o"), "--show-stats", "--profiling", "--log-level", "ERROR", "--backend-args", "spark.sql.session.timeZone=UTC", "--notify", done, str(tmp_path / "s.pig")]) == 0
    printed_lines = capsys.readouterr().out
    assert (tmp_path / "o" / "kept" / "_SUCCESS").exists() and note.read_text() == "ok\n" and "b: " in printed_lines and " s, " in printed_lines


def test_long_displays_are_whole(make, put):
    put("a", *map(str, range(1500)))
    s = make()
    s.run("a = LOAD '$d/a' AS (v: int);")
    assert s.run("DISPLAY a;")[0].count("\n") == 1500
    assert s.run("SET display_rows 3; DISPLAY a;")[0].endswith("\nthe first 3 rows")


def test_jars_need_leave(make):
    with pytest.raises(ScriptError, match="allow_code"):
        make().run("REGISTER 'x.jar';")


def test_database_inside_the_driver(spark):
    """No task of an executor opens it: on a cluster another process would find another, empty database."""
    s = Session(spark, {"j": "jdbc:derby:memory:inside;create=true"}, out=lambda *_: None)
    s.bind("a", spark.range(0, 50_000, 1, 3).selectExpr("cast(id as int) AS K", "if(id % 7 = 0, null, concat('n', id)) AS N"))
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    s.run(f"STORE a INTO 'INSIDE' USING JdbcStorage('{driver}', '$j'); b = LOAD 'INSIDE' USING JdbcStorage('{driver}', '$j') AS (k: int, n: chararray);")
    assert "JDBC" not in s.df("b")._jdf.queryExecution().executedPlan().toString()
    assert s.df("b").exceptAll(s.df("a")).count() == 0 and s.df("b").count() == 50_000


def test_aggregates_of_a_join_dont_make_its_rows(spark):
    """Ten million pairs of one key, two keys that match nothing, null keys and fields of each input."""
    s = Session(spark, out=lambda *_: None)
    s.bind("a", spark.range(4000).selectExpr("cast(if(id < 3998, 1, if(id = 3998, 2, null)) as int) AS k", "if(id % 2 = 0, id, null) AS x"))
    s.bind("b", spark.range(5001).selectExpr("if(id < 5000, 1, null) AS k", "cast(id as double) AS y"))
    s.bind("c", spark.createDataFrame([(1, "p"), (1, "p"), (1, "q"), (3, "r")], "k int, n string"))
    script = "j = JOIN a BY k, b BY k, c BY k; g = GROUP j BY n; f = FILTER g BY COUNT(j) > 20000000; "
    aggregates = "group, COUNT(j), SUM(j.x), SUM(j.y), AVG(j.x), MIN(j.y), MAX(j.x)"
    s.run(script + f"r = FOREACH f GENERATE {aggregates}; h = GROUP j ALL; t = FOREACH h GENERATE COUNT(j), MIN(j.n); d = FILTER j BY x == 2; e = GROUP d BY n; u = FOREACH e GENERATE group, COUNT(d);")
    x, y, pairs = sum(range(0, 3998, 2)), sum(range(5000)), 3998 * 5000
    assert [tuple(r) for r in s.df("r").collect()] == [("p", 2 * pairs, 2 * 5000 * x, 2.0 * 3998 * y, x / 1999, 0.0, 3996)]
    assert [tuple(r) for r in s.df("t").collect()] == [(3 * pairs, "p")]
    assert sorted(map(tuple, s.df("u").collect())) == [("p", 10000), ("q", 5000)]
    plan = s.df("r")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate") and plan.count("Aggregate") == 4


def test_aggregates_of_a_cogroup_build_no_bags(spark):
    s = Session(spark, out=lambda *_: None)
    s.bind("a", spark.createDataFrame([(1, 5), (1, 7), (None, 1), (2, None)], "k int, x int"))
    s.bind("b", spark.createDataFrame([(1, "u"), (3, "v"), (3, "v"), (None, "w")], "k bigint, y string"))
    s.run("""c = COGROUP a BY k, b BY k; r = FOREACH c { w = FILTER a BY x > 5; y = b.y; d = DISTINCT y; GENERATE group, COUNT(a), COUNT(w), SUM(a.x), MAX(b.y), COUNT(d), ISEMPTY(b); };
    f = FILTER c BY NONEMPTY(a) AND COUNT(b) > 0; q = FOREACH f GENERATE group AS k, COUNT(b) AS n; whole = FOREACH f GENERATE group AS k, FLATTEN(b);""")
    want = {(1, 2, 1, 12, "u", 1, False), (None, 1, 0, 1, "w", 1, False), (2, 1, 0, None, None, 0, True), (3, 0, 0, None, "v", 1, False)}
    assert set(map(tuple, s.df("r").collect())) == want
    assert set(map(tuple, s.df("q").collect())) == {(1, 1), (None, 1)}
    assert {tuple(r) for r in s.df("whole").collect()} == {(1, 1, "u"), (None, None, "w")}
    assert all("collect_list" not in s.df(a)._jdf.queryExecution().optimizedPlan().toString() for a in ("r", "q"))

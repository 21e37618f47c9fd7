"""Grammar: what scripts parse to, and what they don't."""

import pytest

from weftline.plans import rewrite
from weftline.plans import tree as t
from weftline.plans.parser import parse
from weftline.plans.preprocess import parameter_file, prepared
from weftline.types import BYTEARRAY, SIMPLE, ScriptError


def one(text):
    (s,) = parse(text)
    return s


def test_keywords_know_no_case_and_semicolons_are_optional():
    a, b = parse("a = load 'f' b = FiLtEr a bY x > 1 -- comment; c = nothing\n")
    assert (a.kind, b.kind, b.ins) == ("load", "filter", ("a",))
    assert parse("/* c = LOAD 'x'; */ DUMP a;")[0].kind == "dump"


def test_load():
    s = one("a = LOAD 'f' USING PigStorage(',', skipEmpty=true) AS (x: int, y, m: map[], b: bag{tuple(p: long)}, c: {(q: chararray)}) TIMESTAMP(x);")
    assert s["using"] == ("PigStorage", [",", ("skipEmpty", True)]) and s["timestamp"] == t.Name("x")
    assert [f.name for f in s["schema"]] == ["x", "y", "m", "b", "c"] and s["schema"][1].type == BYTEARRAY
    assert str(s["schema"][3]) == "b: {(p: long)}" and str(s["schema"][4].type) == "{(q: chararray)}"


def test_expressions():
    s = one("b = FOREACH a GENERATE $0 + x * 2 - 1.5, (int) y, f::x, t.$1, m#'k', (x, y) AS tt, {1, 2}, [\"k\", 1], -x, COUNT(z) AS n: long;")
    e = [g.expr for g in s["generate"]]
    assert e[0] == t.Binary("-", t.Binary("+", t.Pos(0), t.Binary("*", t.Name("x"), t.Lit(2))), t.Lit(1.5))
    assert e[1] == t.Cast(SIMPLE["int"], t.Name("y")) and e[2] == t.Name("x", ("f",)) and e[3] == t.Deref(t.Name("t"), t.Pos(1)) and e[4] == t.Lookup(t.Name("m"), "k")
    assert isinstance(e[5], t.MakeTuple) and isinstance(e[6], t.MakeBag) and isinstance(e[7], t.MakeMap) and e[8] == t.Negative(t.Name("x"))
    assert s["generate"][9].alias.type == SIMPLE["long"]


def test_predicates_bind_like_logic():
    by = one("b = FILTER a BY x == 1 OR NOT (y < 2 AND z != 'q') AND true;")["by"]
    assert isinstance(by, t.Or) and isinstance(by.right, t.And) and isinstance(by.right.left, t.Not)


@pytest.mark.parametrize(
    "text, kind",
    [
        ("c = COGROUP a BY x, b BY y", "cogroup"), ("c = COGROUP a ALL, b ALL", "cogroup"), ("j = JOIN a BY (x, y), b BY (z, w)", "join"), ("z = ZIP a WITH INDEX", "zip"), ("z = ZIP a WITH b WITH c", "zip"), ("d = DIFFERENCE a BY x, b BY y", "difference"),
        ("s = SAMPLE a 0.1", "sample"), ("o = ORDER a BY x DESC, y", "order"), ("o = ORDER a BY * DESC", "order"), ("w = WINDOW a ROWS 100 SLIDE ROWS 10", "window"), ("w = WINDOW a RANGE 2 MINUTES SLIDE ROWS 5", "window"), ("r = RDFLOAD('f') GROUPED ON subject", "rdfload"),
        ("r = SOCKET_READ 'h:1' MODE ZMQ USING RDFStream() TIMESTAMP(x)", "socket_read"), ("SOCKET_WRITE a TO 'h:1' MODE ZMQ", "socket_write"), ("c = CACHE a MEMORY_AND_DISK_SER_2", "cache"), ("MATERIALIZE a", "materialize"), ("d = DELAY a BY ('1M30S', -4)", "delay"),
        ("VISUALIZE a BY g INTO 'f.png' WITH pointSize 3 AS (10, 20)", "visualize"), ("t = TUPLIFY a ON subject", "tuplify"), ("r = RSCRIPT a USING 'res <- $_'", "rscript"), ("s = STREAM a THROUGH f.g(1, 'x') AS (y: int)", "stream"), ("fs -rm -r /tmp/x", "fs"), ("SET a.b 3", "set"), ("REGISTER 'x.jar'", "register"),
        ("j = SPATIAL_JOIN a PARTITION BY GRID(partitionsPerDimension=4), b ON contains(g, h) USING INDEX RTREE(order=5)", "spatial_join"), ("p = PARTITION a ON g USING BSP(maxCost=3)", "partition"), ("i = INDEX a ON g USING RTREE(order=5)", "index"),
        ("m = MATCH_EVENT a PATTERN SEQ(A, OR(B, NEG(C)), AND(B, D)) WITH (A: x == 1, B: x > A.x, C: x == 2, D: y == 3) MODE first_match WITHIN 3 MINUTES", "match_event"), ("b = BGP_FILTER a BY { ?s 'p' ?o . ?o \"q\" ?z }", "bgp_filter"), ("DESCRIBE a", "describe"), ("DISPLAY a", "display"),
    ],
)
def test_statements(text, kind):
    assert one(text + ";").kind == kind


@pytest.mark.parametrize("text", ["a = LOAD ;", "a = FILTER b BY ;", "a = FOREACH b { c = LIMIT d 3; }", "DUMP", "a = JOIN b", "x y z", "a = ORDER b BY", "a = LOAD 'f' @", "d = DIFFERENCE a BY x, b"])
def test_errors_name_a_line(text):
    with pytest.raises(ScriptError, match="line 1"):
        parse(text)


def test_macros_get_names_of_their_own():
    plan = parse("DEFINE m(b, n) RETURNS r { t = FILTER $b BY x > $n; $r = LIMIT t 3; }; p = m(a, 1); q = m(a, 2);")
    out = rewrite.expand(plan, {}, iter(range(1, 9)).__next__)
    assert [s.out for s in out] == ["t__1", "p", "t__2", "q"] and out[2]["by"] == t.Compare(">", t.Name("x"), t.Lit(2)) and out[3].ins == ("t__2",)
    with pytest.raises(ScriptError, match="takes 2"):
        rewrite.expand(parse("DEFINE m(b, n) RETURNS r { $r = LIMIT $b 3; }; p = m(a);"), {}, int)
    with pytest.raises(ScriptError):
        rewrite.expand(parse("p = nothing(a);"), {}, int)


def test_preprocessing(tmp_path):
    (tmp_path / "inc.pig").write_text("b = FILTER a BY x > $lo;\n")
    text = prepared("%declare lo 5\n%default hi '7'\nIMPORT 'inc.pig';\nc = LIMIT b ${hi};", {"lo": "9"}, tmp_path)
    assert "x > 9" in text and "LIMIT b 7" in text and "declare" not in text
    with pytest.raises(ScriptError, match="no file"):
        prepared("IMPORT 'none.pig';", {}, tmp_path)
    (tmp_path / "p").write_text("# note\n\nk = v=1\n")
    assert parameter_file(str(tmp_path / "p")) == {"k": "v=1"}


PLAN = "a = LOAD 'f'; b = FILTER a BY $0 > 1; c = FILTER b BY $1 > 2; d = LIMIT c 9; e = LIMIT d 4; DUMP e;"


def test_rules():
    plan = rewrite.rewritten(parse(PLAN), rewrite.OPTIONAL)
    assert [s.kind for s in plan] == ["load", "filter", "limit", "dump"] and plan[2]["n"] == 4 and isinstance(plan[1]["by"], t.And)
    twice = parse("a = LOAD 'f'; b = FILTER a BY $0 > 1; c = FILTER b BY $1 > 2; DUMP b; DUMP c;")
    assert rewrite.rewritten(twice, rewrite.OPTIONAL) == twice
    sort = parse("a = LOAD 'f'; o = ORDER a BY $0; g = GROUP o BY $1; DUMP g;")
    assert [s.kind for s in rewrite.rewritten(sort, rewrite.OPTIONAL)] == ["load", "group", "dump"]
    with pytest.raises(ScriptError, match="come to an end"):
        rewrite.rewritten(parse(PLAN), [rewrite.to_replace("limit", lambda s: s.but(n=s["n"] + 1))])


def test_editing_and_walks():
    a, b, c, d, e, dump = plan = parse(PLAN)
    assert [s.out for s in rewrite.breadth_first(plan, a)] == ["a", "b", "c", "d", "e", ""] and [s.out for s in rewrite.depth_first(plan, c, down=False)] == ["c", "b", "a"]
    assert rewrite.sources(plan) == [a] and rewrite.sinks(plan) == [dump]
    assert rewrite.remove(plan, c)[2].ins == ("b",)
    new = parse("x = DISTINCT y;")[0]
    assert [s.out for s in rewrite.insert_after(plan, b, new)][:3] == ["a", "b", "x"] and rewrite.insert_between(plan, b, c, new)[3].ins == ("x",)
    swapped = rewrite.swap(plan, b, c)
    assert swapped[1]["by"] == c["by"] and swapped[2]["by"] == b["by"]
    assert rewrite.disconnect(plan, d, e)[4].ins == () and rewrite.replace(plan, d, new.but(ins=("c",)))[4].ins == ("x",)
    assert [s.out for s in rewrite.topological([dump, e, d, c, b, a])] == ["a", "b", "c", "d", "e", ""]
    assert "digraph" in rewrite.dot(plan) and "FILTER(a)" in rewrite.described(plan)
    dead = parse("a = LOAD 'f'; b = FILTER a BY $0 > 1; c = LIMIT a 2; DUMP c;")
    assert [s.out for s in rewrite.drop_dead(dead)] == ["a", "c", ""]
    with pytest.raises(ScriptError, match="twice"):
        rewrite.check(parse("a = LOAD 'f'; a = LOAD 'g';"))
    with pytest.raises(ScriptError, match="no bag"):
        rewrite.check(parse("b = LIMIT a 2;"))


def test_merging_rule_and_calls():
    rule = rewrite.to_merge("order", "limit", lambda o, l: t.Stmt("limit", "", (), {"n": l["n"], "sorted": True}))
    out = rewrite.rewritten(parse("a = LOAD 'f'; o = ORDER a BY $0; l = LIMIT o 3; DUMP l;"), [rule])
    assert [s.kind for s in out] == ["load", "limit", "dump"] and out[1]["sorted"] and out[1].ins == ("a",)
    s = one("b = FOREACH a GENERATE TOKENIZE(x);")
    assert rewrite.calls(s, "tokenize") and not rewrite.calls(s, "count")


def test_signatures_follow_what_is_computed():
    a, b = one("b = FILTER a BY x > 1;"), one("q = FILTER p BY x > 1;")
    assert t.signature(a, ["s"]) == t.signature(b, ["s"]) != t.signature(a, ["r"]) != t.signature(one("b = FILTER a BY x > 2;"), ["s"])

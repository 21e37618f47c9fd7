"""Eviction and advice, without Spark."""

import pytest

from weftline.materialize import POLICIES, Entry, OperatorGraph
from weftline.types import ScriptError


def entry(name, size, benefit=0.0, used=0.0):
    return Entry(name, name, size, benefit, used)


HAVE = [entry("a", 40, 1, 3), entry("b", 30, 9, 1), entry("c", 30, 5, 2)]


@pytest.mark.parametrize(
    "policy, new, gone",
    [("NONE", entry("n", 5), None), ("LRU", entry("n", 50), ["b", "c"]), ("LRU", entry("n", 101), None), ("KNAPSACK", entry("n", 40, 3), ["a"]), ("KNAPSACK", entry("n", 90, 1), None), ("KNAPSACK_RATIO", entry("n", 30, 4), ["a"])],
)
def test_policies(policy, new, gone):
    got = POLICIES[policy](HAVE, new, 100)
    assert (None if got is None else [e.signature for e in got]) == gone


def test_advice():
    g = OperatorGraph()
    for _ in range(3):
        g.ran("load", [], 2.0)
        g.ran("filter", ["load"], 1.0, 100)
    g.ran("load", [], 2.0)
    g.ran("group", ["load"], 5.0, 10)
    assert g.cost("filter") == 3.0 and g.cost("group") == 7.0 and g.probability("filter") == 0.75 and g.probability("group", "MIN") == 0.25
    assert g.choose(["filter", "group"]) == "group" and g.choose(["filter", "group"], "MARKOV") == "filter" and g.choose(["group", "filter"], "LAST") == "filter" and g.choose([]) is None
    with pytest.raises(ScriptError):
        g.choose(["group"], "NOPE")


def test_profiles_measure_what_ran(spark, tmp_path):
    from weftline.session import Session

    (tmp_path / "a").write_text("".join(f"{i}\n" for i in range(1000)))
    s = Session(spark, {"d": str(tmp_path)}, out=lambda *_: None, profile=True, store=str(tmp_path / "kept"))
    s.run("a = LOAD '$d/a' AS (v: int); b = FILTER a BY v > 899; c = FOREACH b GENERATE v, v * 2 AS w; x = FILTER a BY v < 0;")
    assert not s.graph.times  # nothing has run yet
    s.run("STORE c INTO '$d/out';")
    g, sig = s.graph, s.signatures
    assert g.sizes[sig["a"]] == 8000 and g.sizes[sig["b"]] == 800 and g.sizes[sig["c"]] == 1600 and sig["x"] not in g.times
    assert g.cost(sig["c"]) > g.cost(sig["b"]) > g.cost(sig["a"]) > 0 and len(s.statistics()) == 3
    s.run("MATERIALIZE b;")
    assert g.sizes[sig["b"]] == s._store.entries[sig["b"]].size

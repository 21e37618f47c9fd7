"""Event patterns: selection modes, conditions on earlier events, AND, OR, NEG and WITHIN; in tables and in streams."""

import pytest

from weftline.session import Session
from weftline.types import ScriptError

SAMPLE = [(1, 1), (2, 2), (1, 3), (2, 4), (3, 5), (1, 6), (2, 7), (3, 8)]
ABC = "WITH (A: c == 1, B: c == 2, C: c == 3)"


def found(spark, pattern, rows=SAMPLE, ordered=True):
    s = Session(spark, out=lambda *_: None)
    s.bind("e", spark.createDataFrame(rows, "c int, n int"))
    s.run(f"m = MATCH_EVENT e PATTERN {pattern}{' ORDER BY n' if ordered else ''};")
    return [tuple(r) for r in s.df("m").collect()]


def triples(rows):
    return sorted(tuple(n for _, n in rows[i : i + 3]) for i in range(0, len(rows), 3))


def test_modes(spark):
    assert found(spark, f"SEQ(A, B, C) {ABC} MODE first_match") == [(1, 1), (2, 2), (3, 5), (1, 6), (2, 7), (3, 8)]
    assert triples(found(spark, f"SEQ(A, B, C) {ABC}")) == [(1, 2, 5), (3, 4, 5), (6, 7, 8)]
    assert triples(found(spark, f"SEQ(A, B, C) {ABC} MODE contiguity")) == [(3, 4, 5), (6, 7, 8)]
    # All combinations in order, which a run that a row may pass by finds.
    brute = sorted((a, b, c) for x, a in SAMPLE for y, b in SAMPLE for z, c in SAMPLE if (x, y, z) == (1, 2, 3) and a < b < c)
    assert triples(found(spark, f"SEQ(A, B, C) {ABC} MODE skip_till_any_match")) == brute and len(brute) == 9
    assert triples(found(spark, f"SEQ(A, B, C) {ABC} MODE recent_match")) == [(1, 2, 5), (3, 4, 5), (6, 7, 8)]
    assert triples(found(spark, f"SEQ(A, B, C) {ABC} MODE cognitive_match"))[-1] == (6, 7, 8)


def test_conditions_on_earlier_events(spark):
    got = found(spark, "SEQ(A, B) WITH (A: c == 1, B: c == 3 AND n > A.n + 3) MODE skip_till_any_match")
    assert sorted(zip([n for _, n in got[::2]], [n for _, n in got[1::2]])) == [(1, 5), (1, 8), (3, 8)]


def test_and_or_neg(spark):
    assert sorted(found(spark, f"OR(B, C) {ABC}")) == sorted(x for x in SAMPLE if x[0] in (2, 3))
    assert found(spark, f"AND(A, C) {ABC} MODE first_match", [(3, 1), (2, 2), (1, 3)]) == [(3, 1), (1, 3)]
    assert found(spark, f"SEQ(A, NEG(B), C) {ABC}", [(1, 1), (2, 2), (1, 3), (3, 4)]) == [(1, 3), (3, 4)]
    assert found(spark, f"SEQ(A, NEG(B)) {ABC}", [(1, 1), (2, 2), (1, 3)]) == [(1, 3)]
    with pytest.raises(ScriptError, match="no event"):
        found(spark, "SEQ(A, D) WITH (A: c == 1)")


def test_within(spark):
    assert found(spark, f"SEQ(A, C) {ABC} MODE skip_till_any_match WITHIN 2 SECONDS") == [(1, 3), (3, 5), (1, 6), (3, 8)]


def test_empty_and_nulls(spark):
    assert found(spark, f"SEQ(A, B) {ABC}", [(None, 1), (1, 2), (None, 3), (2, 4)]) == [(1, 2), (2, 4)]
    assert found(spark, f"SEQ(A, B) {ABC}", [(None, None)]) == []


def test_streams_keep_runs_between_batches(spark, tmp_path):
    for i, line in enumerate(["1,1\n2,9\n", "2,2\n3,3\n"]):
        (tmp_path / f"{i}").write_text(line)
    s = Session(spark, {"d": str(tmp_path)}, out=lambda *_: None)
    s.run(f"e = LOAD '$d' USING PigStream(',') AS (c: int, n: int); m = MATCH_EVENT e PATTERN SEQ(A, C) {ABC}; STORE m INTO '{tmp_path}/../{tmp_path.name}-out';")
    got = [x for p in (tmp_path.parent / f"{tmp_path.name}-out").glob("part-*") for x in p.read_text().split()]
    assert sorted(got) == ["1,1", "3,3"]

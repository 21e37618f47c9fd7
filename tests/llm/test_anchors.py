"""Passages, phrases and words that many documents share, against brute force."""

import random

import numpy as np

from weftline.llm import anchors, substrings, suffixes

from .test_operators import brute_substrings, brute_suffixes, collected, prose


def crowd(seed=3, n=260):
    """A common phrase in ever new surroundings, some of which recur with differing lengths to its left and right."""
    r = random.Random(seed)
    phrase = "permission is hereby granted to all of them who ask for it"
    sides = [prose(r.randrange(40), 12) for _ in range(60)]
    rows = []
    for i in range(n):
        a, b = r.choice(sides), r.choice(sides)
        text = a[r.randrange(20) :] + " " + phrase + " " + b[: r.randrange(5, len(b))]
        if i % 9 == 0:
            text += " tail " + phrase + " " + r.choice(sides)
        rows.append((i * 3 + 1, text))
    return [*rows, (5000, None), (5001, ""), (5002, rows[4][1]), (5003, rows[4][1]), (5004, phrase * 40)]


def test_hot_anchors_go_by_their_windows(spark, monkeypatch):
    rows = crowd()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = brute_suffixes(rows), brute_substrings(rows)
    monkeypatch.setattr(anchors, "KINDS", 2)
    for hot in (2, 16, 64, 1 << 30):  # all, some and no anchors are hot: the same rows
        monkeypatch.setattr(anchors, "HOT", hot)
        got = [{k: tuple(x)[1:] for k, x in collected(m.digests(df)).items()} for m in (suffixes, substrings)]
        assert (got[0], got[1]) == want
    assert sum(x[1] for x in want[0].values()) > 1000 and sum(x[1] for x in want[1].values()) > 100


def test_more_chunks_than_partitions(spark, monkeypatch):
    rows = crowd(8, 120)
    monkeypatch.setattr(anchors, "PARTITIONS", 3)
    monkeypatch.setattr(anchors, "parts_for", lambda df, mb, least: 17)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {k: tuple(x)[1:] for k, x in collected(suffixes.digests(df)).items()} == brute_suffixes(rows)
    assert {k: tuple(x)[1:] for k, x in collected(substrings.digests(df)).items()} == brute_substrings(rows)


def test_words_with_equal_hashes_stay_apart(spark):
    # Differences of any polynomial modulo 2^64 vanish between a long Thue-Morse word and its complement.
    bits = [bin(i).count("1") & 1 for i in range(1 << 12)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    both = [np.frombuffer(w.encode(), np.uint8) for w in (one, other)]
    hashes = [int(substrings.word_hashes(d, np.array([0]), np.array([len(d)]))[0]) for d in both]
    assert hashes[0] == hashes[1]
    base = [f"w{i}" for i in range(24)]
    rows = [(i, " ".join([*base[:12], w, *base[12:]])) for i, w in enumerate((one, other, one))]
    got = {k: tuple(x)[1:] for k, x in collected(substrings.digests(spark.createDataFrame(rows, "doc_id bigint, text string"))).items()}
    assert got == brute_substrings(rows) and got[1][1] == 0 and got[2][1] == 25


def test_clashing_column_names(spark):
    from pyspark.sql import functions as F

    rows = crowd(9, 60)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *[F.lit(1).alias(c) for c in ("__anchor_chunk", "__ANCHOR_SHARD", "shard", "chunk", "blob")])
    for m in (suffixes, substrings):
        got = m.cleaned(df)
        assert got.columns == df.columns and got.count() == len(rows)


def test_windows_by_common_prefixes():
    r = random.Random(2)
    clips = sorted({(bytes(r.choice(b"ab") for _ in range(r.randint(3, 6))) and b"GRAM" + bytes(r.choice(b"ab") for _ in range(r.randint(2, 6))), bytes(r.choice(b"ab") for _ in range(r.randint(0, 6)))) for _ in range(300)})
    clips = [(right, left) for right, left in clips if len(right) + len(left) >= 10]
    places = [anchors.Run(*[np.zeros(0, np.uint32)] * 3, b"", b"", None, np.array([r.randrange(1000)]), None, None) for _ in clips]
    before, group = b"", []
    for (right, left), run in zip(clips, places):
        group.append((anchors.shared_prefix(before, right), right, (left, 0, run, 0, 1)))
        before = right
    # Windows of 10 bytes hold the 4 bytes of the anchor; clips are cut so that each window does.
    group = [(s, right[: 10], (left[max(0, len(left) - 6) :], *rest)) for s, right, (left, *rest) in group]
    least = {}
    for _, right, (left, _, run, *_) in group:
        clip = left + right
        for i in range(len(clip) - 9):
            least[clip[i : i + 10]] = min(least.get(clip[i : i + 10], 9999), int(run.keys[0]))
    got = suffixes.earliest(group, 10, 4)
    for found, (_, right, (left, *_)) in zip(got, group):
        clip = left + right
        assert found == [least[clip[i : i + 10]] for i in range(len(clip) - 9)]


def test_messages_without_frames():
    for parts in ([], [b""], [b"abc", b"", b"x" * 1000]):
        assert anchors.parted(anchors.joined(*parts)) == parts
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 48, 500, np.uint64))
    assert (anchors._unplaned(anchors._planes(h)) == h).all()

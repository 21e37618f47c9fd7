"""Hostile inputs: null ids beside large ones, texts and pages of a megabyte that invite quadratic scans, numbers without end."""

import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers

from weftline.llm import embeddings, html, packing, pii

#: The four patterns as their contract states them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and not all(int(p) <= 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                odd = sum(int(d) for d in digits[-1::-2])
                even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
                if not 16 <= len(digits) <= 19 or (odd + even) % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_are_the_patterns():
    r = random.Random(11)
    texts = []
    for _ in range(6000):
        pool = r.choice(["0123456789. ", "0123456789 -", "+0123456789().- ", "ab@.-%_1 ", "0123+.@a- ()", "25.0 "])
        texts.append("".join(r.choice(pool) for _ in range(r.randint(0, 60))))
    for _ in range(300):  # numbers that pass Luhn, with separators, inside longer ones
        d = [r.randrange(10) for _ in range(r.randint(15, 18))]
        d.append(next(x for x in range(10) if pii.luhn("".join(map(str, [*d, x])))))
        texts.append(r.choice(["", "x", "1 "]) + r.choice(["", " ", "-"]).join(map(str, d)) + r.choice(["", " 1", "-", "a"]))
    hits = set()
    for t in texts:
        want = brute_spans(t)
        hits |= {k for k, _, _ in want}
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)] == want, t
    assert hits == set(PATTERNS)


def test_pii_columns_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.scan(docs).collect():
        want = brute_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in want) for kind in PATTERNS)
        order = sorted(want, key=lambda s: (list(PATTERNS).index(s[0]), s[1]))
        listed = [f"{k}:{a}:{b}" for k, a, b in order]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(r.spans.split(","))


def test_pii_in_linear_time():
    crf = pii.model()
    long = {"0" * 5000 + ".1.1.1": 1, "1" * 1_000_000: 0, "1." * 500_000: 125_000, "a@" * 100_000: 0, "+1" * 100_000: 0, "12 34 " * 100_000: 0, "+1 (555) 555-1234 " * 50_000: 50_000, "x" * 1_000_000 + " 1": 0, "x1" * 100_000: 0}
    for text, n in long.items():
        at = time.perf_counter()
        base, more = pii.find([text], crf)[0]
        assert len(base) == n and time.perf_counter() - at < 20, text[:20]
        assert len(set(more)) == len(more)


def test_spans_at_the_seams_of_long_windows():
    # Triggers follow each other without a gap for far longer than a window may grow.
    crf = pii.model()
    text = "tel. 0171 234 5678 and " * 2000
    _, more = pii.find([text], crf)[0]
    found = {(a, b) for k, a, b in more if k == 3}
    assert len(found) >= 1900 and all(text[a:b] == "0171 234 5678" for a, b in found)


def test_packing_keeps_large_ids_beside_null(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, "one two"), (None, "three"), (None, None), (big + 2, "")], "doc_id bigint, text string")
    got = packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 0, big, big + 2]
    assert len({(r.sequence_id, r.offset) for r in got}) == 4


def test_embeddings_with_null_ids(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (big, [1.0, 0.01], 1), (big + 2, [1.0, 0.02], 1)], "vec_id bigint, embedding array<float>, label int")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in embeddings.links(df).collect())
    assert got == [(0, 0, None, True), (0, 0, None, True), (big, 1, big, True), (big + 2, 1, big, False)]


def test_embeddings_in_many_small_intervals(spark, monkeypatch):
    """Several levels of intervals, labels and lengths side by side, against all pairs."""
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "FAN", 2)
    monkeypatch.setattr(embeddings, "GUESTS", 3)
    r = np.random.default_rng(8)
    centres = r.normal(size=(12, 6))
    rows = []
    for i in range(900):
        v = centres[i % 12] + r.normal(size=6) * r.choice([0.03, 0.3])
        rows.append((i, (v if i % 50 else v[:5]).tolist(), int(r.integers(0, 3))))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {x.vec_id: x for x in embeddings.links(df).collect()}
    links = {i: set() for i in range(900)}
    for size in (5, 6):
        at = [i for i, v, _ in rows if len(v) == size]
        x = np.array([rows[i][1] for i in at])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        label = np.array([rows[i][2] for i in at])
        for p, q in zip(*np.nonzero((x @ x.T >= 0.98) & (label[:, None] == label[None]))):
            if p != q:
                links[at[p]].add(at[q])
    least = {}
    for i in range(900):
        if i not in least:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in least:
                    least[k] = i
                    todo += links[k]
    assert sum(map(len, links.values())) > 1000
    assert all(got[i].n_links == len(links[i]) and got[i].component_id == least[i] for i in range(900))


def test_html_in_linear_time():
    crf = html.model()
    pages = [
        "<a " * 340_000, "<a " * 340_000 + ">", "<div>" * 200_000 + "x", "<div>x" * 100_000, '<p x="' * 150_000 + ">", '<p x=">" ' * 100_000, "<p x='>\"'>\"<" * 50_000, "<ul><li>x" * 60_000, "<template>" + "<div>" * 50_000,
        "<span>" * 60_000 + "<div>" * 60_000 + "</span>" * 60_000, "<" * 1_000_000, "<select>" * 100_000, "<svg>" * 100_000 + "<p>x", "<b>x</p>" * 80_000, "&#" + "1" * 100_000 + ";", '<div class="' + "a b c " * 50_000 + '">x',
    ]
    for page in pages:
        at = time.perf_counter()
        html.texts([page], crf)
        assert time.perf_counter() - at < 20, page[:20]


def test_html_tags_and_references():
    texts = lambda page: [b.text for b in html.blocks(page)]
    assert texts('<a href="x>y" title=it\'s>Z</a><p title="a>b">q') == ["Z", "q"]
    assert texts("a < b and c <d") == ["a < b and c <d"]
    assert texts("<p>&#0000065;&#x41;&#99999999999;&amp;") == ["AA�&"]
    assert texts("<ul><li>a</ul><svg><text>no</text></svg><p>b") == ["a", "b"]
    deep = "<div>" * 600 + "in" + "</div>" * 600 + "<p>out"
    assert texts(deep) == ["in", "out"]


def test_crowded_shards_meet_in_blocks(spark, monkeypatch):
    """A dense cluster of fingerprints that no radius cuts, beside scattered ones, in many small shards."""
    from pyspark.sql import functions as F

    from weftline.llm import simhash

    monkeypatch.setattr(simhash, "SHARD", 40)
    monkeypatch.setattr(simhash, "SAMPLE_EACH", 20)
    monkeypatch.setattr(simhash, "CROWDED", 2)
    r = np.random.default_rng(4)
    dense = np.unique(np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 14, (900, 6)).astype(np.uint64), axis=1))
    fps = np.unique(np.concatenate([dense, r.integers(0, 1 << 64, 600, np.uint64)]))
    ids = r.permutation(len(fps)) + 7
    table = spark.createDataFrame([(int(i), int(f)) for i, f in zip(ids, fps.view(np.int64))], "doc_id bigint, fp bigint")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, key, text, shingle: table)
    got = {x.doc_id: x.component_id for x in simhash.groups(table.withColumn("text", F.lit(""))).collect()}
    close = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    least = ids.astype(np.int64).copy()
    while True:
        new = np.array([least[row].min() for row in close])
        if (new == least).all():
            break
        least = new
    assert got == {int(i): int(k) for i, k in zip(ids, least)} and len(set(got.values())) < len(fps)


def test_radii_where_few_lie():
    from weftline.llm import simhash

    r = np.random.default_rng(6)
    x = r.integers(0, 1 << 64, 60_000, np.uint64)
    tree = simhash.build(x[:3000], 50, 3, random.Random(2))
    at, shard = simhash.leaves(tree, x, 3)
    # Shards of 1,000 that hold copies: not more of these than the power says, and no shard much larger than others.
    sizes = np.bincount(shard)
    assert len(at) < 60**0.62 * len(x) and sizes.max() < 4000 and len(np.unique(np.concatenate([at, np.arange(len(x))]))) == len(x)


def test_documents_named_like_the_operators_columns(spark):
    from pyspark.sql import functions as F

    from weftline.llm import simhash

    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None)], "doc_id bigint, text string").withColumn("__gone", F.lit(2)).withColumn("__GONE_", F.lit(3))
    left = simhash.representatives(df)
    assert left.columns == df.columns and sorted(x.doc_id for x in left.collect()) == [1, 3]


def test_windows_whose_hashes_collide(spark, monkeypatch):
    from weftline.llm import quality

    from .test_operators import brute_counts

    monkeypatch.setattr(quality, "WINDOW_HASH", "shiftleft(pmod(length(x), 2), 40)")
    r = random.Random(3)
    texts = [" ".join(r.choice(["a", "b", "cc", "dd", "e"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 7, 30, 60, 200)]
    got = quality.counts(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")).collect()
    assert {x.doc_id: x.n_repeat_words for x in got} == {i: brute_counts(t)[4] for i, t in enumerate(texts)}


def test_licence_inheritance_by_brute_force(spark):
    from weftline.llm import licences

    r = random.Random(12)
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "nothing here", "", None, "just words and words\nLicensed under CC BY 4.0"]
    rows = []
    for i in range(400):
        depth = r.randint(0, 5)
        folder = "/".join(r.choice("abc") for _ in range(depth))
        name = r.choice(["LICENSE", "COPYING", "x.py", "y.md", "z"]) if r.random() < 0.5 else f"f{i}"
        path = None if i % 40 == 0 else f"{folder}/{name}" if folder else name
        rows.append((i if i % 7 else None, path, r.choice(lines)))
    rows += rows[:5]
    got = licences.scan(spark.createDataFrame(rows, "doc_id bigint, p string, text string"), "p").collect()
    assert sorted(map(repr, ((x.doc_id, x.path) for x in got))) == sorted(map(repr, ((i, p) for i, p, _ in rows)))
    folder_of = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    stated = {}
    for x in got:
        if x.path is not None and x.is_licence_file:
            stated.setdefault(folder_of(x.path), []).append(x.own_licence)
    stated = {d: min(set(v), key=lambda n: (-v.count(n), n)) for d, v in stated.items()}
    inherited = 0
    for x in got:
        want, origin = x.own_licence, None
        if want is None and x.path is not None:
            d = folder_of(x.path)
            while True:
                if d in stated:
                    want, origin = stated[d], d
                    break
                if not d:
                    break
                d = folder_of(d)
        assert (x.licence, x.inherited_from) == (want, origin), x
        inherited += origin is not None
    assert inherited > 50 and len(stated) > 10

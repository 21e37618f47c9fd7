"""Each corpus operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm import anchors, bpe, embeddings, html, licences, packing, pii, quality, simhash, substrings, suffixes
from weftline.llm.components import components
from weftline.llm.crf import Crf
from weftline.llm.labelled_pages import labelled_pages

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that operators use inside, as a table might have them too.
CLASHES = ["_t", "_lang", "fp", "rep", "chunk", "shard", "_group", "start", "length", "kept", "text2", "row", "units", "component_id"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and", "th", "ing", "er", "tion", "ble", "an", "éà", "ha"]) + r.choice(["", "ea", "on", "st", "nd", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    shared = prose(1, 80)
    texts = [
        prose(2, 120) + " " + shared, None, "", " \t\n ", shared + " tail", prose(2, 120) + " " + shared, shared, "x" * 300, "x" * 49, "ab " * 200, prose(5, 300), prose(5, 300) + " end", prose(6, 20000),
        "mail a.b@c.example.com or 10.0.0.1 and +1 (555) 555-1234, card 4111 1111 1111 1111.", "Licensed under CC BY-NC 4.0.", "日本語 テスト 🙂 " * 30, "line\nline\nline\nother", "<|endoftext|> and <|startoftext|>",
    ]
    return [(10 * i + 3, t, ["en", "fr", None, "xx"][i % 4], "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def brute_suffixes(rows):
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    first, out = {}, {}
    for i, t in sorted(texts.items()):
        for j in range(len(t) - 49):
            first.setdefault(t[j : j + 50], i)
    for i, t in texts.items():
        cover = bytearray(len(t))
        for j in range(len(t) - 49):
            if first[t[j : j + 50]] < i:
                cover[j : j + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(t, cover) if not m)
        out[i] = (len(t), sum(cover), len(re.findall(rb"\x01+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    return out


def brute_substrings(rows):
    seen, out = set(), {}
    for i, t in sorted((i, t or "") for i, t, *_ in rows):
        w = WORD.findall(t)
        cover = bytearray(len(w))
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            if k in seen:
                cover[j : j + 20] = b"\1" * 20
            seen.add(k)
        out[i] = (len(w), sum(cover), hashlib.sha256(" ".join(x for x, m in zip(w, cover) if not m).encode()).hexdigest())
    return out


def test_suffixes(docs, none, rows):
    got = {k: tuple(r)[1:] for k, r in collected(suffixes.digests(docs)).items()}
    assert got == brute_suffixes(rows)
    assert suffixes.digests(none).count() == 0
    clean = collected(suffixes.cleaned(docs))
    assert clean[13]["text"] is None and clean[53]["text"] != rows[5][1] and set(docs.columns) == set(suffixes.cleaned(docs).columns)


def test_suffixes_of_equal_and_null_ids(spark):
    t = prose(9, 60)
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t + " more")], "doc_id bigint, text string")
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_removed) for r in suffixes.digests(df).collect())
    n = len(t.encode())
    assert got == [(1, 0), (1, 0), (2, n), (99, n)]


def test_substrings(docs, none, rows):
    got = {k: tuple(r)[1:] for k, r in collected(substrings.digests(docs)).items()}
    assert got == brute_substrings(rows)
    assert substrings.digests(none).count() == 0
    assert collected(substrings.cleaned(docs))[13]["text"] is None


def test_windows_over_random_texts(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 90)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {k: tuple(x)[1:] for k, x in collected(suffixes.digests(df)).items()} == brute_suffixes(rows)
    assert {k: tuple(x)[1:] for k, x in collected(substrings.digests(df)).items()} == brute_substrings(rows)


def test_loser_tree_merges_and_knows_prefixes():
    r = random.Random(1)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 30))) for _ in range(7)]

    def coded(run):
        before = b""
        for s in run:
            yield anchors.shared_prefix(before, s), s, None
            before = s

    got = list(suffixes.LoserTree([iter(coded(x)) for x in runs]))
    assert [s for _, s, _ in got] == sorted(s for x in runs for s in x)
    for (_, a, _), (k, b, _) in zip(got, got[1:]):
        assert k == anchors.shared_prefix(a, b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=5), st.lists(st.integers(0, 2), max_size=12))
def test_suffix_automaton(known, text):
    a = substrings.SuffixAutomaton()
    for s in known:
        a.add(s)
    subs = {tuple(s[i:j]) for s in known for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    want = [max([n for n in range(e + 2) if tuple(text[e + 1 - n : e + 1]) in subs or n == 0]) for e in range(len(text))]
    assert a.statistics(text) == want


def test_clips_cover_each_window_once():
    raw = np.random.default_rng(3).integers(0, 4, 5000).astype(np.uint8)
    ends = np.array([0, 10, 700, 700, 5000])
    p, first, end, _, row, _ = anchors.clips(lambda a, b: anchors.BYTE_HASH[raw[a:b]], ends, 50, 24)
    windows = sorted(w for a, b in zip(first, end) for w in range(a, b))
    assert windows == [*range(10, 651), *range(700, 4951)]
    assert all(b - 1 <= q <= a + 26 for q, a, b in zip(p, first, end)) and set(row) == {2, 4}


def test_packing(docs, none, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in rows}
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(sequences) <= total // 4096 + 1 + 4  # a last, partly filled one in each of 4 groups
    assert packing.pack(none, path).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=60))
def test_tournament_tree_is_first_fit(sizes):
    bins, offsets = packing.first_fit_decreasing(np.array(sizes), 20)
    room = []
    want = {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((k for k, r in enumerate(room) if r >= sizes[i]), None)
        if b is None:
            room.append(20)
            b = len(room) - 1
        want[i] = (b, 20 - room[b])
        room[b] -= sizes[i]
    assert [want[i] for i in range(len(sizes))] == list(zip(bins.tolist(), offsets.tolist()))


def test_bpe(docs, none, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = collected(bpe.digests(docs, path))
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(none, path).count() == 0
    assert collected(bpe.roundtrip(docs, path))[rows[0][0]].decoded == rows[0][1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab E\n\t'sté1½🙂　.,\x1c\x85\xa0हि̈st"), max_size=80))
def test_bpe_like_the_library(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    codec = bpe.codec(path)
    ids = codec.encode_batch([text])[0]
    assert ids.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids if len(text) < 2 else True
    assert codec.decode(ids) == text


@pytest.fixture(scope="module")
def byte_bpe():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.codec(path), Tokenizer.from_file(path)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab E\n\t'sté1½🙂　.,\x1c\x85\xa0हि̈st<|>_\r\u200b'vRLdmCjK") | st.characters(codec="utf-8"), max_size=80))
def test_bpe_ids_of_every_text_like_the_library(byte_bpe, text):
    codec, library = byte_bpe
    ids = codec.encode_batch([text])[0]
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == text


def brute_fingerprint(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    for i in range(n):
        while root[i] != root[root[i]]:
            root[i] = root[root[i]]
    return root


def test_simhash(docs, none, rows):
    got = collected(simhash.groups(docs))
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    root = grouped(len(rows), [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3])
    for (i, *_), fp, k in zip(rows, fps, root):
        assert got[i].fingerprint == f"{fp:016x}" and got[i].component_id == rows[k][0]
    assert simhash.groups(none).count() == 0
    left = {r.doc_id for r in simhash.representatives(docs).collect()}
    assert left == {i for (i, *_), k in zip(rows, root) if rows[k][0] == i}


def test_vantage_point_search_is_exact():
    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(0, 1 << 64, 1500, np.uint64))
    near = np.unique(np.concatenate([x, *[x[:300] ^ np.uint64(1 << int(b)) for b in rng.integers(0, 64, 4)]]))
    tree = simhash.build(near[::5], 30, 3, random.Random(1))
    assert tree is not None
    at, leaf = simhash.leaves(tree, near, 3)
    pairs = set()
    for k in np.unique(leaf):
        own = at[leaf == k]
        pairs |= {tuple(sorted((int(own[a]), int(own[b])))) for a, b in simhash.stars(near[own], 3)}
    want = [(i, int(j)) for i in range(len(near)) for j in np.flatnonzero(np.bitwise_count(near[i + 1 :] ^ near[i]) <= 3) + i + 1]
    assert grouped(len(near), pairs) == grouped(len(near), want)


def test_dense_cluster_links(spark):
    x = np.array([a | b for a in range(64) for b in (0, 1 << 60)], np.uint64)
    assert len({r for _, r in simhash.stars(x, 3)}) == 1


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1200)]
    got = {x.id: x.component_id for x in components(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(4)).collect()}
    root = grouped(1201, pairs)
    assert got == {i: k for i, k in enumerate(root) if i != k}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(30, 8))
    rows = []
    for i in range(200):
        v = base[i % 30] + r.normal(size=8) * (0.02 + 0.2 * (i % 5 == 0))
        rows.append((i, v.tolist(), int(i % 3)))
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1002, None, 0), (1003, [0.0] * 8, 0), (1004, [float("nan")] * 8, 0), (1005, rows[0][1], None), (1006, [None] * 8, 0), (1007, [], 0), (1008, rows[0][1][:4], 0), (1009, [x * 3 for x in rows[0][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = collected(embeddings.links(df), "vec_id")
    exact = {r.vec_id: r.embedding for r in df.collect()}
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    pairs = []
    for i, (a, _, la) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b, lb = rows[j][0], rows[j][2]
            v, w = exact[a], exact[b]
            if la is not None and la == lb and ok(v) and ok(w) and len(v) == len(w):
                v, w = np.array(v, float), np.array(w, float)
                if v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                    pairs.append((i, j))
    count = Counter(x for p in pairs for x in p)
    root = grouped(len(rows), pairs)
    for i, (k, *_) in enumerate(rows):
        assert got[k].n_links == count[i] and got[k].component_id == rows[root[i]][0] and got[k].kept == (root[i] == i)
    assert embeddings.links(df.where("false")).count() == 0


def test_embeddings_in_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 20)
    r = np.random.default_rng(2)
    rows = [(i, (np.array([1.0, 1, 1, 1]) + r.normal(size=4) * 0.15).tolist(), 1) for i in range(150)]
    got = collected(embeddings.links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")), "vec_id")
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.98).sum(axis=1) - 1
    assert [got[i].n_links for i in range(150)] == linked.tolist()


def brute_counts(text):
    t = text or ""
    w = WORD.findall(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    rep = {p for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


def test_quality(docs, none, rows):
    got = collected(quality.score(docs))
    for i, t, *_ in rows:
        n = brute_counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.kept and r.base_failed)
    assert quality.score(none).count() == 0
    kept = quality.sound(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_quality_of_rare_scripts(spark, monkeypatch):
    rng = random.Random(3)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n)) + "."
    latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщэюя"
    rows = [(i, make(latin, 1200), "pt") for i in range(60)] + [(60 + i, make(cyrillic, 1200), "ru") for i in range(4)]
    rows += [(90, make("#%$&", 400), "ru"), (91, make("#%$&", 400), "xx"), (92, None, None), (93, make(latin, 400), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert not {r.doc_id for r in quality.sound(docs).collect()} & set(range(60, 64))
    want = set(range(64)) | {91, 93}  # 91 is all there is of its language, below the least reference
    assert {r.doc_id for r in quality.sound(docs, own_references=True).collect()} == want
    assert {r.doc_id for r in quality.score(docs, own_references=True).collect() if r.kept} == want
    monkeypatch.setattr(quality, "BROADCAST_LANGUAGES", 1)
    assert {r.doc_id for r in quality.sound(docs, own_references=True).collect()} == want
    monkeypatch.setattr(quality, "MIN_REFERENCE", 0)
    assert {r.doc_id for r in quality.sound(docs, own_references=True).collect()} == want, "a text is near a reference of its own"
    assert quality.sound(docs.limit(0), own_references=True).count() == 0


def test_quality_separates_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    scored = quality.score(spark.read.parquet(f"{d}/documents.parquet"))
    rows = scored.where("NOT base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c.py", "# nothing"), (3, "a/b/d/e.py", "# Released under the MIT License.\n" + prose(1, 40)), (4, "x/y", None),
        (5, None, "All rights reserved."), (6, "a/b/d/f.py", ""), (7, "q/COPYING", "This work is licensed under the GNU General Public License, version 3."), (8, "q/r/s/t", "text"), (8, "q/r/s/t", "text"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, p string, text string")
    got = collected(licences.scan(df, "p"))
    assert {i: r.licence for i, r in got.items()} == {1: "Apache-2.0", 2: "Apache-2.0", 3: "MIT", 4: None, 5: "Proprietary", 6: "Apache-2.0", 7: "GPL-3.0", 8: "GPL-3.0"}
    assert got[8].inherited_from == "q" and got[3].inherited_from is None and licences.scan(df, "p").count() == len(rows)
    assert licences.scan(df.where("false"), "p").count() == 0


def test_licence_cosine_by_hand(spark):
    lines = {"Released under the MIT License.": None, "the license of this is released": None, "Licensed under CC BY-NC 4.0": None, "license zulu zulu yankee": None, "zulu license for yankee use": None, "license of xray, zulu": None}
    df = spark.createDataFrame([(i, f"d/{i}", t) for i, t in enumerate(lines)], "doc_id bigint, p string, text string")
    got = collected(licences.scan(df, "p", min_cosine=0.0))
    words = lambda s: re.findall(licences.WORD, s.lower())
    from pyspark.sql import functions as F

    cut = df.select("doc_id", licences._cuts(F.array("text"), F.array(F.lit(True))).alias("c")).collect()
    plain = [" ".join(words(x)) for x in lines]
    units = {r.doc_id: [plain[r.doc_id], *dict.fromkeys(x for x in r.c if x != plain[r.doc_id])] for r in cut}
    notices = [(n, w) for n, ws in licences.TEMPLATES.items() for w in ws]
    n = len(notices) + sum(map(len, units.values()))
    df_of = Counter(w for _, x in notices for w in set(words(x)))
    df_of.update(w for us in units.values() for u in us for w in set(words(u)))
    assert df_of["zulu"] == 3 and df_of["yankee"] == 2 and df_of["xray"] == 1
    idf = lambda w: np.log(n + 1.0) - np.log(df_of[w] + 1.0) + 1.0
    vector = lambda t: {w: c * idf(w) for w, c in Counter(words(t)).items()}
    norm = lambda v: np.sqrt(sum(x * x for x in v.values()))
    cosine = lambda t: max(sum(v[w] * x for w, x in u.items() if w in v) / norm(v) / norm(u) for v in [vector(t)] for u in (vector(s) for _, s in notices))
    for i in units:
        best = max(c for k, u in enumerate(units[i]) for c in [cosine(u)] if not k or c >= licences.CUT_COSINE)
        assert abs(got[i].cosine - best) < 1e-8


def test_whole_licences_and_cut_notices(spark):
    from pathlib import Path

    folder = Path(licences.__file__).parent / "licence_texts"
    rows, want = [], {}

    def add(path, text, licence):
        rows.append((len(rows), path, text))
        want[len(rows) - 1] = licence

    for f in sorted(folder.iterdir()):
        name = f.name.removesuffix(".txt")
        text = f.read_text()
        add(f"{name}/LICENSE", "Copyright (c) 2011 Ann Example <ann@example.org> and others\n\n" + text, name)
        add(f"{name}/main.c", "int x;", name)
        add(f"as/{name}/other.txt", "\n".join(" * " + x for x in text.split("\n")), name)
        add(f"one/{name}/COPYING.md", " ".join(text.split()), name)
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version.".split("\n")
    add("h/a.c", "/*\n" + "\n".join(" * " + x.format(3) for x in gpl) + "\n */\n" + prose(3, 400), "GPL-3.0")
    mit = "Permission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files (the \"Software\"),\nto deal in the Software without restriction, including without limitation"
    add("h/b.c", "// Copyright 2020 Foo Inc. All rights reserved.\n" + "\n".join("// " + x for x in mit.split("\n")) + "\n" + prose(4, 400), "MIT")
    add("h/c.md", prose(5, 200) + " Released under the MIT License. " + prose(6, 200), "MIT")
    add("h/d.md", "Parsekit " + prose(5, 60) + " and is licensed under the Apache License, Version 2.0; see there. " + prose(6, 60), "Apache-2.0")
    add("h/e.c", "See the License for the specific language governing permissions\n" + prose(7, 100), None)
    add("k/a.txt", "the license\n" + "wordy " * 50_000 + "\n" + "a-" * 50_000, None)
    # Many other units, which must not lower the cosine of any file.
    for i in range(3000):
        rows.append((len(rows), f"z{i}/f", f"Licensed under terms {i} of vendor{i} {prose(i, 5)}"))
    got = collected(licences.scan(spark.createDataFrame(rows, "doc_id bigint, p string, text string"), "p"))
    assert {i: got[i].licence for i in want} == want
    assert all(got[i].is_licence_file for i in want if "LICENSE" in rows[i][1] or "other.txt" in rows[i][1])


def test_pii(docs, none, rows):
    got = collected(pii.scan(docs))
    text = rows[13][1]
    r = got[rows[13][0]]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert {text[int(a) : int(b)] for _, a, b in (s.split(":") for s in r.spans.split(","))} >= {"a.b@c.example.com", "10.0.0.1"}
    assert got[13].spans == "" and got[13].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.scan(none).count() == 0
    clean = collected(pii.redact(docs))
    assert clean[13]["text"] is None and "<EMAIL>" in clean[rows[13][0]]["text"] and clean[rows[0][0]]["text"] == rows[0][1]


def test_email_scan_is_the_pattern():
    r = random.Random(3)
    for _ in range(3000):
        t = "".join(r.choice("ab@.-% ") for _ in range(14))
        assert list(pii._emails(t)) == [m.span() for m in pii._EMAIL.finditer(t)]


def test_pii_crf_on_held_out_lines():
    table = pii.labelled_table(200, seed=99)
    right = wrong = missed = 0
    for (_, spans), (base, more) in zip(table, pii.find([t for t, _ in table], pii.model())):
        found, want = {*base, *more}, set(spans)
        right, wrong, missed = right + len(found & want), wrong + len(found - want), missed + len(want - found)
    assert right / (right + wrong) > 0.93 and right / (right + missed) > 0.93


def test_html_on_held_out_pages():
    crf = html.model()
    pages = labelled_pages(120, seed=77)
    got = html.texts([p for p, _ in pages], crf)
    blocks = [(set(g.split("\n")), set(k)) for g, (_, k) in zip(got, pages)]
    right = sum(len(a & b) for a, b in blocks)
    assert right / sum(len(a) for a, _ in blocks) > 0.97 and right / sum(len(b) for _, b in blocks) > 0.97


def test_html_edges(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><div class=ad>Buy now.</div><article><h1>A &amp; b</h1><p><b>One  two<br>three.<p>Next\n line &eacute;.</article><footer>&copy; us</footer>"
    df = spark.createDataFrame([(1, "u", page, 1), (2, "v", None, 1), (3, "w", "", 1), (4, "x", "<p", 1), (5, "y", "<script>var a='<p>no</p>'</script>", 1), (1, "u", page, 1)], "page_id bigint, url string, html string, text int")
    got = html.extract(df).collect()
    assert len(got) == 6
    by = {r.page_id: r for r in got}
    assert by[1].text == "A & b\nOne two three.\nNext line é." and by[1].n_chars == len(by[1].text)
    assert by[2].text == by[3].text == by[5].text == "" and by[2].n_chars == 0
    assert html.extract(df.where("false")).count() == 0


def test_html_goes_on_after_ignored_elements():
    main = "<article><h1>A title</h1><p>First of the text.</p><p>Second of the text.</p></article>"
    want = ["A title", "First of the text.", "Second of the text."]
    for before in (
        '<svg viewBox="0 0 1 1"/>', '<div><svg class="i" /></div>', "<math/>", "<div><select><option>a<option>b</div>", "<select><option>a<option>b", "<object data=x>", "<div><object data=x></div>",
        "<svg><path d='M0'>", "<svg><g><svg><text>in</text></svg><text>out</text></g></svg>", "<object data=a><object data=b>in</object>out</object>", "<div><select><div><option>a</div></select></div>", "<template><p>t<template>u</template>v</template>",
        "<svg><foreignObject><p>no</p></foreignObject></svg>", "<svg><script href=x /><title>t</title></svg>", "<noscript><p>no</p></noscript>", "<template>", "<noscript>", "<select/>",
    ):
        for after in ("", "<svg><text>x</text></svg>", "<div><select><option>a</select></div>", "</select></svg></math>"):
            got = [b.text for b in html.blocks(f"<html><body>{before}{main}{after}</body></html>")]
            assert got == want, (before, after)
    # Text in divisions alone, behind a select, a noscript and an object without ends.
    for before in ("<select><option>a", "<div><noscript>", "<object>"):
        assert [b.text for b in html.blocks(f"<body>{before}<div>The text.</div></div></body><div><object>o</object><select><option>b</select></div>")] == ["The text."]
    assert [b.text for b in html.blocks("<p>One <svg><text>x</text></svg>two <noscript><p>no</p></noscript>three")] == ["One two three"]
    assert html.blocks("<p>a<script/>b") != [] and [b.text for b in html.blocks("<p>a<script>b")] == ["a"]


def test_html_on_the_tables_template():
    import pyarrow.parquet as pq
    from html import unescape

    crf = html.model()
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    for page, got in zip(pages, html.texts(pages, crf)):
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</h1>|</p>|<p>", body)]
        assert got == "\n".join(p for p in parts if p)


def test_crf_finds_the_best_sequence():
    crf = Crf.train([[["x"], ["y"], ["x"]], [["y"], ["y"]]], [["a", "b", "a"], ["b", "b"]], ["a", "b"], steps=30)
    import itertools

    for seq in ([["x"], ["x"], ["y"], ["z"]], [["y"]], [["z"], ["y"], ["x"]]):
        weight = lambda labels, s=seq: crf.starts[labels[0]] + sum(crf.weights[crf.names.get(f, len(crf.names)), labels[t]] for t, fs in enumerate(s) for f in fs) + sum(crf.moves[a, b] for a, b in zip(labels, labels[1:]))
        best = max(itertools.product((0, 1), repeat=len(seq)), key=weight)
        assert crf.decode([seq])[0] == [crf.labels[i] for i in best]
    assert crf.decode([[], [["x"]]])[0] == []

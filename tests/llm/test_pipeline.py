"""The pipeline's stages against brute force, each on what its predecessor left."""

import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from weftline.llm import pii
from weftline.llm.common import table, written

from .test_operators import brute_fingerprint, grouped

SF = "/root/testdata/sf0.001"


def without_passages(texts):
    """Texts without the bytes of 50-byte strings that a smaller document holds; a character that is cut in two goes whole."""
    raw = {i: (t or "").encode() for i, t in texts.items()}
    first, out = {}, {}
    for i, t in sorted(raw.items()):
        for j in range(len(t) - 49):
            first.setdefault(t[j : j + 50], i)
    for i, t in raw.items():
        keep = bytearray(b"\1" * len(t))
        for j in range(len(t) - 49):
            if first[t[j : j + 50]] < i:
                keep[j : j + 50] = bytes(50)
        out[i] = None if texts[i] is None else bytes(c for c, k in zip(t, keep) if k).decode("utf-8", "ignore")
    return out


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        after = docs.collect()
        if name != "packed_sequences":
            assert docs.columns == columns
        seen[name] = (before, after)
        if name != "packed_sequences":
            before = {r.doc_id: r for r in after}
    before, after = seen["quality_rules"]
    assert 0 < len(after) < len(before) and all(before[r.doc_id] == r for r in after)
    before, after = seen["near_duplicates"]
    ids = sorted(before)
    fps = np.array([brute_fingerprint(before[i].text) for i in ids], np.uint64)
    root = grouped(len(ids), [(i, int(j)) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1])
    assert {r.doc_id for r in after} == {ids[i] for i, k in enumerate(root) if i == k}
    before, after = seen["repeated_passages"]
    want = without_passages({i: r.text for i, r in before.items()})
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after) and any(want[i] != r.text for i, r in before.items())
    before, after = seen["personal_data"]
    for r in after:
        assert not re.search(r"@mail\d\.example", r.text)
        if not pii.base_spans(before[r.doc_id].text) and not re.search(r"\d", before[r.doc_id].text):
            assert r.text == before[r.doc_id].text
    texts = {r.doc_id: r.text for r in after}
    _, packed = seen["packed_sequences"]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id: r.doc_tokens for r in packed} == {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_run_is_all_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

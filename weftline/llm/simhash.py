"""Near-duplicate documents by SimHash and vantage-point trees (operator 8).

A fingerprint has a bit where over half of the document's shingle hashes have it. Distinct fingerprints are searched by
Hamming distance: a tree of vantage points, built from a bounded sample, deals them out to shards. A fingerprint on the near side
of a vantage point's radius goes to the far side too if it lies within the search radius of the boundary; by the triangle
inequality any linked pair then meets in a shard. Radii are placed where the copies make the work grow least. Fingerprints without structure leave
triangle bounds little to prune: n of them become about n ** 1.5 in leaves, against n ** 2 for all pairs, so shards are large and few. A shard that
no radius cuts and that holds more than others is cut into blocks by hash, and pairs of blocks are tasks. Each task builds its own vantage-point tree with the same rule
down to small leaves, whose pairs are compared exactly. Links become stars before they leave a task, and components of the
whole are found from these.

Defined results: a null text, or one without words, has fingerprint zero and links like any other. Shingles include
repeats. Rows that share an id are one document: they stay or go together. A row without an id doesn't link others; it has
the component of its fingerprint, null if no row with an id has it, and always stays.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, text_slices, unused, written
from .components import UnionFind, components

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Fingerprints to a shard; fingerprints of the sample to a shard, and in all at most.
SHARD, SAMPLE_EACH, SAMPLE = 1 << 16, 256, 1 << 20
#: Shards of more than ``CROWDED`` times ``SHARD`` fingerprints are cut into blocks of twice as many.
CROWDED = 3
#: Ids that a broadcast may hold, of about 16 bytes each. More are joined by an exchange.
BROADCAST_IDS = 2_000_000
_LEAF = 160
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint; only A to Z are lower-cased, words end at blanks and U+0009 to U+000D."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: 1 - shingle].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    out = 0
    for lane in range(8):
        ones = np.bincount(lanes[:, lane], minlength=256) @ _BITS
        out |= sum(1 << (8 * lane + bit) for bit in range(8) if 2 * ones[bit] > len(hashes))
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key`` and ``fp``, the fingerprint's bits as a signed integer."""

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                fps = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    chosen = spread(docs.select(F.col(key), F.col(text)))
    return chosen.mapInArrow(run, f"`{key}` {chosen.schema[0].dataType.simpleString()}, fp bigint")


def _sides(x: np.ndarray, point: np.uint64, radius: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of what goes to the near side and to the far side of a vantage point's radius."""
    d = np.bitwise_count(x ^ point)
    return d <= radius, d > radius - distance


def radius(d: np.ndarray, distance: int) -> tuple[float, int] | None:
    """The radius whose cut lets the work grow least, and the power a of that growth: with shares p and f of the two sides, copies
    included, p ** a + f ** a is 1. None where comparing all pairs (a power of 2) is as good. Each side loses a twentieth at least."""
    upto = np.cumsum(np.bincount(d, minlength=65)) / len(d)
    near, far = upto, 1 - np.concatenate([np.zeros(distance), upto[:-distance]])
    some = np.flatnonzero((near > 0) & (near <= 0.95) & (far <= 0.95) & (near * near + far * far < 1))
    if not len(some):
        return None
    near, far, low, high = near[some], far[some], np.ones(len(some)), np.full(len(some), 2.0)
    for _ in range(8):
        a = (low + high) / 2
        over = near**a + far**a > 1
        low, high = np.where(over, a, low), np.where(over, high, a)
    best = int(high.argmin())
    return float(high[best]), int(some[best])


def build(sample: np.ndarray, each: int, distance: int, rng: random.Random):
    """A tree of (vantage point, radius, near, far) down to parts of about ``each``, copies included; None for a leaf."""
    if len(sample) <= 1.5 * each:
        return None
    found = []
    for _ in range(4):
        point = sample[rng.randrange(len(sample))]
        if got := radius(np.bitwise_count(sample ^ point), distance):
            found.append((*got, point))
    if not found:
        return None
    _, r, point = min(found, key=lambda f: f[:2])
    near, far = _sides(sample, point, r, distance)
    return point, r, build(sample[near], each, distance, rng), build(sample[far], each, distance, rng)


def leaves(tree, x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index and leaf number of each fingerprint, once for each leaf that it must reach."""
    at, out = [], []
    # Nodes are numbered in the order of this walk, so a leaf has the same number for every batch.
    todo, number = [(tree, np.arange(len(x)))], 0
    while todo:
        node, idx = todo.pop()
        number += 1
        if node is None:
            at.append(idx)
            out.append(np.full(len(idx), number, np.int64))
            continue
        point, r, near, far = node
        a, b = _sides(x[idx], point, r, distance)
        todo += [(far, idx[b]), (near, idx[a])]
    return (np.concatenate(at), np.concatenate(out)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def stars(x: np.ndarray, distance: int, seed: int = 1) -> list[tuple[int, int]]:
    """Links between distinct fingerprints as (index, smallest index of its set)."""
    sets, rng = UnionFind(), random.Random(seed)

    def exact(idx: np.ndarray) -> None:
        for a in range(0, len(idx), 1024):
            rows = idx[a : a + 1024]
            for b in range(a, len(idx), 1024):
                columns = idx[b : b + 1024]
                p, q = np.nonzero(np.bitwise_count(x[rows][:, None] ^ x[columns][None, :]) <= distance)
                if a == b:
                    p, q = p[p < q], q[p < q]
                sets.join_all(rows[p], columns[q])

    def split(idx: np.ndarray) -> None:
        if len(idx) <= _LEAF:
            return exact(idx)
        point = x[idx[rng.randrange(len(idx))]]
        part = x[idx]
        got = radius(np.bitwise_count(part ^ point), distance)
        if got is None:  # a cluster that no radius cuts
            return exact(idx)
        near, far = _sides(part, point, got[1], distance)
        split(idx[near])
        split(idx[far])

    split(np.arange(len(x)))
    return [(i, r) for i in list(sets.parent) if (r := sets.find(i)) != i]


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``fp``, ``fingerprint`` in hexadecimal and ``component_id``."""
    fps = written(fingerprints(docs, key, text, shingle))
    distinct = written(fps.groupBy("fp").agg(F.min(key).cast("bigint").alias("rep")))
    some = distinct.where("rep IS NOT NULL")
    total = some.count()
    shards = max(1, math.ceil(total / SHARD))
    wanted = min(SAMPLE, SAMPLE_EACH * shards)
    # A bounded sample, to place vantage points: a share by hash, and at most twice SAMPLE fingerprints reach the driver.
    share = some.where(F.shiftrightunsigned(F.xxhash64("fp", F.lit(SEED)), 1) < F.lit(min((1 << 63) - 1, int((1 << 63) * min(1.0, wanted / max(1, total)))))).select("fp").limit(2 * SAMPLE)
    sample = np.sort(share.toArrow().column(0).to_numpy()).view(np.uint64)
    tree = build(sample, max(16, len(sample) // shards), distance, random.Random(SEED)) if shards > 1 else None

    def deal(batches):
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at, shard = leaves(tree, x, distance)
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(shard)], names=["fp", "rep", "shard"])

    dealt = written(some.select("fp", "rep").mapInArrow(deal, "fp bigint, rep bigint, shard bigint"))
    # A row for each crowded leaf of the tree, which the driver made from its bounded sample.
    crowded = dealt.groupBy("shard").count().where(F.col("count") > CROWDED * SHARD).select("shard", F.ceil(F.col("count") / (2 * SHARD)).cast("int").alias("parts"))
    dealt = dealt.join(F.broadcast(crowded), "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = dealt.select("shard", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "fp", "rep")

    def search(task: pa.Table) -> pa.Table:
        task = task.sort_by("rep")
        rep = task.column("rep").to_numpy()
        found = np.array(stars(task.column("fp").to_numpy().view(np.uint64), distance), np.int64).reshape(-1, 2)
        return pa.table({"a": rep[found[:, 0]], "b": rep[found[:, 1]]})

    links = dealt.groupBy("shard", "i", "j").applyInArrow(search, "a bigint, b bigint")
    joined = components(links, stars=True)
    classes = distinct.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return fps.join(classes, "fp").select(key, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """The documents with all their columns, of each group only the one with the smallest id."""
    (name,) = unused(docs, "__gone")
    gone = written(groups(docs, key, text, distance, shingle).where(F.col(key) != F.col("component_id")).select(F.col(key).alias(name)).distinct())
    # Either way texts are only streamed past the ids, not sorted.
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("shuffle_hash")
    return docs.join(gone, docs[key] == F.col(name), "left_anti")

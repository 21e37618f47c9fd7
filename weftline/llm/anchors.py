"""Exact search for windows that texts share, dealt out by anchors; operators 5 and 7 build on it.

A text is a sequence of symbols. The anchor of a window of W symbols is its k-gram of least hash, the leftmost of equals. As
it depends on the window's content alone, equal windows have their anchor at the same offset, so it is enough to look for
equal windows among those with equal anchors. Consecutive windows with the same anchor form a clip; there are about
2 / (W - k + 2) clips to a symbol.

Documents are dealt into chunks by key once; every later step reads that exchange again.
A: each chunk sends its distinct anchor hashes, sorted and difference-coded, to shards by hash range, with a byte that tells differing clips apart.
B: a shard answers each chunk with bits for each hash: whether another document or place has it too, and whether it is hot: the chunks would
send more than ``HOT`` clips for it, and these differ.
C: a chunk sends the clips of these anchors only, each distinct one once with its places, as sorted front-coded runs. Clips of a
hot anchor are cut into their windows, which go to shards by their content: a common phrase in ever new surroundings spreads over all shards.
D: a shard finds out which windows occur earlier and answers with places.
E: a chunk applies the answers to its texts.
A common passage costs a chunk one clip, however often it occurs there, and a phrase in differing surroundings brings one shard ``HOT`` clips
(a few MB) or, where there are more, its share of all windows. Hash collisions in A and B only add clips; C and D compare content.

Chunks grow with the memory that the cluster gives a core; messages between chunks and shards have no frame but their content,
and a chunk sends a shard none where it has nothing for it. Chunks and shards may be more than the partitions that hold them.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, unused

#: Clips round one anchor beyond which windows go by their content, if as many bytes of 256 as ``KINDS`` tell that they differ.
HOT, KINDS = 30_000, 200
#: Partitions at most, whatever the number of chunks.
PARTITIONS = 20_000
#: MB of stored texts to a chunk for each 1.5 GB of memory that an executor has for a core; the least and the most.
CHUNK_MB, CHUNK_MB_MOST = 4.0, 64.0
_TILE, _LOW = 1 << 20, np.uint64((1 << 24) - 1)
_HASH_BITS = 48
_RNG = np.random.default_rng(20240607)
#: Random 64-bit numbers for bytes, an odd multiplier, its inverse and powers.
BYTE_HASH = _RNG.integers(0, 1 << 64, 256, np.uint64)
_M = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def powers(n: int, base: int = _M) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _grams(s: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k symbols, by doubling."""
    have, out, at, h, size = k, None, 0, s, 1
    while have:
        if have & 1:
            if out is None:
                out, at = h, size
            else:  # what is there, then one more run of ``size``
                n = len(h) - at
                out = out[:n] * np.uint64(pow(_M, size, 1 << 64)) + h[at:]
                at += size
        have >>= 1
        if have:
            h = h[:-size] * np.uint64(pow(_M, size, 1 << 64)) + h[size:]
            size *= 2
    return mixed(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def clips(symbols: Callable[[int, int], np.ndarray], ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor position, first window, end of windows, hash, document, and a byte of each clip, which equal clips share. ``symbols(a, b)``
    hashes a range of the texts laid end to end; ``ends`` are the texts' ends there."""
    n = int(ends[-1]) if len(ends) else 0
    valid = np.zeros(n + 1, bool)
    start = 0
    for end in ends.tolist():
        valid[start : max(start, end - window + 1)] = True
        start = end
    width, out = window - gram + 1, []
    for a in range(0, n - window + 1, _TILE):
        b = min(a + _TILE, n - window + 1)
        ok = valid[a:b]
        if not ok.any():
            continue
        h = _grams(symbols(a, b + window - 1), gram)
        at = (_sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), width) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])]))
        end = np.append(first[1:], b - a)
        keep = ok[first]
        first, end = first[keep], end[keep]
        # From the clip's first and last gram and its length.
        kind = (mixed(h[first] * np.uint64(_M) + h[end - 1 + window - gram] + (end - first).astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
        out.append((at[first] + a, first + a, end + a, h[at[first]] >> np.uint64(64 - _HASH_BITS), kind))
    if not out:
        return *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    p, first, end, h, kind = (np.concatenate(x) for x in zip(*out))
    return p, first, end, h, np.searchsorted(ends, first, side="right"), kind


def joined(*parts: bytes) -> bytes:
    """Byte strings as one, compressed where that pays: their number and lengths, then themselves."""
    raw = np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)
    return b"\0" + raw if len(raw) < 200 else b"\1" + zstandard.compress(raw, 1)


def parted(blob: bytes) -> list[bytes]:
    raw = blob[1:] if blob[:1] == b"\0" else zstandard.decompress(blob[1:])
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = 4 * (n + 1) + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)
    return [raw[a:b] for a, b in zip([4 * (n + 1), *ends.tolist()], ends.tolist())]


def _planes(sorted_hashes: np.ndarray) -> bytes:
    """Differences by byte planes, which compress well."""
    return np.diff(sorted_hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _HASH_BITS // 8].T.tobytes()


def _unplaned(planes: bytes) -> np.ndarray:
    rows = np.frombuffer(planes, np.uint8).reshape(_HASH_BITS // 8, -1).T
    return np.cumsum(np.pad(rows, ((0, 0), (0, 8 - _HASH_BITS // 8))).copy().view("<u8").ravel(), dtype=np.uint64)


@dataclass
class Scheme:
    """What an operator looks for. ``lay(texts)`` gives (all symbols as bytes, symbol hash function, ends of texts in symbols, and where
    each symbol begins in the bytes, or None where symbols are bytes); ``within``: whether places in one document count as earlier;
    ``solve(runs)`` takes (chunk, run) pairs of a shard and yields (chunk, rows, first windows, end windows)."""

    window: int
    gram: int
    within: bool
    lay: Callable[[list[bytes]], tuple[bytes, Callable[[int, int], np.ndarray], np.ndarray, np.ndarray | None]]
    solve: Callable[[list], Iterable[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]


@dataclass
class Run:
    """Distinct clips of a chunk for a shard, sorted by their right part, front-coded. Places of clip i are
    ``keys, rows, firsts[at[i]:at[i + 1]]`` in ascending order."""

    shared: np.ndarray
    right_lens: np.ndarray
    left_lens: np.ndarray
    rights: bytes
    lefts: bytes
    at: np.ndarray
    keys: np.ndarray
    rows: np.ndarray
    firsts: np.ndarray

    _ARRAYS = (("shared", "<u4"), ("right_lens", "<u4"), ("left_lens", "<u4"), ("at", "<u4"), ("keys", "<i8"), ("rows", "<u4"), ("firsts", "<u4"))

    def coded(self) -> bytes:
        return joined(self.rights, self.lefts, *(getattr(self, n).astype(t).tobytes() for n, t in self._ARRAYS))

    @classmethod
    def of(cls, blob: bytes) -> Run:
        rights, lefts, *arrays = parted(blob)
        return cls(rights=rights, lefts=lefts, **{n: np.frombuffer(x, t) for (n, t), x in zip(cls._ARRAYS, arrays)})

    def clips(self) -> Iterable[tuple[int, bytes, bytes]]:
        """(length shared with the one before, right, left) of each clip."""
        before, r, le = b"", 0, 0
        for shared, n, m in zip(self.shared.tolist(), self.right_lens.tolist(), self.left_lens.tolist()):
            before = before[:shared] + self.rights[r : r + n - shared]
            yield shared, before, self.lefts[le : le + m]
            r, le = r + n - shared, le + m


def shared_prefix(x: bytes, y: bytes, start: int = 0) -> int:
    """Length of the common prefix of two strings that agree before ``start``."""
    n = min(len(x), len(y))
    a, b = x[start:n], y[start:n]
    if a == b:
        return n
    differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return n - (differ.bit_length() + 7) // 8


def _run(entries: dict[tuple[bytes, bytes], list[int]], keys, rows, firsts) -> Run:
    order = sorted(entries)
    shared, rights, lefts, before = [], [], [], b""
    for right, left in order:
        k = shared_prefix(before, right)
        shared.append(k)
        rights.append(right[k:])
        lefts.append(left)
        before = right
    places = [entries[e] for e in order]
    flat = np.fromiter((i for p in places for i in p), np.int64, sum(map(len, places)))
    number = lambda x: np.array(x, np.uint32)
    return Run(number(shared), number([len(r) for r, _ in order]), number([len(le) for _, le in order]), b"".join(rights), b"".join(lefts), np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.uint32), keys[flat], rows[flat].astype(np.uint32), firsts[flat].astype(np.uint32))


class _Chunk:
    """A chunk's rows in the order of key and text, so that every step numbers them alike."""

    def __init__(self, t: pa.Table, key: str, text: str):
        ids = t.column(key).combine_chunks().cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        texts = [x.encode("utf-8") if x is not None else b"" for x in t.column(text).to_pylist()]
        order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.table, self.ids, self.texts = t.take(pa.array(order, pa.int64())), ids[order], [texts[i] for i in order]

    def find(self, scheme: Scheme):
        self.raw, symbols, self.ends, self.offsets = scheme.lay(self.texts)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.p, self.first, self.end, self.hash, self.row, kind = clips(symbols, self.ends, scheme.window, scheme.gram)
        order = np.argsort(self.hash, kind="stable")
        h = self.hash[order]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        last = np.append(begin[1:], len(h)) - 1
        self.distinct = h[begin]
        self.number = np.zeros(len(h), np.int64)
        self.number[order] = np.repeat(np.arange(len(begin)), np.append(begin[1:], len(h)) - begin)
        ids = self.ids[self.row[order]] if len(h) else np.zeros(0, np.int64)
        # Rows of a document are in ascending order, so the first and the last place show whether there are two.
        self.repeated = (last > begin) if scheme.within else ids[begin] != ids[last]
        # A byte of one of each hash's clips, and how many differing ones there are besides: by their bytes, or all where these run out.
        self.kind = kind[order][begin]
        self.others = np.zeros(len(begin), np.uint32)
        sizes = last - begin + 1
        if (many := sizes[self.number] > 1).any():
            found = np.bincount(np.unique((self.number[many] << 8) | kind[many]) >> 8, minlength=len(begin))
            self.others = (np.where(found >= KINDS, sizes, np.maximum(found, 1)) - 1).astype(np.uint32)

    def cuts(self, shards: int) -> np.ndarray:
        shard = (self.distinct * np.uint64(shards)) >> np.uint64(_HASH_BITS)
        return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))

    def place(self, symbol: np.ndarray) -> list[int]:
        """Where symbols begin in the bytes."""
        return (symbol if self.offsets is None else self.offsets[symbol]).tolist()


def chunk_mb(spark) -> float:
    """MB of stored texts that a chunk may have, by the memory of an executor for each of its tasks."""
    conf = spark.sparkContext.getConf()
    jvm = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    each = jvm.byteStringAsMb(conf.get("spark.executor.memory", "1g")) / max(1, int(conf.get("spark.executor.cores", "1")) // int(conf.get("spark.task.cpus", "1")))
    return min(CHUNK_MB_MOST, max(CHUNK_MB, CHUNK_MB * each / 1500)) if not spark.sparkContext.master.startswith("local") else CHUNK_MB


def apply(docs: DataFrame, scheme: Scheme, finish: Callable[[pa.Table, list[bytes], list[np.ndarray]], pa.Table], ddl: str, key: str, text: str) -> DataFrame:
    """``finish`` gets a chunk's rows, their texts, and for each row the (first, end) window ranges that occur earlier."""
    spark = docs.sparkSession
    chunks = parts_for(docs, chunk_mb(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = min(chunks, 60_000)
    _CHUNK, _SHARD = unused(docs, "__anchor_chunk", "__anchor_shard")
    dealt = docs.withColumn(_CHUNK, F.pmod(F.xxhash64(F.col(key)), F.lit(chunks)).cast("int")).repartition(min(chunks, PARTITIONS), _CHUNK)
    window = scheme.window

    def hashes(t: pa.Table) -> pa.Table:
        chunk = _Chunk(t, key, text)
        chunk.find(scheme)
        cuts, out = chunk.cuts(shards), []
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[s], cuts[s + 1]
            out.append((s, t.column(_CHUNK)[0].as_py(), joined(_planes(chunk.distinct[a:b]), np.packbits(chunk.repeated[a:b]).tobytes(), chunk.kind[a:b].tobytes(), chunk.others[a:b].astype("<u4").tobytes() if chunk.others[a:b].any() else b"")))
        return pa.table({"shard": pa.array([o[0] for o in out], pa.int32()), "chunk": pa.array([o[1] for o in out], pa.int32()), "blob": pa.array([o[2] for o in out], pa.binary())})

    def answer(t: pa.Table) -> pa.Table:
        sent = [parted(blob) for blob in t.column("blob").to_pylist()]
        each = [_unplaned(x[0]) for x in sent]
        h = np.concatenate(each)
        flag = np.concatenate([np.unpackbits(np.frombuffer(x[1], np.uint8), count=len(e)) for x, e in zip(sent, each)]).astype(bool)
        kind = np.frombuffer(b"".join(x[2] for x in sent), np.uint8)
        others = np.concatenate([np.frombuffer(x[3], "<u4") if x[3] else np.zeros(len(e), np.uint32) for x, e in zip(sent, each)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
        sizes = np.diff(np.append(begin, len(h)))
        wanted, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
        wanted[order] = np.repeat((sizes > 1) | np.logical_or.reduceat(flag[order], begin), sizes)
        crowded = sizes + np.add.reduceat(others[order], begin) > HOT
        for g in np.flatnonzero(crowded).tolist():
            own = order[begin[g] : begin[g] + sizes[g]]
            hot[own] = len(np.unique(kind[own])) >= KINDS or others[own].max() >= KINDS - 1
        cut = np.cumsum([len(x) for x in each])[:-1]
        parts = [np.packbits(w).tobytes() + (np.packbits(x).tobytes() if x.any() else b"") for w, x in zip(np.split(wanted, cut), np.split(hot, cut))]
        return pa.table({_CHUNK: t.column("chunk"), _SHARD: t.column("shard"), "blob": pa.array(parts, pa.binary())})

    def send(t: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if t.num_rows and answers.num_rows:
            chunk = _Chunk(t, key, text)
            chunk.find(scheme)
            cuts, wanted, hot = chunk.cuts(shards), np.zeros(len(chunk.distinct), bool), np.zeros(len(chunk.distinct), bool)
            for s, bits in zip(answers.column(_SHARD).to_pylist(), answers.column("blob").to_pylist()):
                n = int(cuts[s + 1] - cuts[s])
                if len(bits) not in ((n + 7) // 8, (n + 7) // 8 * 2):
                    raise RuntimeError("a chunk's texts changed between steps")
                bits, width = np.frombuffer(bits, np.uint8), (n + 7) // 8
                wanted[cuts[s] : cuts[s + 1]] = np.unpackbits(bits[:width], count=n)
                if len(bits) > width:
                    hot[cuts[s] : cuts[s + 1]] = np.unpackbits(bits[width:], count=n)
            some = np.flatnonzero(wanted[chunk.number])
            some = some[np.argsort(chunk.number[some], kind="stable")]
            cold, warm = some[~hot[chunk.number[some]]], some[hot[chunk.number[some]]]
            raw, number = chunk.raw, t.column(_CHUNK)[0].as_py()
            runs: dict[int, dict[tuple[bytes, bytes], list[int]]] = {}
            a, p, b = chunk.place(chunk.first[cold]), chunk.place(chunk.p[cold]), chunk.place(chunk.end[cold] + (window - 1))
            for i, s in enumerate((np.searchsorted(cuts, chunk.number[cold], side="right") - 1).tolist()):
                entries = runs.get(s)
                if entries is None:
                    entries = runs[s] = {}
                entries.setdefault((raw[p[i] : b[i]], raw[a[i] : p[i]]), []).append(i)
            # Each window of a hot anchor by itself, in the shard of its content.
            lens = chunk.end[warm] - chunk.first[warm]
            of = np.repeat(warm, lens)
            first = np.repeat(chunk.first[warm], lens) + np.arange(len(of)) - np.repeat(np.cumsum(lens) - lens, lens)
            a, p, b = chunk.place(first), chunk.place(chunk.p[of]), chunk.place(first + window)
            for i in range(len(of)):
                x = raw[a[i] : b[i]]
                runs.setdefault(xxhash.xxh3_64_intdigest(x) * shards >> 64, {}).setdefault((x[p[i] - a[i] :], x[: p[i] - a[i]]), []).append(len(cold) + i)
            at, first = np.concatenate([cold, of]), np.concatenate([chunk.first[cold], first])
            keys, rows, firsts = chunk.ids[chunk.row[at]], chunk.row[at], first - chunk.starts[chunk.row[at]]
            out = [(s, number, _run(entries, keys, rows, firsts).coded()) for s, entries in sorted(runs.items())]
        return pa.table({"shard": pa.array([o[0] for o in out], pa.int32()), "chunk": pa.array([o[1] for o in out], pa.int32()), "blob": pa.array([o[2] for o in out], pa.binary())})

    def solve(t: pa.Table) -> pa.Table:
        found = list(scheme.solve([(c, Run.of(b)) for c, b in zip(t.column("chunk").to_pylist(), t.column("blob").to_pylist())]))
        return pa.table({_CHUNK: pa.array([f[0] for f in found], pa.int32()), "blob": pa.array([joined(*(np.asarray(x, "<u4").tobytes() for x in f[1:])) for f in found], pa.binary())})

    def end(t: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(t, key, text)
        parts = [[np.frombuffer(x, "<u4") for x in parted(b)] for b in answers.column("blob").to_pylist()]
        ranges = [np.zeros((0, 2), np.int64)] * len(chunk.texts)
        if parts:
            row, first, last = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3))
            order = np.lexsort((first, row))
            row, pairs = row[order], np.stack([first[order], last[order]], 1)
            begin = np.flatnonzero(np.concatenate([[True], np.diff(row) != 0]))
            for r, part in zip(row[begin].tolist(), np.split(pairs, begin[1:])):
                ranges[r] = part
        return finish(chunk.table.drop_columns([_CHUNK]), chunk.texts, ranges)

    blob = "shard int, chunk int, blob binary"
    sent = dealt.groupBy(_CHUNK).applyInArrow(hashes, blob)
    answers = sent.groupBy("shard").applyInArrow(answer, f"{_CHUNK} int, {_SHARD} int, blob binary")
    runs = dealt.groupBy(_CHUNK).cogroup(answers.groupBy(_CHUNK)).applyInArrow(send, blob)
    found = runs.groupBy("shard").applyInArrow(solve, f"{_CHUNK} int, blob binary")
    return dealt.groupBy(_CHUNK).cogroup(found.groupBy(_CHUNK)).applyInArrow(lambda t, a: end(t, a) if t.num_rows else None, ddl)


class Places:
    """Answers of a shard, by chunk, without an object for each."""

    def __init__(self):
        self.of: dict[int, tuple[array, array, array]] = {}

    def add(self, chunk: int, run: Run, a: int, b: int, x: int, y: int) -> None:
        """Windows x to y of the places a to b of a run occur earlier."""
        if a < b:
            rows, firsts, ends = self.of.get(chunk) or self.of.setdefault(chunk, (array("I"), array("I"), array("I")))
            if b - a == 1:
                first = run.firsts.item(a)
                rows.append(run.rows.item(a))
                firsts.append(first + x)
                ends.append(first + y)
                return
            rows.frombytes(run.rows[a:b].tobytes())
            firsts.frombytes((run.firsts[a:b] + np.uint32(x)).tobytes())
            ends.frombytes((run.firsts[a:b] + np.uint32(y)).tobytes())

    def __iter__(self):
        return ((chunk, *(np.frombuffer(x, np.uint32) for x in parts)) for chunk, parts in self.of.items())


def covered(ranges: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal spans of symbols that windows starting in sorted (first, end) ranges cover."""
    out: list[tuple[int, int]] = []
    for a, b in ranges.tolist():
        b += window - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def ranges_of(flags: list[bool]) -> list[tuple[int, int]]:
    """Runs of true flags as (start, end)."""
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            out.append((start, i))
            start = None
    return out

"""Substring removal by a common-prefix-aware distributed merge sort of suffixes (operator 5).

Suffixes start at the anchors of 50-byte windows (see ``anchors``): each chunk sorts its own, drops those that no
other document can share, and sends front-coded runs to shards. A shard merges its runs with a loser tree whose
players know how much of the last winner they share; only bytes behind that are ever compared. Suffixes that share their anchor come
out of the merge together, each with the length of the prefix it shares with the one before. A window that begins j bytes before the
anchor is common to neighbours while they share 50 - j bytes, so runs of neighbours by these lengths, split by the j bytes before the anchor,
are the suffixes with equal windows; their smallest document keeps the window and all others lose it.

Defined results: a null text is empty. Rows with equal ids remove nothing from each other; a null id counts as the
largest. Texts shorter than the window stay whole. The text of ``cleaned`` drops bytes of a character that was cut in two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import BYTE_HASH, Places, Run, Scheme, apply, covered, ranges_of, shared_prefix

WINDOW, GRAM = 50, 24


class LoserTree:
    """Merges sorted runs of (prefix shared with the one before in the run, string, payload)."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        self.runs, n = runs, 1
        while n < len(runs):
            n *= 2
        self.n = n
        self.string: list[bytes | None] = [None] * n
        self.shared, self.payload = [0] * n, [None] * n
        for r in range(len(runs)):
            self.step(r)
        self.losers = [0] * n
        winners = [0] * n + list(range(n))
        for k in range(n - 1, 0, -1):
            winners[k], self.losers[k] = self.play(winners[2 * k], winners[2 * k + 1])
        self.winner = winners[1]

    def step(self, r: int) -> None:
        got = next(self.runs[r], None)
        if got is None:
            self.string[r] = None
        else:
            self.shared[r], self.string[r], self.payload[r] = got

    def play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser. Shared lengths are with the last winner; whoever shares more is smaller, unread. Only at a tie are bytes
        compared, from there on, and the loser then knows what it shares with the new winner."""
        x, y = self.string[a], self.string[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = self.shared[a], self.shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        k = shared_prefix(x, y, p)
        if k == len(x) or (k < len(y) and x[k] < y[k]):
            self.shared[b] = k
            return a, b
        self.shared[a] = k
        return b, a

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        losers, n = self.losers, self.n
        while (string := self.string[w := self.winner]) is not None:
            yield self.shared[w], string, self.payload[w]
            self.step(w)
            k = (w + n) // 2
            while k:
                if (other := losers[k]) != w:
                    w, losers[k] = self.play(w, other)
                k //= 2
            self.winner = w


def _players(chunk: int, run: Run):
    at = run.at.tolist()
    for i, (shared, right, left) in enumerate(run.clips()):
        yield shared, right, (left, chunk, run, at[i], at[i + 1])


def earliest(group: list[tuple[int, bytes, tuple]], window: int, gram: int) -> list[list[int]]:
    """For each clip of a sorted group, the smallest document that has each of its windows. Entries are (prefix shared with the one
    before, right part, (left part, chunk, run, first place, end of places))."""
    number: dict[tuple[bytes, bytes], int] = {}
    of, own, shared, upto = [], [], [], window
    for prefix, right, (left, _, run, a, _) in group:
        upto = min(upto, prefix)
        k = number.setdefault((right, left), len(number))
        key = run.keys.item(a)
        if k == len(own):
            own.append(key)
            shared.append(upto)
            upto = window
        elif key < own[k]:
            own[k] = key
        of.append(k)
    clips = list(number)
    least = [[k] * (len(left) + len(right) - window + 1) for k, (right, left) in zip(own, clips)]
    n = len(clips)
    # No two share more, so windows that need more are nobody else's.
    most = max(shared[1:], default=0)
    for j in range(max(0, window - most), min(window - gram, max(len(left) for _, left in clips)) + 1 if n > 1 else 0):
        need, i = window - j, 0
        while i < n:
            end = i + 1
            while end < n and shared[end] >= need:
                end += 1
            if end - i > 1:
                found: dict[bytes, int] = {}
                members = []
                for k in range(i, end):
                    right, left = clips[k]
                    if len(left) >= j and len(right) >= need:
                        tail = left[len(left) - j :]
                        if found.get(tail, own[k] + 1) > own[k]:
                            found[tail] = own[k]
                        members.append((k, len(left) - j, tail))
                if len(found) < len(members):
                    for k, x, tail in members:
                        least[k][x] = found[tail]
            i = end
    return [least[k] for k in of]


def solve(runs: list[tuple[int, Run]], window: int = WINDOW, gram: int = GRAM):
    out = Places()

    def settle(group: list[tuple[int, bytes, tuple]]) -> None:
        if len(group) == 1 and group[0][2][4] - group[0][2][3] == 1:
            return
        _, right, (left, *_) = group[0]
        if all(r == right and p[0] == left for _, r, p in group):  # copies of one clip: the smallest document keeps it
            least, windows = min(p[2].keys.item(p[3]) for _, _, p in group), len(left) + len(right) - window + 1
            for _, _, (_, chunk, run, a, b) in group:
                if b - a > 1:
                    a += int(run.keys[a:b].searchsorted(least, side="right"))
                elif run.keys.item(a) <= least:
                    continue
                out.add(chunk, run, a, b, 0, windows)
            return
        for least, (_, _, (left, chunk, run, a, b)) in zip(earliest(group, window, gram), group):
            keys, top = run.keys[a:b], max(least)
            behind = int(keys.searchsorted(top, side="right"))
            out.add(chunk, run, a + behind, b, 0, len(least))  # larger than every window's smallest document
            i = 0
            while i < behind:
                key = keys.item(i)
                j = i + 1 if len(keys) == 1 else int(keys.searchsorted(key, side="right"))
                if min(least) < key:
                    for x, y in ranges_of([x < key for x in least]):
                        out.add(chunk, run, a + i, a + j, x, y)
                i = j

    group: list[tuple[int, bytes, tuple]] = []
    for shared, right, payload in LoserTree([iter(_players(c, r)) for c, r in runs]):
        if group and shared < gram:
            settle(group)
            group = []
        group.append((shared, right, payload))
    if group:
        settle(group)
    return out


def _lay(texts: list[bytes]):
    raw = b"".join(texts)
    data = np.frombuffer(raw, np.uint8)
    return raw, lambda a, b: BYTE_HASH[data[a:b]], np.cumsum([len(t) for t in texts]).astype(np.int64), None


SCHEME = Scheme(WINDOW, GRAM, False, _lay, solve)


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]) if spans else text


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: bytes, removed bytes, maximal removed spans, and SHA-256 of what stays."""
    docs = docs.select(key, text)

    def finish(t: pa.Table, texts: list[bytes], ranges: list[np.ndarray]) -> pa.Table:
        spans = [covered(r, WINDOW) for r in ranges]
        columns = {
            key: t.column(key), "n_bytes": pa.array([len(x) for x in texts], pa.int64()), "n_removed": pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
            "n_spans": pa.array([len(s) for s in spans], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(_cut(x, s)).hexdigest() for x, s in zip(texts, spans)], pa.string()),
        }
        return pa.table(columns)

    return apply(docs, SCHEME, finish, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", key, text)


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns, removed bytes gone from the text; a null text stays null."""

    def finish(t: pa.Table, texts: list[bytes], ranges: list[np.ndarray]) -> pa.Table:
        at = t.column_names.index(text)
        null = t.column(text).is_null().to_pylist()
        new = [None if n else _cut(x, covered(r, WINDOW)).decode("utf-8", "ignore") for n, x, r in zip(null, texts, ranges)]
        return t.set_column(at, text, pa.array(new, pa.string()))

    return apply(docs, SCHEME, finish, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), key, text)

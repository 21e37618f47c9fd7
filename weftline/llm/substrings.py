"""Removal of repeated word windows by suffix automata (operator 7).

Clips of word windows are dealt to shards by their anchors (see ``anchors``). A group of clips with a common anchor
is a reference of its own: a suffix automaton grows over its distinct clips in the order of their first places, and each clip
is streamed through it before it is added. Where its matching statistics reach the window length, that window occurs
earlier. All later places of a clip lose all its windows.

Hashes of words choose anchors alone; clips are sent as their words, and words are compared by their bytes. Defined results: a null text has no words. Rows with equal ids
count as documents in the order of their texts, a null id as the largest. Texts of fewer words than the window stay whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import _M, BYTE_HASH, Places, Run, Scheme, apply, covered, mixed, powers, ranges_of

WINDOW, GRAM = 20, 8
_INVERSE = pow(_M, -1, 1 << 64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c, q: int) -> int:
        """A state for the part of q that p reaches by c."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:  # an earlier sequence has this prefix
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
                continue
            p, last = last, self._state(self.length[last] + 1, {}, 0)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)

    def statistics(self, sequence) -> list[int]:
        """For each position, the length of the longest match that ends there."""
        at = n = 0
        out = []
        for c in sequence:
            while at and c not in self.next[at]:
                at = self.link[at]
                n = self.length[at]
            if c in self.next[at]:
                at, n = self.next[at][c], n + 1
            out.append(n)
        return out


def solve(runs: list[tuple[int, Run]], window: int = WINDOW, gram: int = GRAM):
    groups: dict[bytes, dict[bytes, list[tuple[int, Run, int, int]]]] = {}
    for chunk, run in runs:
        at = run.at.tolist()
        for i, (_, right, left) in enumerate(run.clips()):
            groups.setdefault(b" ".join(right.split(b" ", gram)[:gram]), {}).setdefault(left + right, []).append((chunk, run, at[i], at[i + 1]))
    out = Places()
    place = lambda p: (int(p[1].keys[p[2]]), int(p[1].rows[p[2]]), int(p[1].firsts[p[2]]))
    for clips in groups.values():
        if len(clips) == 1 and sum(b - a for ps in clips.values() for _, _, a, b in ps) == 1:
            continue
        # Each word is followed by a blank. Clips of one window each share none, unless they are equal.
        automaton = SuffixAutomaton() if len(clips) > 1 and any(clip.count(b" ") > window for clip in clips) else None
        for _, clip, places in sorted((min(map(place, ps)), clip, ps) for clip, ps in clips.items()) if automaton else [(None, *x) for x in clips.items()]:
            windows = clip.count(b" ") - window + 1
            first = min(places, key=place)
            for p in places:  # a run's places are in ascending order
                out.add(p[0], p[1], p[2] + (p is first), p[3], 0, windows)
            if automaton:
                words = clip.split()
                found = automaton.statistics(words)
                for x, y in ranges_of([n >= window for n in found[window - 1 :]]):
                    out.add(first[0], first[1], first[2], first[2] + 1, x, y)
                automaton.add(words)
    return out


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    edge = np.diff(np.concatenate([[True], _SEPARATOR[data], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, from differences of one running polynomial."""
    out = []
    # In tiles that end between words, so that the powers of a tile are enough; a longer word makes a longer tile.
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + (1 << 20), side="right")))
        b = int(ends[j - 1])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_HASH[data[a:b]] * powers(b - a), dtype=np.uint64)])
        out.append(mixed((sums[ends[i:j] - a] - sums[starts[i:j] - a]) * powers(b - a + 1, _INVERSE)[starts[i:j] - a]))
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _lay(texts: list[bytes]):
    # A separator behind each text keeps its words apart from the next one's.
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    starts, ends = _words(data)
    hashes = word_hashes(data, starts, ends)
    # The words, each with one blank behind it.
    kept = ~_SEPARATOR[data]
    kept[ends] = True
    raw = np.where(_SEPARATOR[data], np.uint8(32), data)[kept].tobytes()
    offsets = np.concatenate([[0], np.cumsum(ends - starts + 1)]).astype(np.int64)
    until = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])).astype(np.int64)
    return raw, lambda a, b: hashes[a:b], until, offsets


SCHEME = Scheme(WINDOW, GRAM, True, _lay, solve)


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    words = text.split()
    n = len(words)
    for a, b in reversed(spans):
        del words[a:b]
    return n, n - len(words), b" ".join(words)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, removed words, and SHA-256 of the kept words."""
    docs = docs.select(key, text)

    def finish(t: pa.Table, texts: list[bytes], ranges: list[np.ndarray]) -> pa.Table:
        rows = [_kept(x, covered(r, WINDOW)) for x, r in zip(texts, ranges)]
        return pa.table({key: t.column(key), "n_words": pa.array([r[0] for r in rows], pa.int64()), "n_removed": pa.array([r[1] for r in rows], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())})

    return apply(docs, SCHEME, finish, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string", key, text)


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns, the text being the kept words; a null text stays null."""

    def finish(t: pa.Table, texts: list[bytes], ranges: list[np.ndarray]) -> pa.Table:
        null = t.column(text).is_null().to_pylist()
        new = [None if n else _kept(x, covered(r, WINDOW))[2].decode("utf-8") for n, x, r in zip(null, texts, ranges)]
        return t.set_column(t.column_names.index(text), text, pa.array(new, pa.string()))

    return apply(docs, SCHEME, finish, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), key, text)

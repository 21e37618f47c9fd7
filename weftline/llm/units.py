"""Per-worker cache from text units to token ids, filled in bulk."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import chain

import numpy as np


class _Index(dict):
    """Gives each new unit the next number and remembers it until its ids are known."""

    def __init__(self):
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, unit):
        number = self[unit] = len(self)
        self.pending.append(unit)
        return number


class UnitCache:
    """Ids of texts that are cut into independent units. ``encode`` maps many units to all their ids and the number of each
    one's. The cache is dropped when it holds more than ``limit`` units, and ``at_once`` new ones are encoded in a call,
    which bounds a worker's memory. A task makes its own, so that an idle worker holds none."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 400_000, at_once: int = 1 << 30):
        self.encode, self.limit, self.at_once = encode, limit, at_once
        self.clear()

    def clear(self) -> None:
        self.index, self.flat, self.ends = _Index(), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def ids(self, texts: Sequence[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one after another, and the offset of each text's first (one more at the end)."""
        counts = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        return self.coded(chain.from_iterable(texts), None, counts)

    def coded(self, units: Iterable[str], codes: np.ndarray | None, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts of ``counts`` units each, given as places in ``units``, or as ``units`` in order."""
        if len(self.index) > self.limit:
            self.clear()
        numbers = np.fromiter(map(self.index.__getitem__, units), np.int64)
        codes = numbers if codes is None else numbers[codes]
        if pending := self.index.pending:
            self.index.pending = []
            flats, all_lens = [self.flat], []
            for a in range(0, len(pending), self.at_once):
                new, lens = self.encode(pending[a : a + self.at_once])
                flats.append(np.asarray(new, np.uint32))
                all_lens.append(lens)
            self.flat = np.concatenate(flats)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(all_lens))])
        starts, lens = self.ends[codes], self.ends[codes + 1] - self.ends[codes]
        upto = np.concatenate([[0], np.cumsum(lens)])
        flat = self.flat[np.repeat(starts - upto[:-1], lens) + np.arange(upto[-1])]
        return flat, upto[np.concatenate([[0], np.cumsum(counts)])]

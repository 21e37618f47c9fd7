"""Results kept by lineage, and advice on what to keep: costs, benefits, choice and eviction."""

from __future__ import annotations

import json
import math
import time
from collections import defaultdict
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .types import ScriptError

#: Assumed bandwidths in bytes a second, for benefits.
READ, WRITE = 880 * 2**20, 100 * 2**20


@dataclass
class Entry:
    signature: str
    path: str
    size: int
    benefit: float = 0.0
    used: float = 0.0
    uses: int = 0
    fields: list = field(default_factory=list)


class Store:
    """Tables under one folder, named by lineage, with a manifest beside them. Reads and writes go through Spark's file
    systems, so that the folder can be in any of them."""

    def __init__(self, spark: SparkSession, base: str, capacity: int | None = None, policy: str = "LRU", admission: bool = False):
        if policy not in POLICIES:
            raise ScriptError(f"no eviction policy {policy!r}")
        self.spark, self.base, self.capacity, self.policy, self.admission = spark, base.rstrip("/"), capacity, policy, admission
        self.entries: dict[str, Entry] = {}
        text = self._read()
        if text:
            self.entries = {e["signature"]: Entry(**e) for e in json.loads(text)}

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read(self) -> str:
        fs, p = self._fs(f"{self.base}/manifest.json")
        return "\n".join(r.value for r in self.spark.read.text(str(p)).collect()) if fs.exists(p) else ""

    def _save(self) -> None:
        fs, p = self._fs(f"{self.base}/manifest.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps([asdict(e) for e in self.entries.values()]).encode()))
        out.close()

    def get(self, signature: str) -> DataFrame | None:
        e = self.entries.get(signature)
        if e is None:
            return None
        fs, p = self._fs(e.path)
        if not fs.exists(p):
            del self.entries[signature]
            return None
        e.used, e.uses = time.time(), e.uses + 1
        self._save()
        return self.spark.read.parquet(e.path)

    def put(self, signature: str, df: DataFrame, benefit: float = 0.0) -> DataFrame | None:
        """Writes a result once; None where it doesn't fit."""
        if (known := self.get(signature)) is not None:
            return known
        path = f"{self.base}/{signature}"
        df.write.mode("overwrite").parquet(path)
        fs, p = self._fs(path)
        entry = Entry(signature, path, int(fs.getContentSummary(p).getLength()), benefit, time.time(), 0)
        if self.capacity is not None:
            gone = POLICIES[self.policy](list(self.entries.values()), entry, self.capacity)
            if gone is None or self.admission and sum(g.benefit for g in gone) > benefit:
                fs.delete(p, True)
                return None
            for g in gone:
                self.drop(g.signature)
        self.entries[signature] = entry
        self._save()
        return self.spark.read.parquet(path)

    def drop(self, signature: str) -> None:
        e = self.entries.pop(signature)
        fs, p = self._fs(e.path)
        fs.delete(p, True)
        self._save()


# -- eviction: what has to go so that a new entry fits; None: it can't
def _none(have: list[Entry], new: Entry, capacity: int) -> list[Entry] | None:
    return [] if sum(e.size for e in have) + new.size <= capacity else None


def _lru(have: list[Entry], new: Entry, capacity: int) -> list[Entry] | None:
    if new.size > capacity:
        return None
    total, gone = sum(e.size for e in have) + new.size, []
    for e in sorted(have, key=lambda e: e.used):
        if total <= capacity:
            break
        gone.append(e)
        total -= e.size
    return gone


def _knapsack(have: list[Entry], new: Entry, capacity: int) -> list[Entry] | None:
    """Keeps the entries of most benefit that fit, the new one being one of them."""
    if new.size > capacity:
        return None
    every = [*have, new]
    unit = max(1, math.ceil(capacity / 1000))
    room = capacity // unit
    best: list[tuple[float, frozenset[int]]] = [(0.0, frozenset())] * (room + 1)
    for i, e in enumerate(every):
        weight = math.ceil(e.size / unit)
        for w in range(room, weight - 1, -1):
            value = best[w - weight][0] + e.benefit
            if value > best[w][0]:
                best[w] = (value, best[w - weight][1] | {i})
    kept = max(best, key=lambda b: b[0])[1]
    return None if len(every) - 1 not in kept else [e for i, e in enumerate(have) if i not in kept]


def _ratio(have: list[Entry], new: Entry, capacity: int) -> list[Entry] | None:
    """The same by benefit for each byte, greedily."""
    kept, total = set(), 0
    every = [*have, new]
    for i in sorted(range(len(every)), key=lambda i: -every[i].benefit / max(1, every[i].size)):
        if total + every[i].size <= capacity:
            kept.add(i)
            total += every[i].size
    return None if len(every) - 1 not in kept else [e for i, e in enumerate(have) if i not in kept]


POLICIES = {"NONE": _none, "LRU": _lru, "KNAPSACK": _knapsack, "KNAPSACK_RATIO": _ratio}


# -- advice
class OperatorGraph:
    """What runs of scripts have shown: how often one operator followed another, how long operators took, what they made."""

    def __init__(self):
        self.follows: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self.times: dict[str, list[float]] = defaultdict(list)
        self.sizes: dict[str, int] = {}
        self.inputs: dict[str, list[str]] = {}

    def ran(self, signature: str, inputs: list[str], seconds: float, size: int | None = None) -> None:
        self.inputs[signature] = list(inputs)
        self.times[signature].append(seconds)
        if size is not None:
            self.sizes[signature] = size
        for i in inputs or ["start"]:
            self.follows[i][signature] += 1

    def path(self, signature: str) -> list[str]:
        seen, todo = [], [signature]
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.append(s)
                todo += self.inputs.get(s, [])
        return seen

    def cost(self, signature: str) -> float:
        """Average seconds of all operators that lead there, itself included."""
        return sum(sum(self.times[s]) / len(self.times[s]) for s in self.path(signature) if self.times.get(s))

    def probability(self, signature: str, how: str = "PRODUCT") -> float:
        """Chance of a run coming by, from the shares of the edges on its path."""
        shares = []
        for s in self.path(signature):
            for i in self.inputs.get(s) or ["start"]:
                total = sum(self.follows[i].values())
                if total:
                    shares.append(self.follows[i][s] / total)
        if not shares:
            return 0.0
        return {"MIN": min, "MAX": max, "AVG": lambda x: sum(x) / len(x), "PRODUCT": math.prod}[how](shares)

    def benefit(self, signature: str) -> float:
        """Seconds saved by reading a result instead of making it."""
        return self.cost(signature) - self.sizes.get(signature, 0) / READ

    def choose(self, candidates: list[str], how: str = "MAXBENEFIT", probability: str = "PRODUCT") -> str | None:
        """The result to keep: of most benefit, of most expected benefit, or the last that has any."""
        good = [s for s in candidates if self.benefit(s) - self.sizes.get(s, 0) / WRITE > 0]
        if not good:
            return None
        if how == "LAST":
            return good[-1]
        if how == "MARKOV":
            return max(good, key=lambda s: self.probability(s, probability) * self.benefit(s))
        if how == "MAXBENEFIT":
            return max(good, key=self.benefit)
        raise ScriptError(f"no way to choose {how!r}")

"""Byte-level BPE encoding and decoding with a pair occurrence index (operator 10).

A text is cut into units whose tokens don't depend on their surroundings. The new units of a batch are cut into
pretokens, and all their bytes laid out as one linked array of symbols. The index maps the rank of each mergeable
pair to all its positions in that array. Active ranks are taken from a heap in ascending order; one vectorised step
merges all live occurrences, then adds the pairs that the new symbol forms with its neighbours to their lists.
A merge only creates pairs of higher rank, so one ascending pass is complete.

Defined results: a null or empty text has no tokens and decodes to the empty text. The strings of special tokens
in a text become these tokens, as in the library's default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, text_slices
from .units import UnitCache

#: Unicode white space, as the pretokenizer's \s.
WS = "\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_UNIT = re.compile(rf" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
_PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndexBpe:
    """Encoder and decoder for one vocabulary file of the tokenizers library (byte level, no normalizer)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_alphabet()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.table = [b""] * size
        for token, i in vocab.items():
            self.table[i] = bytes(letters[c] for c in token)
        for token, i in self.specials.items():
            self.table[i] = token.encode()
        self.of_byte = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        self.width = size
        left, right = (np.array([vocab[m[s]] for m in merges], np.int64) for s in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.left, self.right = left, right
        codes = left * size + right
        self.rank_of = np.argsort(codes, kind="stable")
        self.codes = codes[self.rank_of]
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where the vocabulary doesn't merge it."""
        code = a * self.width + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.rank_of[at], -1)

    def _merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word, by the pair occurrence index over all words."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        # One dead cell follows each word: no pair reaches over it.
        ends = np.cumsum(lens + 1)
        n = int(ends[-1]) if len(words) else 0
        sym = np.full(n, -1, np.int64)
        cells = np.ones(n, bool)
        cells[ends - 1] = False
        sym[cells] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, group in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(group)
                else:
                    index[r] = [group]
                    heapq.heappush(heap, r)

        def pairs(at: np.ndarray) -> None:
            right = nxt[at]
            ok = (at >= 0) & (sym[at] >= 0) & (sym[right] >= 0)
            at = at[ok]
            ranks = self._ranks(sym[at], sym[right[ok]])
            if (known := ranks >= 0).any():
                note(at[known], ranks[known])

        if n:
            nxt[-1] = n - 1
            pairs(np.flatnonzero(cells))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            a, b = self.left[r], self.right[r]
            right = nxt[at]
            at = at[(sym[at] == a) & (sym[right] == b)]
            if a == b and len(at) > 1:  # in a run of equal symbols, every second pair from the left
                taken, last, keep = -1, -1, np.ones(len(at), bool)
                for i, (p, q) in enumerate(zip(at.tolist(), nxt[at].tolist())):
                    if p == last and taken:
                        keep[i], taken = False, False
                    else:
                        taken = True
                    last = q
                at = at[keep]
            if not len(at):
                continue
            gone = nxt[at]
            sym[at], sym[gone] = self.made[r], -2
            nxt[at] = nxt[gone]
            prv[nxt[gone]] = at
            before = prv[at]
            before = before[before >= 0]
            pairs(np.concatenate([at, before[sym[before] >= 0]]))
        live = sym >= 0
        ids = sym[live]
        upto = np.cumsum(live)[ends - 1] if n else np.zeros(0, np.int64)
        return np.split(ids, upto[:-1]) if len(words) else []

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [_PRETOKEN.findall(u) for u in units]
        known = {p: i for i, p in enumerate(dict.fromkeys(p for ps in cut for p in ps))}
        ids = [x.tolist() for x in self._merge([p.encode("utf-8") for p in known])]
        each = [ids[known[ps[0]]] if len(ps) == 1 else [i for p in ps for i in ids[known[p]]] for ps in cut]
        lens = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter((i for x in each for i in x), np.uint32, int(lens.sum())), lens

    def cache(self) -> UnitCache:
        return UnitCache(self._units)

    def encode_batch(self, texts: list[str], cache: UnitCache | None = None) -> list[np.ndarray]:
        """The ids of each text as 32-bit unsigned integers."""
        parts, owner, special = [], [], {}
        for k, text in enumerate(texts):
            pieces = self.split.split(text) if self.split and any(s in text for s in self.specials) else [text]
            for piece in pieces:
                if piece in self.specials:
                    special[len(parts)] = self.specials[piece]
                    piece = ""
                parts.append(_UNIT.findall(piece))
                owner.append(k)
        flat, at = (cache or self.cache()).ids(parts)
        if not special:
            return [flat[at[k] : at[k + 1]] for k in range(len(texts))]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for i, k in enumerate(owner):
            out[k].append(np.array([special[i]], np.uint32) if i in special else flat[at[i] : at[i + 1]])
        return [np.concatenate(x) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


def roundtrip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with ``ids`` (its token ids) and ``decoded`` (their text)."""
    return _mapped(docs, vocabulary, key, text, pa.schema([("ids", pa.list_(pa.int64())), ("decoded", pa.string())]), "ids array<bigint>, decoded string", lambda ids, decoded: (ids.tolist(), decoded))


def digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its number of tokens and SHA-256 of the ids and of the decoded text."""
    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digest(ids: np.ndarray, decoded: str):
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()

    return _mapped(docs, vocabulary, key, text, schema, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest)


def _mapped(docs: DataFrame, vocabulary: str, key: str, text: str, schema: pa.Schema, ddl: str, result) -> DataFrame:
    def run(batches):
        bpe = codec(vocabulary)
        cache = bpe.cache()
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                rows = [result(ids, bpe.decode(ids)) for ids in bpe.encode_batch(texts, cache)]
                columns = [part.column(0), *(pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, *schema.names])

    chosen = spread(docs.select(F.col(key), F.col(text)))
    return chosen.mapInArrow(run, f"`{key}` {chosen.schema[0].dataType.simpleString()}, {ddl}")

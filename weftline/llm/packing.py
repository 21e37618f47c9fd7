"""Packing of documents into fixed-length token sequences (operator 3).

Documents are tokenized once, in Arrow batches, and cut into pieces of at most the sequence length. Pieces go to
groups at random (by a seeded hash of document and start), and each group is packed on its own by first-fit
decreasing. A tournament tree over the bins' remaining capacities finds the first bin that holds a piece in
logarithmic time. The number of groups follows the input, so no group grows with it.

Defined results: a null or empty text is the end token alone. A null id stays null, sorts last, and leaves other ids as they are. Repeated rows are packed as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, slices_of, spread
from .units import UnitCache

LENGTH = 4096
END = 2
_CASED = "<\\||[Σİ\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff]"
_MARK = "\x01"
_STOP, _LETTER = (np.isin(np.arange(256), [*map(ord, chars)]) for chars in (".,!", "abcdefghijklmnopqrstuvwxyz0123456789"))


class TournamentTree:
    """Capacities of bins as leaves, the larger of two capacities at each inner node."""

    def __init__(self, capacity: int, bins: int):
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Puts a piece into the first bin that has room; the bin and the room it had."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        bin_, room = at - self.leaves, best[at]
        best[at] = room - size
        while at > 1:
            at //= 2
            best[at] = max(best[2 * at], best[2 * at + 1])
        return bin_, room


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each piece."""
    order = np.argsort(-sizes, kind="stable")
    # First fit leaves no two bins that are both at most half full.
    tree = TournamentTree(capacity, min(len(sizes), 2 * int(sizes.sum()) // capacity + 2))
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in order.tolist():
        bins[i], room = tree.place(int(sizes[i]))
        offsets[i] = capacity - room
    return bins, offsets


@lru_cache(2)
def _encoder(path: str):
    """Encodes many units: all ids, and the number of each unit's. Units are joined by a control character between blanks, which
    is a token of its own, so that one call of the library serves them all; units with that character go one by one."""
    from tokenizers import Tokenizer

    tokenizer, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
    for t in (tokenizer, plain):
        t.no_truncation()
        t.no_padding()
    plain.normalizer = None
    mark = tokenizer.encode(_MARK, add_special_tokens=False).ids

    def alone(units: list[str]) -> list[np.ndarray]:
        return [np.array(tokenizer.encode(u, add_special_tokens=False).ids, np.uint32) for u in units]

    def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(mark) != 1 or any(_MARK in u for u in units):
            each = alone(units)
            return np.concatenate(each), np.array([len(x) for x in each])
        joined = f" {_MARK} ".join(units)
        # Composed small letters are what the normalizer makes of a text; its blanks are dropped either way.
        normal = unicodedata.is_normalized("NFC", joined) and joined == joined.lower()
        ids = np.array((plain if normal else tokenizer).encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(ids == mark[0])
        return np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1

    return encode


def _cut(texts: pa.Array) -> pa.Array:
    """The texts with a blank between a small Latin letter or a digit and a stop that follows it, where a pretoken always ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    stops = np.flatnonzero(_STOP[data])
    stops = stops[stops > 0]
    before = data[stops - 1]
    latin = (before >= 0x9F) & (before != 0xB7) & (data[np.maximum(stops - 2, 0)] == 0xC3)
    at = stops[_LETTER[before] | latin]  # a blank at the start of a text that follows another one changes nothing
    data = np.insert(data, at, 32)
    offsets = (offsets - offsets[0] + np.searchsorted(at, offsets - offsets[0])).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(data))


def _units(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct units of a slice of texts, the place of each occurrence among them, and the number of units of each text.
    Units are runs without blanks, cut once more before stops. The tokenizer drops white space, so that these are independent,
    and lower-cases; lower-casing first makes fewer of them. Not where it could change more: some letters' lower case is more than a
    letter, a small one may join a combining mark that the capital doesn't, and special tokens are known by their case."""
    texts = pc.fill_null(texts, "")
    texts = pc.if_else(pc.match_substring_regex(texts, _CASED), texts, pc.utf8_lower(texts))
    parts = pc.ascii_split_whitespace(_cut(texts))
    units = parts.flatten().dictionary_encode()
    return units.dictionary.to_pylist(), units.indices.to_numpy(zero_copy_only=False), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents' token ids with the end token, cut at multiples of ``length``."""
    names = ["start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        cache = UnitCache(_encoder(vocabulary), at_once=4096)
        for batch in batches:
            for part in slices_of(batch, 1):
                flat, at = cache.coded(*_units(part.column(1)))
                row, out = [], []
                for i in range(part.num_rows):
                    ids = np.append(flat[at[i] : at[i + 1]], end).astype("<u4")
                    for s in range(0, len(ids), length):
                        piece = ids[s : s + length]
                        row.append(i)
                        out.append((s, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                columns = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *(pa.array(c) for c in columns)], names=[key, *names])

    chosen = spread(docs.select(F.col(key), F.col(text)))
    return chosen.mapInArrow(run, f"`{key}` {chosen.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n in names))


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END, key: str = "doc_id", text: str = "text", group_mb: float = 6.0, seed: int = 17) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. ``group_mb``: MB of stored documents to one packing group."""
    groups = parts_for(docs, group_mb)
    cut = pieces(docs, vocabulary, length, end, key, text)
    if length >= 1 << 31 or groups >= 1 << 31:
        raise ValueError("sequence numbers hold 31 bits of group and 32 of bin")
    cut = cut.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("start")), F.lit(groups)))

    def run(group: pa.Table) -> pa.Table:
        # Order within a group fixes the result, whatever order the exchange brought; Arrow keeps ids as they are beside nulls.
        group = group.take(pc.sort_indices(group, [(c, "ascending") for c in (key, "start", "ids_crc32")]))
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), length)
        sequences = group.column("_group").to_numpy() * (1 << 32) + bins
        return group.drop_columns(["_group"]).append_column("sequence_id", pa.array(sequences, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name != "_group")
    return cut.groupBy("_group").applyInArrow(run, f"{ddl}, sequence_id bigint, offset bigint")

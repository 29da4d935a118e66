"""Byte-pair encoding of a corpus by a public tokenizer, in numpy."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary lies (ranks in tiktoken's text format); read on the driver only.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that this vocabulary's texts are first split by: a fixed value of the tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = np.int32(2**31 - 1)
#: Pieces over this many bytes are merged over a heap instead of in a matrix (same ids).
MATRIX_BYTES = 1024
#: Cells of a matrix, and pieces a worker remembers; both bound memory, neither the result.
MATRIX_CELLS, MEMORY_PIECES = 4_000_000, 400_000


class PairTable:
    """Hash table (a, b) -> rank of a+b, with open addressing, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int32)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], self.probes)
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = first[free[first]]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[left[put]], ranks[left[put]]
            left = np.delete(left, put)
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        h = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return ((h + np.uint64(probe)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys, 0)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], NONE)
        left = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        for probe in range(1, self.probes):
            if not len(left):
                break
            slot = self._slot(keys[left], probe)
            hit = self.keys[slot] == keys[left]
            out[left[hit]] = self.ranks[slot[hit]]
            left = left[~hit & (self.keys[slot] >= 0)]
        return out


class BytePairEncoder:
    """Pieces of text to ids. ``ranks``: token bytes to id, which is also its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.shift = int(max(ranks.values())).bit_length()
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append((a << self.shift) | b)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32))

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        rank = self.pairs[(np.maximum(a, 0).astype(np.int64) << self.shift) | np.maximum(b, 0)]
        return np.where((a < 0) | (b < 0), NONE, rank)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece: pieces of like length stand in one padded matrix, so each round is a few array operations."""
        out: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * len(pieces)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        for i in np.flatnonzero(size > MATRIX_BYTES):
            out[i] = self._encode_long(pieces[i])
        short = np.flatnonzero((size > 0) & (size <= MATRIX_BYTES))
        bucket = np.where(size[short] <= 16, size[short], 1 << np.ceil(np.log2(np.maximum(size[short], 1))).astype(np.int64))
        for width in np.unique(bucket):
            rows = short[bucket == width]
            step = max(1, MATRIX_CELLS // int(width))
            for k in range(0, len(rows), step):
                self._encode_matrix(pieces, rows[k : k + step], size, int(width), out)
        return out

    def _encode_matrix(self, pieces: list[bytes], rows: np.ndarray, size: np.ndarray, width: int, out: list[np.ndarray]) -> None:
        ids = np.full((len(rows), width), -1, dtype=np.int32)
        flat = self.byte_ids[np.frombuffer(b"".join([pieces[i] for i in rows]), dtype=np.uint8)]
        ids[np.arange(width) < size[rows][:, None]] = flat
        rank = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while len(rows):
            if rank.shape[1]:
                at = rank.argmin(axis=1)  # the leftmost of the lowest rank
                low = rank[np.arange(len(rows)), at]
            else:
                at, low = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), NONE)
            done = low == NONE
            if done.any():
                for i, row in zip(rows[done], ids[done]):
                    out[i] = row[row >= 0]
                rows, ids, rank, at, low = rows[~done], ids[~done], rank[~done], at[~done], low[~done]
                if not len(rows):
                    return
            every = np.arange(len(rows))
            ids[every, at] = low  # a merged pair's id is its rank
            keep = np.ones(ids.shape, dtype=bool)
            keep[every, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            keep = np.ones(rank.shape, dtype=bool)
            keep[every, at] = False
            rank = rank[keep].reshape(len(rows), -1)
            for shift in (-1, 0):  # the two pairs that the new token is part of
                j = at + shift
                r = np.flatnonzero((j >= 0) & (j < rank.shape[1]))
                rank[r, j[r]] = self._rank(ids[r, j[r]], ids[r, j[r] + 1])

    def _encode_long(self, piece: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self._rank(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else n
                if x >= 0 and y < n:
                    r = int(self._rank(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if r != NONE:
                        heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], dtype=np.int32)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class TextEncoder:
    """Texts to ids; remembers the ids of the pieces it has met, so a repeated word is merged once a worker."""

    def __init__(self, encoder: BytePairEncoder, pattern: str = PATTERN):
        import regex

        self.encoder, self.split = encoder, regex.compile(pattern).findall
        self.place: dict[str, int] = {}
        self.flat, self.start = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def encode(self, texts: Iterable[str | None]) -> pa.ListArray:
        """One list of ids a text; a null and an empty text have no ids (an empty list)."""
        if len(self.place) > MEMORY_PIECES:
            self.place.clear()
            self.flat, self.start = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        used: list[int] = []
        count: list[int] = []
        new: list[bytes] = []
        place = self.place
        for text in texts:
            pieces = self.split(text) if text else ()
            count.append(len(pieces))
            for p in pieces:
                k = place.get(p)
                if k is None:
                    k = place[p] = len(place)
                    new.append(p.encode("utf-8", "surrogatepass"))
                used.append(k)
        if new:
            ids = self.encoder.encode(new)
            size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            self.flat = np.concatenate([self.flat, *ids])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size)])
        which = np.array(used, dtype=np.int64)
        length = self.start[which + 1] - self.start[which]
        end = np.cumsum(length)
        total = int(end[-1]) if len(end) else 0
        source = np.arange(total) - np.repeat(end - length, length) + np.repeat(self.start[which], length)
        bound = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(count)]).astype(np.int64)]
        return pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(self.flat[source], type=pa.int32()))


_WORKER: dict[int, TextEncoder] = {}
#: Texts are encoded in slices of about this many characters, so very long ones don't pile up in memory.
SLICE_CHARS = 4_000_000


def bpe_ids(spark: SparkSession, text: Column, path: str = BYTE_BPE_50K) -> Column:
    """array<int>: the ids of ``text`` without special tokens; their strings in a text are ordinary text.

    Null, empty: an empty list. The vocabulary is read on the driver and broadcast as arrays (a fixed file of a few MB).
    """
    tables = spark.sparkContext.broadcast(BytePairEncoder(read_ranks(path)))

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        encoder = _WORKER.get(tables.id if hasattr(tables, "id") else 0)
        if encoder is None:
            encoder = _WORKER.setdefault(tables.id if hasattr(tables, "id") else 0, TextEncoder(tables.value))
        parts, pending, chars = [], [], 0
        for text in column.to_pylist():
            pending.append(text)
            chars += len(text or "")
            if chars > SLICE_CHARS:
                parts.append(encoder.encode(pending))
                pending, chars = [], 0
        parts.append(encoder.encode(pending))
        return pa.concat_arrays(parts)

    return encode(text)

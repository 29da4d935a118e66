"""Evaluation passages inside documents: exact pieces by pigeonhole, then Myers' bit-parallel edit distance on words."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.operators.skew import salted_join
from ionloom.session import cut

#: A case holds MIN_WORDS consecutive words or more with at most one word in ERROR_EVERY edited.
MIN_WORDS, ERROR_EVERY = 20, 8
#: Windows of MIN_WORDS to 2 * MIN_WORDS - 1 words suffice: a longer case has a half that is one.
MAX_WORDS = 2 * MIN_WORDS - 1
#: Bits of the filter of item pieces that is sent to every task: 8 MB, however many items there are.
FILTER_BITS = 26
#: Documents are hashed in slices of about this many characters; words whose hashes a worker remembers. Both bound memory only.
SLICE_CHARS, MEMORY_WORDS = 4_000_000, 500_000

_LINE_HYPHEN = re.compile(r"[-‐‑­][^\S\n]*\n[\s>|]*(?=\w)")


def piece_words(min_words: int = MIN_WORDS, error_every: int = ERROR_EVERY) -> int:
    """The run of exact words that every window must hold: with k errors, its other words lie in k + 1 pieces."""
    return min(-(-(n - n // error_every) // (n // error_every + 1)) for n in range(min_words, 2 * min_words))


class _Letters(dict):
    """Translation that keeps letters, marks and digits, makes white space a blank and deletes the rest.

    Characters of scripts that are written without blanks (Han, kana) are words each.
    """

    def __missing__(self, code: int):
        ch = chr(code)
        kind = unicodedata.category(ch)
        alone = 0x3400 <= code <= 0x9FFF or 0x3041 <= code <= 0x30FF or 0xF900 <= code <= 0xFAFF or 0x20000 <= code <= 0x323AF
        self[code] = value = f" {ch} " if alone and kind == "Lo" else code if kind[0] in "LN" or kind in ("Mn", "Mc") else " " if ch.isspace() else None
        return value


_LETTERS = _Letters()


def words(text: str | None) -> list[str]:
    """Words without case, punctuation, invisible characters, quote marks, and hyphens at line ends."""
    if not text:
        return []
    if "\n" in text:
        text = _LINE_HYPHEN.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.casefold().translate(_LETTERS).split()


def prefix_distances(pattern: list[int], text: list[int]) -> np.ndarray:
    """best[i]: the least edit distance between pattern[:i] and any prefix of text, by Myers' bit vectors.

    A column of the distance matrix is held as two bit vectors of vertical differences; a word of the text updates
    all of them in a dozen operations. Both sequences start together, so the top row grows by one a column.
    """
    m = len(pattern)
    if not m:
        return np.zeros(1, dtype=np.int64)
    peq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | (1 << i)
    full = (1 << m) - 1
    pv, mv = full, 0
    ups, downs = [pv], [mv]
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        ups.append(pv)
        downs.append(mv)
    width = (m + 7) // 8
    bits = [np.unpackbits(np.frombuffer(b"".join(v.to_bytes(width, "little") for v in side), dtype=np.uint8).reshape(len(side), width), axis=1, bitorder="little")[:, :m].astype(np.int64) for side in (ups, downs)]
    column = np.arange(len(ups))[:, None] + np.concatenate([np.zeros((len(ups), 1), dtype=np.int64), np.cumsum(bits[0] - bits[1], axis=1)], axis=1)
    return column.min(axis=0)


class Matcher:
    """Finds which items a document quotes. ``items``: (item_id, words)."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.size = piece_words()
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        self.pieces: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, (item, ws) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]
            self.items.append((item, ids))
            if len(ids) >= MIN_WORDS - MIN_WORDS // ERROR_EVERY:
                for i in range(len(ids) - self.size + 1):
                    self.pieces.setdefault(tuple(ids[i : i + self.size]), []).append((k, i))

    def _holds(self, k: int, i: int, doc: list[int], j: int) -> bool:
        """Whether a window of item k around words i.. is quoted in doc around words j.., given that a piece there is equal."""
        ids, size, reach = self.items[k][1], self.size, MAX_WORDS - self.size
        slack = reach + MAX_WORDS // ERROR_EVERY
        near = set(ids[max(0, i - reach) : i + size + reach])
        least = MIN_WORDS - MIN_WORDS // ERROR_EVERY
        if sum(w in near for w in doc[max(0, j - slack) : j + size + slack]) < least:
            return False
        run = size
        while i + run < len(ids) and j + run < len(doc) and ids[i + run] == doc[j + run]:
            run += 1
        if run >= MIN_WORDS:
            return True
        right = prefix_distances(ids[i + size : i + size + reach], doc[j + size : j + size + slack])
        left = prefix_distances(ids[max(0, i - reach) : i][::-1], doc[max(0, j - slack) : j][::-1])
        length = size + np.arange(len(left))[:, None] + np.arange(len(right))[None, :]
        return bool(((length >= MIN_WORDS) & (left[:, None] + right[None, :] <= length // ERROR_EVERY)).any())

    def found(self, text: str | None) -> list[int]:
        return self.found_in(words(text))

    def found_in(self, ws: list[str]) -> list[int]:
        doc = [self.vocabulary.get(w, -1) for w in ws]
        hit: set[int] = set()
        seen: set[tuple[int, int]] = set()
        size, pieces = self.size, self.pieces
        run = 0
        for end, w in enumerate(doc):
            run = run + 1 if w >= 0 else 0
            if run < size:
                continue
            j = end - size + 1
            for k, i in pieces.get(tuple(doc[j : end + 1]), ()):
                if k in hit or (i and j and self.items[k][1][i - 1] == doc[j - 1] and (k, i - 1 - (j - 1)) in seen):
                    continue  # the run that this piece goes on was tried from its start
                seen.add((k, i - j))
                if self._holds(k, i, doc, j):
                    hit.add(k)
        return sorted({self.items[k][0] for k in hit})


class PieceHasher:
    """Hashes of all runs of ``size`` words in texts."""

    def __init__(self, size: int):
        self.size = size
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, hash) of every run."""
        if len(self.known) > MEMORY_WORDS:
            self.known.clear()
        known, hashed = self.known, []
        for ws in texts:
            for w in ws:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh3_64_intdigest(w)
                hashed.append(h)
        count = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        first = np.cumsum(count) - count
        runs = np.maximum(count - self.size + 1, 0)
        text = np.repeat(np.arange(len(texts)), runs)
        place = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
        word = np.array(hashed, dtype=np.uint64)
        at, h = first[text] + place, np.zeros(len(text), dtype=np.uint64)
        for k in range(self.size):
            h = (h ^ word[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        return text, place, h.view(np.int64)


def item_pieces(items: DataFrame) -> DataFrame:
    """(hash, item_id): the pieces of the items that are long enough to be a case, once each."""

    def run(batches):
        hasher = PieceHasher(piece_words())
        for b in batches:
            texts = [words(t) for t in b.column(1).to_pylist()]
            texts = [ws if len(ws) >= MIN_WORDS - MIN_WORDS // ERROR_EVERY else [] for ws in texts]
            text, _, h = hasher(texts)
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column(0).take(pa.array(text))], names=["hash", "item_id"])

    return items.select("item_id", "text").mapInArrow(run, "hash bigint, item_id bigint").distinct()


def piece_filter(pieces: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bytes with a bit set for the first ``bits`` bits of every piece's hash; built in parts of 4 KB, which are all that is collected."""
    bit = F.shiftrightunsigned("hash", 64 - bits)
    parts = pieces.groupBy(F.shiftright(bit, 15).alias("part")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32_767))).alias("b")).collect()
    out = np.zeros((1 << (bits - 15), 4096), dtype=np.uint8)
    for r in parts:
        out[r.part] = np.frombuffer(r.b, dtype=np.uint8)
    return out.ravel()


def hit_segments(documents: DataFrame, held: np.ndarray, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, segment, hashes): the stretches of a document around its runs of words that pass the filter.

    A segment has all words that a window around its hits can reach, so it tells as much as the whole text. Nearly all
    text is left behind here, in the one pass over the documents.
    """
    sent = documents.sparkSession.sparkContext.broadcast(held)
    size = piece_words()
    slack = MAX_WORDS - size + MAX_WORDS // ERROR_EVERY

    def run(batches):
        hasher = PieceHasher(size)
        for b in batches:
            column, n, lo = b.column(1), b.num_rows, 0
            length = np.cumsum(np.asarray(pa.compute.utf8_length(column)))
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(length, (length[lo - 1] if lo else 0) + SLICE_CHARS)))
                texts = [words(t) for t in column.slice(lo, hi - lo).to_pylist()]
                text, place, h = hasher(texts)
                bit = (h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
                hit = np.flatnonzero((sent.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                text, place, h = text[hit], place[hit], h[hit]
                # hits whose reaches touch share a segment
                new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (place[1:] - place[:-1] > 2 * slack + size)])) if len(hit) else np.empty(0, np.int64)
                end = np.concatenate([new[1:], [len(hit)]]).astype(np.int64)
                segments = [" ".join(texts[text[s]][max(0, place[s] - slack) : place[e - 1] + size + slack]) for s, e in zip(new, end)]
                hashes = pa.ListArray.from_arrays(pa.array(np.concatenate([new, [len(hit)]]).astype(np.int32)), pa.array(h))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + text[new])), pa.array(segments, type=pa.string()), hashes], names=["doc_id", "segment", "hashes"])
                lo = hi

    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, "doc_id bigint, segment string, hashes array<bigint>")


def quoted_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold MIN_WORDS or more consecutive words of an item, one word in eight edited.

    Null, empty and blank texts hold nothing; items of fewer words can't be cases; a repeated doc_id or item_id counts
    once, by any of its texts; whole texts are read, however long; empty tables give an empty result.

    One pass over the documents, whatever the size of the items: a filter of fixed size lets through stretches with
    pieces of items; hashed pieces of both sides are joined, and each pair of a stretch and an item is verified. A piece
    or an item with many documents is spread over salts.
    """
    held = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")
    pieces = cut(item_pieces(held))
    segments = cut(hit_segments(documents, piece_filter(pieces)).withColumn("s", F.monotonically_increasing_id()))
    pairs = cut(salted_join(segments.select("s", F.explode("hashes").alias("hash")), pieces, "hash").select("s", "item_id").distinct())
    full = salted_join(pairs.join(segments.select("s", "doc_id", "segment"), "s"), held.withColumnRenamed("text", "item"), "item_id", sample=pairs)

    def verify(batches):
        matchers: dict[str, Matcher] = {}
        for b in batches:
            keep = []
            for k, (segment, item) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                if item not in matchers:
                    if len(matchers) >= 1000:
                        matchers.clear()
                    matchers[item] = Matcher([(0, words(item))])
                if matchers[item].found_in(segment.split()):
                    keep.append(k)
            at = pa.array(keep, type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["doc_id", "item_id"])

    return full.select("doc_id", "item_id", "segment", "item").mapInArrow(verify, "doc_id bigint, item_id bigint").distinct()

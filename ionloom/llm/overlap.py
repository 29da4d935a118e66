"""The same record in two splits: n-gram hashes, containment, then an exact check."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.operators.skew import salted_join
from ionloom.session import cut

#: Two peaks agree within MZ_TOL of m/z and INT_ABS plus INT_REL of the larger intensity (base peak 1).
MZ_TOL, INT_ABS, INT_REL = 0.015, 0.002, 0.1
MIN_PEAKS, MIN_SHARE = 8, 0.75
#: Bins of the n-gram words. On ln(intensity + INT_ABS / INT_REL), agreeing intensities differ by LOG_TOL at most.
LOG_TOL = -math.log(1 - INT_REL)
MZ_BIN, LOG_BIN = 4 * MZ_TOL, 4 * LOG_TOL
#: Two peaks may stand in another order in the other spectrum if they are this close.
CLOSE = 2 * MZ_TOL * (1 + 1e-3)
#: The rows of a batch stand this far apart on one axis of m/z.
_STEP = 1e7
#: One train row in so many (by hash) tells which grams are hot; that only spreads the join.
HOT_SAMPLE = 16


def _offsets(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.offsets)


def clean_peaks(mz_lists: pa.ListArray, int_lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, mz, intensity) of a batch's peaks, by row and m/z, intensities scaled to a base peak of 1.

    Null lists and lists of unlike length have no peaks; null, NaN and infinite values, m/z of 0 or less and
    intensities below 0 are no peaks; a row without a positive intensity has none.
    """
    n = len(mz_lists)
    size = [np.where(np.asarray(x.is_null()), 0, np.asarray(x.value_lengths().fill_null(0))) for x in (mz_lists, int_lists)]
    ok = size[0] == size[1]
    flat = [np.asarray(x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=float) for x in (mz_lists, int_lists)]
    row = [np.repeat(np.arange(n), s) for s in size]
    mz, inten = (v[ok[r]] for v, r in zip(flat, row))
    row = row[0][ok[row[0]]]
    good = np.isfinite(mz) & np.isfinite(inten) & (mz > 0) & (inten >= 0)
    row, mz, inten = row[good], mz[good], inten[good]
    top = np.zeros(n)
    np.maximum.at(top, row, inten)
    good = top[row] > 0
    row, mz, inten = row[good], mz[good], inten[good]
    order = np.lexsort((inten, mz, row))
    return row[order], mz[order], inten[order] / top[row[order]]


def _bins(mz: np.ndarray, inten: np.ndarray) -> np.ndarray:
    """(4, peaks): the lowest and highest bin of m/z, and of log intensity, that an agreeing peak can lie in."""
    log = np.log(inten + INT_ABS / INT_REL) - math.log(INT_ABS / INT_REL)
    return np.stack([np.floor((v + s * tol * (1 + 1e-6)) / width).astype(np.int64) for v, tol, width in ((mz, MZ_TOL, MZ_BIN), (log, LOG_TOL, LOG_BIN)) for s in (-1, 1)])


def _key(words: list[np.ndarray]) -> np.ndarray:
    key = np.zeros(len(words[0]), dtype=np.int64)
    for value, bits in zip(words, (21, 5, 21, 5)):
        key = (key << bits) | (value & ((1 << bits) - 1))
    return key


def neighbour_grams(row: np.ndarray, mz: np.ndarray, inten: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of every two neighbouring peaks; a peak's word is its bin of m/z and of log intensity."""
    log = np.log(inten + INT_ABS / INT_REL) - math.log(INT_ABS / INT_REL)
    a, b = np.floor(mz / MZ_BIN).astype(np.int64), np.floor(log / LOG_BIN).astype(np.int64)
    i = np.flatnonzero(row[1:] == row[:-1])
    return row[i], _key([a[i], b[i], a[i + 1], b[i + 1]])


def probe_grams(row: np.ndarray, mz: np.ndarray, inten: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of every two peaks that may be neighbours in another spectrum, by every bin within the tolerance.

    Peaks can only change their order if they are CLOSE. So neighbours there are here: two peaks between which, unpaired
    peaks aside, all are CLOSE above the first or CLOSE below the second; and, either way round, any two CLOSE ones.
    A run of peaks of the same bins gives the same grams, so one stands for it, with itself as a neighbour.
    """
    bins = _bins(mz, inten)
    same = (row[1:] == row[:-1]) & (bins[:, 1:] == bins[:, :-1]).all(axis=0)
    first = np.concatenate([[True], ~same])[: len(row)]
    twice = np.flatnonzero(first & np.concatenate([same, [False]])[: len(row)])
    row, mz, bins, twice = row[first], mz[first], bins[:, first], (np.cumsum(first) - 1)[twice]
    left, right = [twice], [twice]
    n = len(row)
    p = np.arange(n - 1)
    line = np.minimum(mz, 0.9 * _STEP) + row * _STEP  # all rows' peaks on one axis
    lag = 1
    while len(p):
        p = p[p + lag < n]
        p = p[row[p] == row[p + lag]]
        near = mz[p + lag] - mz[p] <= CLOSE
        # all between are close to an end if the last that isn't close above p is close below the other: gaps grow with the lag
        beyond = np.searchsorted(line, line[p] + CLOSE, "right")
        ok = (beyond >= p + lag) | (mz[p + lag] - mz[np.minimum(beyond, n - 1)] <= CLOSE)
        left += [p[ok], p[near] + lag]
        right += [p[ok] + lag, p[near]]
        # a longer lag can only do where the peaks after p that aren't close above it lie within CLOSE of each other
        p = p[ok]
        lag += 1
    left, right = np.concatenate(left), np.concatenate(right)
    words = [bins[0:2, left], bins[2:4, left], bins[0:2, right], bins[2:4, right]]
    at, chosen = np.arange(len(left)), []
    for low, high in words:
        two = np.flatnonzero(high[at] > low[at])
        chosen = [np.concatenate([c, c[two]]) for c in chosen] + [np.concatenate([low[at], high[at[two]]])]
        at = np.concatenate([at, at[two]])
    return row[left[at]], _key(chosen)


def _grams(df: DataFrame, ident: str, kind: str, probe: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            row, mz, inten = clean_peaks(b.column(1), b.column(2))
            peaks = np.bincount(row, minlength=b.num_rows)
            enough = peaks[row] >= MIN_PEAKS
            who, key = (probe_grams if probe else neighbour_grams)(row[enough], mz[enough], inten[enough])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who)), pa.array(key), pa.array(peaks[who].astype(np.int32))], names=["id", "gram", "peaks"])

    return df.select(ident, F.col("ms2_mzs").cast("array<double>"), F.col("ms2_normalized_intensities").cast("array<double>")).mapInArrow(run, f"id {kind}, gram bigint, peaks int")


def agreeing_peaks(mz_a: np.ndarray, int_a: np.ndarray, mz_b: np.ndarray, int_b: np.ndarray) -> int:
    """The most peaks of a and b (sorted by m/z) that pair off, each with one peak of the other."""
    low = np.searchsorted(mz_b, mz_a - MZ_TOL * (1 + 1e-9), "left")
    high = np.searchsorted(mz_b, mz_a + MZ_TOL * (1 + 1e-9), "right")
    if (high - low <= 1).all() and (np.diff(low[high > low]) > 0).all():  # no peak has a choice
        i = np.flatnonzero(high > low)
        a, b = int_a[i], int_b[low[i]]
        return int((np.abs(a - b) <= (INT_ABS + INT_REL * np.maximum(a, b)) * (1 + 1e-9)).sum())
    fits = [[j for j in range(lo, hi) if abs(x - int_b[j]) <= (INT_ABS + INT_REL * max(x, int_b[j])) * (1 + 1e-9)] for x, lo, hi in zip(int_a, low, high)]
    owner: dict[int, int] = {}

    def place(i: int, tried: set[int]) -> bool:
        for j in fits[i]:
            if j not in tried:
                tried.add(j)
                if j not in owner or place(owner[j], tried):
                    owner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(fits)))


def _verified(pairs: DataFrame, schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            sides = []
            for k in (2, 4):
                row, mz, inten = clean_peaks(b.column(k), b.column(k + 1))
                sides.append((mz, inten, np.searchsorted(row, np.arange(b.num_rows + 1))))
            (mz_a, int_a, cut_a), (mz_b, int_b, cut_b) = sides
            share = np.zeros(b.num_rows)
            for i in range(b.num_rows):
                a, z, c, y = cut_a[i], cut_a[i + 1], cut_b[i], cut_b[i + 1]
                if min(z - a, y - c) >= MIN_PEAKS:
                    share[i] = agreeing_peaks(mz_a[a:z], int_a[a:z], mz_b[c:y], int_b[c:y]) / max(z - a, y - c)
            keep = pa.array(np.flatnonzero(share >= MIN_SHARE))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array(share).take(keep)], names=["row_id", "spectrum_id", "share"])

    return pairs.mapInArrow(run, schema)


def candidate_pairs(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(row_id, spectrum_id, hits, n, m): pairs whose common grams reach the number that three quarters of agreeing peaks imply.

    Of n and m peaks k pair off. At least 2k - n - 1 neighbours in the train spectrum are both paired, and their
    partners are a pair of :func:`probe_grams` unless an unpaired peak stands between them that is close to neither; such a
    peak can part one pair only, so 3k - n - m - 1 grams are common: one or more from 8 peaks on. None is lost.

    A gram with many train rows is spread over salts; AQE broadcasts the evaluation grams where they are few.
    """
    named = lambda df: _grams(df, "row_id", "bigint", probe=False).withColumnsRenamed({"id": "row_id", "peaks": "n"})
    t, some = named(train), named(train.where(F.pmod(F.xxhash64("row_id"), F.lit(HOT_SAMPLE)) == 0))
    e = _grams(evaluation, "spectrum_id", "string", probe=True).withColumnsRenamed({"id": "spectrum_id", "peaks": "m"}).distinct()
    hits = salted_join(t, e, "gram", sample=some).groupBy("row_id", "spectrum_id").agg(F.count("*").alias("hits"), F.first("n").alias("n"), F.first("m").alias("m"))
    most = F.greatest("n", "m")
    needed = F.greatest(F.lit(1), 3 * F.ceil(most * MIN_SHARE) - F.col("n") - F.col("m") - 1)
    return hits.where((F.col("hits") >= needed) & (F.least("n", "m") >= most * MIN_SHARE)).select("row_id", "spectrum_id", "hits", "n", "m")


def cross_split_overlaps(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(row_id, spectrum_id, share): all pairs of a train and an evaluation spectrum that hold one measurement.

    ``share``: agreeing peaks over those of the spectrum with more, at least three quarters. Null, empty and short
    peak lists (under 8 peaks) match nothing; a row_id or spectrum_id that stands there more than once counts by any
    of its rows; adducts, energies and libraries aren't read; empty tables give an empty result.
    """
    peaks = ("ms2_mzs", "ms2_normalized_intensities")
    found = cut(candidate_pairs(train, evaluation).select("row_id", "spectrum_id"))
    left = train.select("row_id", F.col(peaks[0]).alias("mz_a"), F.col(peaks[1]).alias("int_a"))
    right = evaluation.select("spectrum_id", F.col(peaks[0]).alias("mz_b"), F.col(peaks[1]).alias("int_b"))
    # a row that many others hold is spread over salts on either side
    full = salted_join(salted_join(found, left, "row_id"), right, "spectrum_id", sample=found).select("row_id", "spectrum_id", "mz_a", "int_a", "mz_b", "int_b")
    doubles = [F.col(c).cast("array<double>").alias(c) for c in ("mz_a", "int_a", "mz_b", "int_b")]
    shares = _verified(full.select("row_id", "spectrum_id", *doubles), "row_id bigint, spectrum_id string, share double")
    return shares.groupBy("row_id", "spectrum_id").agg(F.max("share").alias("share"))

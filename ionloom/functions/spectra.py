"""Peak lists as arrays of (mz, intensity)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ionloom.functions.binding import let

# Fixed values of the quality rule and of peak preparation.
MAX_PPM_ERROR, MIN_PEAKS, MAX_ABOVE_PRECURSOR = 20.0, 3, 3.0
MIN_INTENSITY, PRECURSOR_MARGIN, BIN_WIDTH, MAX_MZ, TOP_PEAKS = 0.01, 1.5, 0.1, 1000.0, 100


def peaks(mzs: Column, intensities: Column) -> Column:
    """array<struct<mz, i>>; NULL if either list is."""
    return F.transform(F.arrays_zip(mzs.alias("mz"), intensities.alias("i")), lambda p: F.struct(p["mz"].alias("mz"), p["i"].alias("i")))


def is_clean(ppm_error: Column, num_peaks: Column, mzs: Column, precursor: Column) -> Column:
    """Small mass error, enough peaks, none far above the precursor; an unknown error or list passes, an unknown count doesn't."""
    return (
        F.coalesce(F.abs(ppm_error) <= MAX_PPM_ERROR, F.lit(True))
        & (num_peaks >= MIN_PEAKS)
        & F.coalesce(F.array_max(mzs) - precursor <= MAX_ABOVE_PRECURSOR, F.lit(True))
    )


def unit_peaks(p: Column, precursor: Column) -> Column:
    """Peaks of MIN_INTENSITY or more below the precursor region, roots of intensities scaled to unit length."""
    kept = F.transform(F.filter(p, lambda x: (x.i >= MIN_INTENSITY) & (x.mz < precursor - PRECURSOR_MARGIN)), lambda x: F.struct(x.mz.alias("mz"), F.sqrt(x.i).alias("i")))
    length = let(lambda s: F.struct(s["p"].alias("p"), F.sqrt(F.aggregate(s["p"], F.lit(0.0), lambda a, x: a + x.i * x.i)).alias("n")), p=kept)
    return let(lambda s: F.transform(s["u"]["p"], lambda x: F.struct(x.mz.alias("mz"), F.when(s["u"]["n"] > 0, x.i / s["u"]["n"]).otherwise(x.i).alias("i"))), u=length)


def top_peaks(p: Column, n: int = TOP_PEAKS) -> Column:
    """The ``n`` most intense peaks, ties to the lower m/z, in order of m/z."""
    best = F.slice(F.array_sort(F.transform(p, lambda x: F.struct((-x.i).alias("o"), x.mz.alias("mz"), x.i.alias("i")))), 1, n)
    return F.array_sort(F.transform(best, lambda x: F.struct(x.mz.alias("mz"), x.i.alias("i"))))


def binned(p: Column, n: int = TOP_PEAKS) -> Column:
    """(bin, root of intensity) of the top peaks below MAX_MZ; the bin is the whole part of m/z over BIN_WIDTH."""
    return F.transform(top_peaks(F.filter(p, lambda x: x.mz < MAX_MZ), n), lambda x: F.struct((x.mz / BIN_WIDTH).cast("int").alias("bin"), F.sqrt(x.i).alias("v")))


def model_peaks(p: Column, precursor: Column, n: int = TOP_PEAKS) -> Column:
    """The precursor as (m/z, 1.1), then the top peaks by m/z with intensities over the largest."""
    best = let(lambda s: F.struct(s["p"].alias("p"), F.array_max(F.transform(s["p"], lambda x: x.i)).alias("top")), p=top_peaks(p, n))
    scaled = let(lambda s: F.transform(s["b"]["p"], lambda x: F.struct(x.mz.alias("mz"), (x.i / s["b"]["top"]).alias("i"))), b=best)
    return F.concat(F.array(F.struct(precursor.alias("mz"), F.lit(1.1).alias("i"))), scaled)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, mz, intensity) of a batch of peak lists, by pair, m/z and intensity."""
    size = np.asarray(lists.value_lengths().fill_null(0))
    flat = lists.flatten()
    mz, inten = (np.asarray(flat.field(k).to_numpy(zero_copy_only=False), dtype=float) for k in (0, 1))
    pair = np.repeat(np.arange(len(lists)), size)
    order = np.lexsort((inten, mz, pair))
    return pair[order], mz[order], inten[order]


def match_peaks(query: pa.ListArray, other: pa.ListArray, tolerance: float) -> np.ndarray:
    """Per pair of peak lists, the sum of products of matched peaks: one sorted lookup for a whole batch."""
    n = len(query)
    if not n:
        return np.zeros(0)
    (a, x, xi), (b, y, yi) = _flat(query), _flat(other)
    if not len(a) or not len(b):
        return np.zeros(n)
    step = max(x.max(), y.max()) + 1.0
    place = y + b * step
    at = np.searchsorted(place, x + a * step, "left")  # the first peak at or above, in this pair or the next
    total = np.zeros(n)
    right, left = np.minimum(at, len(b) - 1), np.maximum(at - 1, 0)
    left = np.searchsorted(place, place[left], "left")  # of equal peaks the first
    ok_r = (at < len(b)) & (b[right] == a) & (np.abs(y[right] - x) <= tolerance)
    ok_l = (at > 0) & (b[left] == a) & (np.abs(y[left] - x) <= tolerance)
    use_l = ok_l & (~ok_r | (np.abs(y[left] - x) < np.abs(y[right] - x)))
    chosen = np.where(use_l, left, right)
    hit = ok_r | ok_l
    np.add.at(total, a[hit], xi[hit] * yi[chosen[hit]])
    return total


def peak_cosine(query: Column, other: Column, tolerance: float = 0.01) -> Column:
    """Sum of products over each query peak's nearest peak of ``other`` within the tolerance, at most 1; 0 if none.

    Of two peaks equally near the higher m/z counts; a peak of ``other`` may serve several query peaks. Runs on Arrow
    batches of pairs: nested lambdas would compare every peak with every other.
    """

    @F.arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(np.minimum(match_peaks(a, b, tolerance), 1.0))

    return score(query, other)


def coverage(p: Column, others: Column, tolerance: float = 0.01) -> Column:
    """Share of the intensity of ``p`` whose peaks lie nearer than the tolerance to an m/z of ``others``."""
    hit = F.aggregate(F.filter(p, lambda x: F.exists(others, lambda o: F.abs(o - x.mz) < tolerance)), F.lit(0.0), lambda a, x: a + x.i)
    return F.try_divide(hit, F.aggregate(p, F.lit(0.0), lambda a, x: a + x.i))

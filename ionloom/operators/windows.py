"""Scores of all pairs inside a mass window, in groups of near masses: both sides are shuffled, pairs never are."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions.vectors import EPSILON
from ionloom.operators.skew import salted_join
from ionloom.session import cut

#: Windows that a cell of log mass is wide: most queries touch one cell. Library spectra that one task of a search takes.
CELL_WINDOWS, SPECTRA = 32, 20_000
#: Places of a search.
TOP = 25


def cell(mass: Column, ppm: float) -> Column:
    return F.floor(F.ln(mass) / (CELL_WINDOWS * math.log1p(2e-6 * ppm)))


def bounded(queries: DataFrame, mass: str, ppm: float) -> DataFrame:
    """``queries`` with __low and __high of their windows, once for each __cell that the window touches; null, NaN and masses of 0 or less match nothing."""
    w = ppm * 1e-6
    q = queries.where((F.col(mass) > 0) & ~F.isnan(mass)).withColumn("__low", F.col(mass) - F.col(mass) * w).withColumn("__high", F.col(mass) + F.col(mass) * w)
    return q.withColumn("__cell", F.explode(F.sequence(cell(F.col("__low"), ppm), cell(F.col("__high"), ppm))))


class PeakIndex:
    """The peaks of many lists in order of m/z: a query costs what it hits, not a comparison with every list."""

    def __init__(self, mzs: pa.Array, intensities: pa.Array, tolerance: float = 0.01):
        self.tolerance, self.n = tolerance, len(mzs)
        size = np.asarray(mzs.value_lengths().fill_null(0))
        mz, inten = (np.asarray(x.flatten().to_numpy(zero_copy_only=False), dtype=float) for x in (mzs, intensities))
        owner = np.repeat(np.arange(self.n, dtype=np.int32), size)
        # peaks with another of their list so near that one query peak may meet both
        by = np.lexsort((mz, owner))
        close = (owner[by][1:] == owner[by][:-1]) & (mz[by][1:] - mz[by][:-1] <= 2 * tolerance + 1e-6)
        crowded = np.zeros(len(mz), dtype=bool)
        crowded[by[1:][close]] = crowded[by[:-1][close]] = True
        order = np.argsort(mz, kind="stable")
        self.mz, self.intensity, self.owner, self.crowded = mz[order], inten[order], owner[order], crowded[order]

    def cosines(self, mz: np.ndarray, inten: np.ndarray) -> np.ndarray:
        """Per list, the sum of products over each query peak's nearest peak within the tolerance, at most 1.

        Of two peaks equally near the higher m/z counts, of equal m/z the lower intensity.
        """
        low, high = np.searchsorted(self.mz, mz - self.tolerance - 1e-9, "left"), np.searchsorted(self.mz, mz + self.tolerance + 1e-9, "right")
        for end, step in ((low, 1), (high, -1)):  # the exact bounds
            while True:
                at = np.minimum(end if step == 1 else end - 1, len(self.mz) - 1)
                out = (low < high) & (np.abs(self.mz[at] - mz) > self.tolerance) if len(self.mz) else np.zeros(len(mz), dtype=bool)
                if not out.any():
                    break
                end[out] += step
        n = high - low
        hit = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        peak = np.repeat(np.arange(len(mz)), n)
        owner = self.owner[hit]
        k = np.flatnonzero(self.crowded[hit])
        if len(k):
            code, b = owner[k].astype(np.int64) * len(mz) + peak[k], self.mz[hit[k]]
            order = np.lexsort((self.intensity[hit[k]], -b, np.abs(b - mz[peak[k]]), code))
            again = np.zeros(len(k), dtype=bool)
            again[1:] = code[order][1:] == code[order][:-1]
            keep = np.ones(len(hit), dtype=bool)
            keep[k[order[again]]] = False
            hit, peak, owner = hit[keep], peak[keep], owner[keep]
        return np.fmin(np.bincount(owner, weights=self.intensity[hit] * inten[peak], minlength=self.n), 1.0)


def _lists(mzs: pa.Array, intensities: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, mz, intensity) of the peak lists, those of list i from offsets[i] to offsets[i + 1]."""
    size = np.asarray(mzs.value_lengths().fill_null(0))
    return np.concatenate([[0], np.cumsum(size)]), *(np.asarray(x.flatten().to_numpy(zero_copy_only=False), dtype=float) for x in (mzs, intensities))


def _codes(library: pa.ChunkedArray, asked: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal values of both sides; a null equals nothing."""
    both = pa.concat_arrays([*library.chunks, *asked.chunks]).dictionary_encode().indices.fill_null(-1).to_numpy()
    a, b = both[: len(library)], both[len(library) :].copy()
    b[b < 0] = -2
    return a, b


def _one(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def rounded(x: np.ndarray, digits: int = 9) -> np.ndarray:
    """Halves away from zero."""
    scale = 10.0**digits
    return np.sign(x) * np.floor(np.abs(x) * scale + 0.5) / scale


_FOUND = pa.schema([("molecule", pa.string()), ("key", pa.string()), ("q", pa.string()), ("n", pa.int64()), ("err", pa.float64()), ("s", pa.float64()), ("exact", pa.float64()), ("other", pa.float64())])
_FOUND_SQL = "molecule string, key string, q string, n bigint, err double, s double, exact double, other double"


def _search_group(library: pa.Table, asked: pa.Table, same: str) -> pa.Table:
    """Of each molecule the TOP best keys of a group by the sum ``s`` of its spectra's best scores; of a key in pieces each spectrum's best here."""
    if not library.num_rows or not asked.num_rows:
        return _FOUND.empty_table()
    library, asked = library.sort_by([("mass", "ascending"), ("key", "ascending")]), asked.sort_by("molecule")
    codes = {c: _codes(library.column("o_" + c), asked.column(c)) for c in ("adduct", "mode", "energy")}
    keys = _one(library.column("key")).dictionary_encode()
    new = np.flatnonzero(np.diff(keys.indices.to_numpy(), prepend=-1))
    start, names = np.append(new, library.num_rows), np.array(keys.dictionary.to_pylist(), dtype=object)
    place = np.argsort(np.argsort(names))  # the keys' order as text
    mass = library.column("mass").to_numpy()[new]
    index = PeakIndex(_one(library.column("o_mz")), _one(library.column("o_i")))
    split = library.column("pieces")[0].as_py() > 1
    at, mz, inten = _lists(_one(asked.column("mz")), _one(asked.column("i")))
    molecule, spectrum = asked.column("molecule").to_pylist(), asked.column("q").to_pylist()
    low, high, m, n = (asked.column(c).to_numpy() for c in ("low", "high", "m", "n"))
    first, last = np.searchsorted(mass, low, "left"), np.searchsorted(mass, high, "right")
    starts = [i for i in range(len(molecule)) if not i or molecule[i] != molecule[i - 1]] + [len(molecule)]
    out = []
    for lo, hi in zip(starts, starts[1:]):
        a, b = first[lo], last[lo]
        if a >= b:
            continue
        s, e = start[a], start[b]
        of = start[a:b] - s
        err = np.abs(mass[a:b] - m[lo]) / m[lo] * 1e6
        total, met = np.zeros(b - a), np.zeros(b - a, dtype=bool)
        for r in range(lo, hi):
            score = index.cosines(mz[at[r] : at[r + 1]], inten[at[r] : at[r + 1]])[s:e]
            adduct = codes["adduct"][0][s:e] == codes["adduct"][1][r]
            exact = np.maximum.reduceat(np.where(adduct & (codes["energy"][0][s:e] == codes["energy"][1][r]), score, -1.0), of)
            other = np.maximum.reduceat(np.where(adduct if same == "adduct" else codes[same][0][s:e] == codes[same][1][r], score, -1.0), of)
            if split:
                k = np.flatnonzero((exact >= 0) | (other >= 0))
                out += [(molecule[r], names[a + i], spectrum[r], int(n[r]), float(err[i]), None, *(float(x[i]) if x[i] >= 0 else None for x in (exact, other))) for i in k]
                continue
            best = np.where(exact >= 0, exact, other)
            met |= best >= 0
            total += np.maximum(best, 0.0)
        k = np.flatnonzero(met)
        if len(k) > TOP:
            k = k[np.lexsort((place[a + k], err[k], -rounded(total[k] / n[lo])))[:TOP]]
        out += [(molecule[lo], names[a + i], "", int(n[lo]), float(err[i]), float(total[i]), None, None) for i in k]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), _FOUND.types)], schema=_FOUND) if out else _FOUND.empty_table()


def search_library(masses: DataFrame, queries: DataFrame, found: DataFrame, spectra: DataFrame, keys: DataFrame, same: str, *, ppm: float = 10.0, limit: int | None = None) -> DataFrame:
    """(molecule_id, key, score, rank): the TOP keys of each molecule by the mean over its spectra of the best cosine with a key's comparable spectra.

    ``masses`` (molecule_id, m), ``queries`` (molecule_id, q, adduct, mode, energy, p), ``found`` (key, mass), ``spectra``
    (o, key, o_adduct, o_mode, o_energy, o_p), ``keys`` (key): those of the spectra, cheaper to count. Comparable are those of the query's adduct and energy if the key has any,
    else those of its ``same`` ('mode' or 'adduct'). Ties go to the nearer mass, then the smaller key.

    Keys are put into cells of near masses, cells into groups of about ``limit`` spectra (SPECTRA), and the queries are sent
    to the groups of the cells that their window touches. A group compares and keeps TOP keys a molecule. A key with more
    spectra than that is compared in pieces, whose best scores are put together.
    """
    limit = limit or SPECTRA
    located = keys.groupBy("key").agg(F.count("*").alias("rows")).join(found.where((F.col("mass") > 0) & ~F.isnan("mass")), "key").withColumn("__cell", cell(F.col("mass"), ppm))
    groups = F.ceil(F.col("all") / limit)
    label = F.when(F.col("rows") > limit, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), groups).cast("string"))
    located = located.join(located.groupBy("__cell").agg(F.sum("rows").alias("all")), "__cell")
    located = cut(located.select("key", "mass", "__cell", F.concat_ws("|", F.col("__cell").cast("string"), label).alias("label"), F.when(F.col("rows") > limit, F.ceil(F.col("rows") / limit)).otherwise(F.lit(1)).cast("bigint").alias("pieces")))
    group = lambda piece: F.concat_ws("|", F.col("label"), piece.cast("string")).alias("g")
    slim = spectra.select("o", "key", "o_adduct", "o_mode", "o_energy", F.col("o_p.mz").alias("o_mz"), F.col("o_p.i").alias("o_i"))  # two arrays take half of what structs do
    home = salted_join(slim, located, "key", sample=keys).select(group(F.pmod(F.xxhash64("o"), F.col("pieces"))), "key", "mass", "pieces", "o_adduct", "o_mode", "o_energy", "o_mz", "o_i")
    plan = located.select("__cell", "label", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")).select("__cell", group(F.col("piece"))).distinct()
    counts = queries.groupBy("molecule_id").agg(F.count("*").alias("n"))
    wanted = bounded(masses.join(counts, "molecule_id"), "m", ppm).join(plan, "__cell").select("g", "molecule_id", "m", "n", "__low", "__high")
    p = F.array_distinct("p")  # equal peaks of a query count once
    asked = queries.select("molecule_id", "q", "adduct", "mode", "energy", p.alias("p")).join(wanted, "molecule_id")
    asked = asked.select("g", F.col("molecule_id").alias("molecule"), "q", "adduct", "mode", "energy", "m", "n", F.col("__low").alias("low"), F.col("__high").alias("high"), F.col("p.mz").alias("mz"), F.col("p.i").alias("i"))
    parts = home.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(lambda a, b: _search_group(a, b, same), _FOUND_SQL)
    spectrum = parts.groupBy("molecule", "key", "q").agg(*[F.max(c).alias(c) for c in ("n", "err", "s", "exact", "other")])
    best = F.coalesce("s", F.greatest(F.coalesce("exact", "other"), F.lit(0.0)))
    means = spectrum.groupBy("molecule", "key").agg((F.sum(best) / F.max("n")).alias("score"), F.max("err").alias("err"))
    order = Window.partitionBy("molecule").orderBy(F.desc(F.round("score", 9)), "err", "key")
    return means.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= TOP).select(F.col("molecule").alias("molecule_id"), "key", "score", "rank")


#: Library keys of a group of a ranking, and queries that it scores at once.
KEYS, AT_ONCE = 8192, 256
#: Keys that the windows of a block may take together, however narrow each is; near scores a query from which equal bits are looked for; near scores that are added up in order at once.
LEAST_SPAN, TIES, EXACT = 256, 4, 16_384
#: Scores nearer than this are compared after they are rounded; far above what the order of a sum changes.
NEAR = 1e-7


def _log_odds(p: np.ndarray) -> np.ndarray:
    clipped = np.clip(p, EPSILON, 1 - EPSILON)
    return np.log(clipped) - np.log(1 - clipped)


#: The scorers of ``functions.vectors.SCORERS`` from (sum of products with the weights, sum of p, sum of bits), and whether their weights are log odds.
_MATRIX = {
    "likelihood": (True, lambda d, p, b: d),
    "tanimoto": (False, lambda d, p, b: d / (p + b - d)),
    "dot": (False, lambda d, p, b: d),
    "dot_over_root": (False, lambda d, p, b: d / np.sqrt(np.maximum(b, 1.0))),
}


def _in_order(x: np.ndarray) -> np.ndarray:
    """Sums of rows, added up from left to right."""
    return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _blocks(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Queries in order of ``first`` in blocks of AT_ONCE at most whose windows together take little more than the widest: what lies outside a window is scored in vain."""
    out, at = [], 0
    while at < len(first):
        end = last[at : at + AT_ONCE]
        span = np.maximum.accumulate(end) - first[at]
        widest = np.maximum.accumulate(end - first[at : at + AT_ONCE])
        out.append((at, at := at + max(1, int(np.argmax(np.append(span > np.maximum(LEAST_SPAN, 1.5 * widest), True))))))
    return out


def _patterns(rows: np.ndarray) -> np.ndarray:
    """Equal numbers for equal rows."""
    if not rows.shape[1]:
        return np.zeros(len(rows), dtype=np.int64)
    return np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel(), return_inverse=True)[1].ravel()


def _rank_group(library: pa.Table, asked: pa.Table, scorers: tuple[str, ...]) -> pa.Table:
    """(query, n, before_<scorer>): the keys in each query's window, and those that come before the true one; NULL if that isn't a candidate."""
    schema = pa.schema([("query", pa.string()), ("n", pa.int64())] + [(f"before_{s}", pa.int64()) for s in scorers])
    if not library.num_rows or not asked.num_rows:
        return schema.empty_table()
    library = library.sort_by("mass")
    plain = lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
    matrix = lambda c: np.asarray(plain(c), dtype=float)
    mass, bits, p = library.column("mass").to_numpy(), matrix(_one(library.column("bits"))), matrix(_one(asked.column("p")))
    low, high, true_mass = (asked.column(c).to_numpy() for c in ("low", "high", "true_mass"))
    first, last = np.searchsorted(mass, low, "left"), np.searchsorted(mass, high, "right")
    here = (true_mass >= low) & (true_mass <= high)
    set_bits = _in_order(bits)
    before = {s: np.zeros(len(p), dtype=np.int64) for s in scorers}
    todo = np.flatnonzero(here & (last > first))
    todo = todo[np.argsort(first[todo], kind="stable")]
    true_bits = _one(asked.column("true_bits"))
    place = pc.rank(pa.concat_arrays([*library.column("key").chunks, *asked.column("true_key").cast(library.column("key").type).chunks]), tiebreaker="dense").to_numpy()
    place, true_place = place[: len(mass)], place[len(mass) :]
    patterns = None
    for start, end in _blocks(first[todo], last[todo]):
        q = todo[start:end]
        a, b = first[q].min(), last[q].max()
        inside = (np.arange(a, b) >= first[q][:, None]) & (np.arange(a, b) < last[q][:, None])
        t = matrix(true_bits.take(pa.array(q)))
        weights = {odds: _log_odds(p[q]) if odds else p[q] for odds in {_MATRIX[s][0] for s in scorers}}
        products = {odds: w @ bits[a:b].T for odds, w in weights.items()}
        total, true_total = _in_order(p[q]), _in_order(t)
        for s in scorers:
            odds, f = _MATRIX[s]
            exact = lambda i, k, f=f, w=weights[odds]: rounded(f(_in_order(w[i] * bits[a + k]), total[i], set_bits[a + k]))
            truth = f(_in_order(weights[odds] * t), total, true_total)
            score = f(products[odds], total[:, None], set_bits[None, a:b])
            gap = score - truth[:, None]
            better = inside & (gap > NEAR)
            i, k = np.nonzero(inside & (np.abs(gap) <= NEAR))
            if len(i) > TIES * len(q):  # equal bits are scored once a query
                patterns = _patterns(plain(_one(library.column("bits")))) if patterns is None else patterns
                _, one, again = np.unique(i * len(mass) + patterns[a + k], return_index=True, return_inverse=True)
            else:
                one, again = slice(None), slice(None)
            if len(i):
                i1, k1 = i[one], k[one]
                now = np.concatenate([exact(i1[n : n + EXACT], k1[n : n + EXACT]) for n in range(0, len(i1), EXACT)])[again]
                then = rounded(truth)[i]
                better[i, k] = (now > then) | ((now == then) & (place[a + k] < true_place[q[i]]))
            before[s][q] = better.sum(axis=1)
    return pa.table([asked.column("query").combine_chunks().cast(pa.string()), pa.array(last - first), *[pa.array(before[s], mask=~here) for s in scorers]], schema=schema)


def rank_truth(queries: DataFrame, library: DataFrame, scorers: tuple[str, ...], *, ppm: float = 10.0, limit: int | None = None) -> DataFrame:
    """(query, n_candidates, rank_<scorer>): the place of each query's true key among the library's keys in its mass window.

    ``queries`` (query, true_key, mass_q, p), ``library`` (key, mass, bits), a key once; ``scorers``: names of ``functions.vectors.SCORERS``.
    Scores are compared rounded to 9 digits, ties go to the smaller key. A query without a key in its window has no row.

    Keys lie in groups of about ``limit`` (KEYS) near masses. A query is sent, with the bits of its true key, to the groups
    that its window touches; these count what comes before the truth, and the counts are added up.
    """
    truth = library.where((F.col("mass") > 0) & ~F.isnan("mass")).select(F.col("key").alias("true_key"), F.col("mass").alias("true_mass"), F.col("bits").alias("true_bits"))
    return rank_known(queries.select("query", "true_key", "mass_q", "p").join(truth, "true_key", "left"), library, scorers, ppm=ppm, limit=limit)


def rank_known(queries: DataFrame, library: DataFrame, scorers: tuple[str, ...], *, ppm: float = 10.0, limit: int | None = None) -> DataFrame:
    """As :func:`rank_truth`, of ``queries`` that have true_mass and true_bits already, NULL where the library lacks the true key."""
    limit = limit or KEYS
    library = library.where((F.col("mass") > 0) & ~F.isnan("mass"))
    home = library.withColumn("__cell", cell(F.col("mass"), ppm))
    sizes = home.groupBy("__cell").agg(F.ceil(F.count("*") / limit).alias("groups"))
    group = lambda part: F.concat_ws("|", F.col("__cell").cast("string"), part.cast("string")).alias("g")
    home = home.join(sizes, "__cell").select(group(F.pmod(F.xxhash64("key"), F.col("groups"))), "key", "mass", "bits")
    asked = bounded(queries, "mass_q", ppm).join(sizes, "__cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    asked = asked.select(group(F.col("part")), "query", "true_key", "true_mass", "true_bits", F.col("__low").alias("low"), F.col("__high").alias("high"), "p")
    counted = home.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(lambda a, b: _rank_group(a, b, scorers), "query string, n bigint, " + ", ".join(f"before_{s} bigint" for s in scorers))
    summed = counted.groupBy("query").agg(F.sum("n").alias("n_candidates"), *[(F.sum(f"before_{s}") + 1).alias(f"rank_{s}") for s in scorers])
    return summed.where("n_candidates > 0")


#: Spectra of each side in a group of pairs: about as many pairs as their product are held as rows at once.
SIDE = 1024


def _pairs_group(library: pa.Table, asked: pa.Table, digits: int) -> pa.Table:
    """(q, o, cosine) of the pairs of a group that lie in each other's window."""
    schema = pa.schema([("q", pa.string()), ("o", pa.string()), ("cosine", pa.float64())])
    if not library.num_rows or not asked.num_rows:
        return schema.empty_table()
    library = library.sort_by("mass")
    mass = library.column("mass").to_numpy()
    low, high = (asked.column(c).to_numpy() for c in ("low", "high"))
    first, last = np.searchsorted(mass, low, "left"), np.searchsorted(mass, high, "right")
    if not (last > first).any():
        return schema.empty_table()
    index = PeakIndex(_one(library.column("o_mz")), _one(library.column("o_i")))
    at, mz, inten = _lists(_one(asked.column("mz")), _one(asked.column("i")))
    kept = np.flatnonzero(last > first)
    scores = [index.cosines(mz[at[r] : at[r + 1]], inten[at[r] : at[r + 1]])[first[r] : last[r]] for r in kept]
    n = last[kept] - first[kept]
    o = np.arange(n.sum()) + np.repeat(first[kept] - (np.cumsum(n) - n), n)
    return pa.table([_one(asked.column("q")).take(pa.array(np.repeat(kept, n))), _one(library.column("o")).take(pa.array(o)), pa.array(rounded(np.concatenate(scores), digits))], schema=schema)


def peak_cosines(queries: DataFrame, spectra: DataFrame, *, ppm: float = 10.0, digits: int = 6, side: int | None = None) -> DataFrame:
    """(q, o, cosine) of all queries (q, adduct, precursor_mz, p) and spectra (o, o_adduct, o_mz, o_p) of one adduct with m/z within the window, the cosine rounded.

    Spectra of one adduct and near m/z are hashed to groups of about ``side`` (SIDE), the queries of the cell too; each group of one side meets
    each of the other. Only the pairs that come out are ever rows.
    """
    side = side or SIDE
    q = bounded(queries.where("adduct is not null"), "precursor_mz", ppm).withColumn("__cell", F.concat_ws("|", F.col("__cell").cast("string"), "adduct"))
    s = spectra.where((F.col("o_mz") > 0) & ~F.isnan("o_mz") & F.col("o_adduct").isNotNull()).withColumn("__cell", F.concat_ws("|", cell(F.col("o_mz"), ppm).cast("string"), "o_adduct"))
    count = lambda df, name: df.groupBy("__cell").agg(F.ceil(F.count("*") / side).alias(name))
    sizes = cut(count(q.select("__cell"), "qs").join(count(s.select("__cell"), "os"), "__cell"))
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    group = F.concat_ws("|", "__cell", F.col("a").cast("string"), F.col("b").cast("string")).alias("g")
    s = s.join(sizes, "__cell").withColumn("a", F.pmod(F.xxhash64("o"), F.col("os"))).withColumn("b", other("qs")).select(group, "o", F.col("o_mz").alias("mass"), F.col("o_p.mz").alias("o_mz"), F.col("o_p.i").alias("o_i"))
    p = F.array_distinct("p")  # equal peaks of a query count once
    q = q.withColumn("p", p).join(sizes, "__cell").withColumn("b", F.pmod(F.xxhash64("q"), F.col("qs"))).withColumn("a", other("os")).select(group, "q", F.col("__low").alias("low"), F.col("__high").alias("high"), F.col("p.mz").alias("mz"), F.col("p.i").alias("i"))
    return s.groupBy("g").cogroup(q.groupBy("g")).applyInArrow(lambda a, b: _pairs_group(a, b, digits), "q string, o string, cosine double")

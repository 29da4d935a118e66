import random

import numpy as np

from ionloom.llm.overlap import MIN_PEAKS, MIN_SHARE, agreeing_peaks, cross_split_overlaps, neighbour_grams, probe_grams

TRAIN = "row_id bigint, ms2_mzs array<double>, ms2_normalized_intensities array<double>, gram int, id string"
TEST = "spectrum_id string, ms2_mzs array<double>, ms2_normalized_intensities array<double>, gram int, id string"


def brute_agree(a, b):
    """Most peaks that pair off, by augmenting paths."""
    fits = [[j for j, (m, i) in enumerate(b) if abs(m - x) <= 0.015 + 1e-12 and abs(i - y) <= 0.002 + 0.1 * max(i, y) + 1e-12] for x, y in a]
    owner = {}

    def place(i, seen):
        for j in fits[i]:
            if j not in seen:
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(a)))


def spectrum(rng, n):
    p = sorted((round(rng.uniform(50, 400), 4), round(rng.uniform(0.01, 1), 4)) for _ in range(n))
    top = max(i for _, i in p)
    return [(m, i / top) for m, i in p]


def changed(rng, p):
    """Another deposit: noise within the tolerance, some peaks lost and some added, other scale and order."""
    out = [(m + rng.uniform(-0.014, 0.014), i * rng.uniform(0.93, 1.07)) for m, i in p]
    lost = rng.randrange(0, len(p) // 4 + 1)
    out = rng.sample(out, len(out) - lost) + [(rng.uniform(50, 400), rng.uniform(0.01, 0.5)) for _ in range(rng.randrange(0, 3))]
    rng.shuffle(out)
    scale = rng.choice([1, 100, 1000])
    return [(m, i * scale) for m, i in out]


def scaled(p):
    top = max((i for _, i in p), default=0)
    return sorted((m, i / top) for m, i in p) if top > 0 else []


def test_all_pairs_are_found(spark):
    rng = random.Random(8)
    base = [spectrum(rng, rng.choice([5, 8, 9, 12, 16, 30])) for _ in range(60)]
    train = [(i, p) for i, p in enumerate(base)] + [(100 + i, changed(rng, p)) for i, p in enumerate(base)] + [(300, base[3]), (301, base[3])]
    test = [(f"s{i}", changed(rng, base[i % 60])) for i in range(150)]
    split = lambda p: ([m for m, _ in p], [i for _, i in p], 1, "x")
    extra = [(900, None, None, 1, "x"), (901, [], [], 1, "x"), (902, [1.0, None], [1.0, 1.0], 1, "x"), (903, [1.0] * 9, [0.0] * 9, 1, "x"), (904, [100.0] * 3, [1.0] * 2, 1, "x")]
    got = {(r.row_id, r.spectrum_id) for r in cross_split_overlaps(spark.createDataFrame([(i, *split(p)) for i, p in train] + extra, TRAIN), spark.createDataFrame([(i, *split(p)) for i, p in test] + [("n", None, None, 1, "x")], TEST)).collect()}
    expected = set()
    for i, p in train:
        for s, q in test:
            a, b = scaled(p), scaled(q)
            if min(len(a), len(b)) >= MIN_PEAKS and brute_agree(a, b) / max(len(a), len(b)) >= MIN_SHARE:
                expected.add((i, s))
    assert len(expected) > 100 and got == expected


def close_spectrum(rng, n):
    """Peaks in groups that lie closer together than their m/z is certain."""
    p = []
    while len(p) < n:
        at = rng.uniform(50, 400)
        p += [(at + rng.uniform(0, 0.02), rng.choice([0.3, 0.31, 0.6, 1.0])) for _ in range(rng.choice([1, 2, 2, 3, 5]))]
    return scaled(p[:n])


def test_close_peaks_that_change_their_order(spark):
    rng = random.Random(11)
    base = [close_spectrum(rng, rng.choice([8, 8, 8, 9, 12, 20])) for _ in range(80)]
    doublets = [(x + d, 1.0) for x in (100.0, 150.0, 200.0, 250.0) for d in (0, 0.0065)]
    swapped = [(x + d, i) for x in (100.0, 150.0, 200.0, 250.0) for d, i in ((0, 1.0), (0.0065, 0.95))]
    base.append(doublets)
    train, test = list(enumerate(base)), [(f"s{i}", changed(rng, p)) for i, p in enumerate(base) for _ in range(2)] + [("d", swapped)]
    split = lambda p: ([m for m, _ in p], [i for _, i in p], 1, "x")
    got = {(r.row_id, r.spectrum_id) for r in cross_split_overlaps(spark.createDataFrame([(i, *split(p)) for i, p in train], TRAIN), spark.createDataFrame([(s, *split(p)) for s, p in test], TEST)).collect()}
    expected = {(i, s) for i, p in train for s, q in test if min(len(p), len(q)) >= MIN_PEAKS and brute_agree(scaled(p), scaled(q)) / max(len(p), len(q)) >= MIN_SHARE}
    assert len(expected) > 60 and got == expected


def test_grams_of_neighbours_are_probed():
    """Every pair of neighbours whose partners may be neighbours is among the probe's grams, whatever their order."""
    rng = random.Random(12)
    for _ in range(300):
        p = close_spectrum(rng, rng.randrange(2, 12))
        q = sorted((m + rng.uniform(-0.0149, 0.0149), i * rng.uniform(0.96, 1.04)) for m, i in p)
        zero = np.zeros(len(p), dtype=np.int64)
        wanted = set(neighbour_grams(zero, *(np.array([x[k] for x in p]) for k in (0, 1)))[1].tolist())
        probed = set(probe_grams(zero, *(np.array([x[k] for x in q]) for k in (0, 1)))[1].tolist())
        assert wanted <= probed
    long = np.full(5000, 100.0)
    assert len(probe_grams(np.zeros(5000, dtype=np.int64), long, np.ones(5000))[1]) < 100


def test_agreeing_peaks_is_a_matching():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (sorted((round(rng.uniform(100, 100.2), 3), rng.choice([0.2, 0.21, 0.5, 1.0])) for _ in range(rng.randrange(0, 9))) for _ in range(2))
        arrays = [np.array([p[k] for p in s], dtype=float) for s in (a, b) for k in (0, 1)]
        assert agreeing_peaks(*arrays) == brute_agree(a, b)


def test_empty(spark):
    assert cross_split_overlaps(spark.createDataFrame([], TRAIN), spark.createDataFrame([], TEST)).collect() == []

import math

import numpy as np
import pyarrow as pa
import pytest

from ionloom.operators import windows as W


def _cosine(q, o):
    """Of each distinct query peak the nearest peak within 0.01, ties to the higher m/z, then the lower intensity."""
    total = 0.0
    for mz, i in sorted(set(q)):
        near = sorted((abs(m - mz), -m, x) for m, x in o if abs(m - mz) <= 0.01)
        total += i * near[0][2] if near else 0.0
    return min(total, 1.0)


def _spectrum(rng, n=6):
    return [(float(round(m, 3)), float(x)) for m, x in zip(rng.choice([100, 100.004, 100.01, 100.011, 150, 150.02, 200], n, replace=False), rng.random(n))]


def test_peak_index(spark):
    rng = np.random.default_rng(3)
    lists = [_spectrum(rng) for _ in range(40)] + [[], [(100.0, 0.3), (100.0, 0.2)]]
    index = W.PeakIndex(*(pa.array([[p[k] for p in x] for x in lists], pa.list_(pa.float64())) for k in (0, 1)))
    for q in (*lists[:10], [], [(500.0, 1.0)]):
        got = index.cosines(np.array([p[0] for p in q]), np.array([p[1] for p in q]))
        assert np.allclose(got, [_cosine(q, o) for o in lists])
    assert len(W.PeakIndex(pa.array([], pa.list_(pa.float64())), pa.array([], pa.list_(pa.float64()))).cosines(np.array([1.0]), np.array([1.0]))) == 0


@pytest.mark.parametrize(("same", "limit"), [("adduct", 20_000), ("adduct", 3), ("mode", 20_000), ("mode", 3)])
def test_search_in_groups_and_pieces(spark, same, limit):
    """Equal to a comparison of all pairs, whatever the groups; a key with a third of the spectra is in pieces; equal peaks of a query count once."""
    rng = np.random.default_rng(7)
    mass = {k: 300.0 * (1 + d * 1e-6) for k, d in zip("ABCDE", (0, 4, -9.9, 10.1, 0))} | {"F": 400.0, "N": None}
    library = [(f"o{i}", "A" if i % 3 == 0 else str(rng.choice(list("BCDEFN"))), rng.choice(["x", "y", None]), rng.choice(["p", "n"]), str(rng.choice(["1", "2"])), _spectrum(rng)) for i in range(60)]
    queries = [("m1", f"q{i}", rng.choice(["x", "y"]), rng.choice(["p", None]), str(rng.choice(["1", "2", "3"])), (x := _spectrum(rng)) + x[:2]) for i in range(4)] + [("m2", "q9", "x", "p", "9", [])]
    masses = {"m1": 300.0, "m2": 400.0}
    expected = {}
    for m, at in masses.items():
        scores = []
        for k, x in mass.items():
            if x is None or not at - at * (10.0 * 1e-6) <= x <= at + at * (10.0 * 1e-6):
                continue
            total, met, mine = 0.0, False, [q for q in queries if q[0] == m]
            for _, _, adduct, mode, energy, p in mine:
                exact = [_cosine(p, o[5]) for o in library if o[1] == k and o[2] == adduct and o[4] == energy]
                other = [_cosine(p, o[5]) for o in library if o[1] == k and (o[2] == adduct if same == "adduct" else mode is not None and o[3] == mode)]
                if exact or other:
                    met, total = True, total + max(exact or other)
            if met:
                scores.append((-total / len(mine), abs(x - at) / at * 1e6, k))
        expected |= {(m, k): (-s, r + 1) for r, (s, _, k) in enumerate(sorted(scores))}
    peaks = "array<struct<mz:double,i:double>>"
    text = lambda rows: [tuple(None if v is None else str(v) if isinstance(v, np.str_) else v for v in r) for r in rows]
    lib = spark.createDataFrame(text(library), f"o string, key string, o_adduct string, o_mode string, o_energy string, o_p {peaks}")
    q = spark.createDataFrame(text(queries), f"molecule_id string, q string, adduct string, mode string, energy string, p {peaks}")
    m = spark.createDataFrame(list(masses.items()), "molecule_id string, m double")
    got = W.search_library(m, q, spark.createDataFrame(list(mass.items()), "key string, mass double"), lib, lib.select("key"), same, limit=limit).collect()
    assert {(r.molecule_id, r.key) for r in got} == set(expected)
    for r in got:
        score, rank = expected[r.molecule_id, r.key]
        assert math.isclose(r.score, score, abs_tol=1e-12) and r["rank"] == rank


@pytest.mark.parametrize("limit", [8192, 2])
def test_rank_truth(spark, limit):
    """The ranks of the full ranking, in groups of any size, with equal bits, a truth outside the window and one without bits."""
    from ionloom.functions.vectors import SCORERS
    from ionloom.operators import ranking as R

    rng = np.random.default_rng(5)
    library = [(f"k{i:02d}", 200.0 * (1 + i % 7 * 2e-6), [float(x) for x in rng.integers(0, 2, 6)]) for i in range(30)] + [("far", 300.0, [1.0] * 6), ("dark", None, [1.0] * 6)]
    queries = [(f"q{i}", key, 200.0, [float(x) for x in rng.random(6)]) for i, key in enumerate(["k03", "k10", "k29", "far", "dark", "absent"])] + [("none", "k01", 900.0, [0.5] * 6)]
    lib, q = spark.createDataFrame(library, "key string, mass double, bits array<double>"), spark.createDataFrame(queries, "query string, true_key string, mass_q double, p array<double>")
    columns = ["query", "n_candidates", *[f"rank_{s}" for s in SCORERS]]
    expected = {tuple(r) for r in R.rank_queries(q, lib, SCORERS).select(*columns).collect() if r.n_candidates}
    assert len(expected) == 6 and {tuple(r) for r in W.rank_truth(q, lib, tuple(SCORERS), limit=limit).select(*columns).collect()} == expected


def test_equal_bits_are_scored_once(monkeypatch):
    """A window full of equal bits costs a query one sum in order for each pattern, not one for each key; the ranks are those of a full ranking."""
    rng = np.random.default_rng(2)
    patterns = np.array([[1, 0, 1, 1], [0, 1, 1, 0], [1, 1, 0, 0]], dtype=np.int8)
    of = [i % 3 if i < 30 else 0 for i in range(400)]
    keys, p = [f"k{i:03d}" for i in rng.permutation(400)], rng.random((60, 4))
    lists = lambda x: pa.array([list(r) for r in x], pa.list_(pa.from_numpy_dtype(np.asarray(x).dtype)))
    library = pa.table({"key": keys, "mass": [200.0 + i * 1e-7 for i in range(400)], "bits": lists(patterns[of])})
    true = rng.integers(0, 400, 60)
    asked = pa.table({"query": [f"q{i}" for i in range(60)], "true_key": [keys[i] for i in true], "true_mass": [200.0] * 60, "true_bits": lists(patterns[[of[i] for i in true]]), "low": [199.0] * 60, "high": [201.0] * 60, "p": lists(p)})
    summed, plain = [], W._in_order
    monkeypatch.setattr(W, "_in_order", lambda x: summed.append(len(x)) or plain(x))
    got = W._rank_group(library, asked, ("dot",)).column("before_dot").to_pylist()
    for i, t in enumerate(true):
        ranked = sorted((-float(W.rounded(p[i] @ patterns[o])), k) for o, k in zip(of, keys))
        assert got[i] == [k for _, k in ranked].index(keys[t])
    assert sum(summed) <= 400 + 5 * 60 + 60 * len(patterns)


def test_blocks():
    first = np.array([0, 0, 1, 300, 301, 5000, *range(6000, 6600)])
    last = first + np.array([10, 400, 3, 50, 50, 2000, *[5] * 600])
    blocks = W._blocks(first, last)
    assert [b[0] for b in blocks] == [0, *[b[1] for b in blocks[:-1]]] and blocks[-1][1] == len(first)
    for a, b in blocks:
        assert b - a <= W.AT_ONCE and last[a:b].max() - first[a] <= max(W.LEAST_SPAN, 1.5 * (last - first)[a:b].max())


@pytest.mark.parametrize("batch", [10_000, 3])
def test_bits_and_means(spark, batch):
    """Both halves in one pass, keys over many batches, rows that count nowhere, and means of m without the unknown ones."""
    from ionloom.operators import stats

    rng = np.random.default_rng(4)
    rows = [(str(rng.choice(["hot", "hot", "hot", "b", "c"])), int(rng.integers(0, 2)), float(rng.integers(1, 9)) if i % 4 else None, [float(x) for x in rng.normal(size=3)]) for i in range(90)]
    rows += [("only0", 0, 1.0, [3.0, 0.0, -4.0]), ("only1", 1, None, [3.0, 0.0, -4.0])]
    none = [(None, 0, 1.0, [1.0] * 3), ("b", None, 1.0, [1.0] * 3), ("b", 1, 1.0, [0.0] * 3), ("b", 1, 1.0, []), ("b", 0, 1.0, None), ("b", 1, 1.0, [1.0, None, 1.0]), ("gone", 1, 1.0, [0.0] * 3)]
    df = spark.createDataFrame(rows + none, "key string, h int, m double, e array<float>").repartition(4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {r.key: r for r in stats.bits_and_means(df, lambda u: 8.0 * u).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(got) == {"hot", "b", "c", "only0", "only1"}
    for k, r in got.items():
        unit = {h: [np.array(e, np.float32).astype(float) / np.sqrt(np.sum(np.array(e, np.float32).astype(float) ** 2)) for x, y, _, e in rows if x == k and y == h] for h in (0, 1)}
        m = [x[2] for x in rows if x[0] == k and x[1] == 1 and x[2] is not None]
        assert r.bits == ([int(x > 0) for x in np.mean(unit[0], axis=0)] if unit[0] else None)
        assert r.n == (len(unit[1]) or None) and (r.m is None if not m else math.isclose(r.m, np.mean(m)))
        assert r.p is None if not unit[1] else np.allclose(r.p, 8.0 * np.mean(unit[1], axis=0), atol=1e-12)


def test_mean_vectors(spark):
    from ionloom.operators import stats

    rows = [("hot", [float(i), 1.0]) for i in range(500)] + [("b", [2.0, 4.0]), (None, [9.0, 9.0]), ("c", None)]
    got = {r.k: (r.n, r.v) for r in stats.mean_vectors(spark.createDataFrame(rows, "k string, u array<double>").repartition(5), "u", "k").collect()}
    assert got == {"hot": (500, [249.5, 1.0]), "b": (1, [2.0, 4.0])}


@pytest.mark.parametrize("side", [1024, 2])
def test_all_pairs_of_a_window(spark, side):
    """Every pair of an adduct and window once, however many share them; equal peaks of a query count once."""
    rng = np.random.default_rng(11)
    spectra = [(f"o{i}", ["x", "y", None][i % 3], 250.0 * (1 + i % 5 * 4e-6), _spectrum(rng)) for i in range(30)] + [("none", "x", None, _spectrum(rng)), ("empty", "x", 250.0, [])]
    queries = [(f"q{i}", ["x", "y", None][i % 3], 250.0, (p := _spectrum(rng)) + p[:1]) for i in range(9)] + [("nan", "x", float("nan"), _spectrum(rng))]
    window = lambda m, x: x is not None and m - m * (10.0 * 1e-6) <= x <= m + m * (10.0 * 1e-6)
    expected = {(q, o): _cosine(p, op) for q, a, m, p in queries for o, oa, x, op in spectra if a is not None and a == oa and window(m, x)}
    peaks = "array<struct<mz:double,i:double>>"
    got = W.peak_cosines(spark.createDataFrame(queries, f"q string, adduct string, precursor_mz double, p {peaks}"), spark.createDataFrame(spectra, f"o string, o_adduct string, o_mz double, o_p {peaks}"), side=side).collect()
    assert len(got) == len(expected) and all(abs(r.cosine - expected[r.q, r.o]) <= 5.1e-7 for r in got)

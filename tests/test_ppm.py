import random

from pyspark.sql import functions as F

from ionloom.operators.dedupe import keep_first, mark
from ionloom.operators.ppm import adaptive_window, mass_chunks, ppm_join, window_sizes


def frames(spark, masses, queries):
    s = spark.createDataFrame([(i, m) for i, m in enumerate(masses)], "fp int, mass double")
    q = spark.createDataFrame([(i, m) for i, m in enumerate(queries)], "q int, m double")
    return q, s


def test_join_equals_naive(spark):
    rng = random.Random(3)
    masses = [round(rng.uniform(100, 101), 4) for _ in range(300)] + [250.0] * 150 + [None, float("nan"), 0.0, -5.0]
    queries = [round(rng.uniform(100, 101), 4) for _ in range(80)] + [250.0, 249.9975, 250.00251, None, float("nan"), -1.0]
    for ppm in (5.0, 10.0, 400.0):
        w = ppm * 1e-6
        q, s = frames(spark, masses, queries)
        got = sorted((r.q, r.fp) for r in ppm_join(q, s, "m", "mass", ppm).collect())
        assert got == sorted((i, j) for i, m in enumerate(queries) for j, x in enumerate(masses) if m and x and m > 0 and x > 0 and m - m * w <= x <= m + m * w)


def test_bounds_are_inclusive_and_empty_windows_count(spark):
    m = 200.0
    q, s = frames(spark, [m - m * 1e-5, m + m * 1e-5, m + m * 1.001e-5], [m, 300.0])
    assert sorted(r.fp for r in ppm_join(q, s, "m", "mass", 10.0).collect()) == [0, 1]
    assert {r.q: r.window_size for r in window_sizes(q, s, "q", "m", "mass").collect()} == {0: 2, 1: 0}


def test_window_widens_to_80(spark):
    near = [500 + 500 * p * 1e-6 for p in (1, 15, 35, 70, 75)]
    q, s = frames(spark, near, [500.0])
    got = lambda least: {(r.fp, r.ppm) for r in adaptive_window(q, s, "q", "m", "mass", least=least).collect()}
    assert got(1) == {(0, 10.0)} and got(2) == {(0, 20.0), (1, 20.0)} and got(9) == {(i, 80.0) for i in range(5)}


def test_chunks_keep_equal_masses_together(spark):
    masses = [float(i // 7) / 3 for i in range(100)]
    s = spark.createDataFrame([(i, m) for i, m in enumerate(masses)], "fp int, mass double")
    chunks = {}
    for r in mass_chunks(s, "mass", 10).collect():
        chunks.setdefault(r.mass, set()).add(r.chunk)
    assert all(len(c) == 1 for c in chunks.values())
    order = [min(chunks[m]) for m in sorted(chunks)]
    assert order == sorted(order)


def test_keep_first_and_mark(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z"), (None, 4, "n")], "k string, o int, v string")
    assert {r.v for r in keep_first(df, ["k"], "o").collect()} == {"y", "z", "n"}
    other = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert {(r.v, r.known) for r in mark(df, other, "k", "known").collect()} == {("x", True), ("y", True), ("z", False), ("n", False)}
    assert mark(df.limit(0), other, "k", "known").count() == 0 and F.lit(1) is not None

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.functions.vectors import embedding_columns
from ionloom.operators import ranking as R
from ionloom.operators import search
from ionloom.operators.dedupe import lookup_or_fail
from ionloom.operators.search import best_relatives, nearest_exact, neighbour_recall
from ionloom.operators.stats import mean_vector, quantiles


def units(rng, n, width=16):
    x = rng.standard_normal((n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist(), "other") for i, v in enumerate(x)], "id bigint, u array<double>, neighbour string")


def test_exact_neighbours_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = units(rng, 300)
    x[200:230] = x[5]  # ties
    vectors = frame(spark, x).repartition(5)
    true = {}
    for i in range(0, 300, 10):
        s = np.round(x @ x[i], 9)
        s[i] = -9
        true[i] = np.lexsort((np.arange(300), -s))[:4].tolist()
    for block in (4096, 7):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        got = {}
        for r in nearest_exact(vectors.where("id % 10 = 0"), vectors, 4).collect():
            got.setdefault(r.id, []).append((-r.sim, r.neighbour))
        assert {i: [n for _, n in sorted(v)] for i, v in got.items()} == true
    assert nearest_exact(vectors.limit(0), vectors, 4).collect() == [] and nearest_exact(vectors, vectors.limit(0), 4).collect() == []


def test_recall(spark):
    true = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 3)], "id bigint, neighbour bigint")
    found = spark.createDataFrame([(1, 2), (1, 9), (3, 3)], "id bigint, neighbour bigint")
    assert tuple(neighbour_recall(found, true, 2).first()) == (0.25, 2)


def test_relatives_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = units(rng, 120)
    rows = [(i, "big" if i < 90 else f"g{i % 3}", f"k{i % 7}", [None, "20", "40"][i % 3], v.tolist()) for i, v in enumerate(x)]
    rows += [(500, None, "k", "20", x[0].tolist()), (501, "big", None, "20", x[0].tolist()), (502, "big", "k1", "20", None)]
    df = spark.createDataFrame(rows, "id bigint, group string, key string, setting string, u array<double>")
    expected = {}
    for i, g, k, s, v in rows[:120]:
        mates = [(k2 == k, k2 == k and None not in (s, s2) and s != s2, float(np.dot(v, v2))) for j, g2, k2, s2, v2 in rows[:120] if g2 == g and j != i]
        best = lambda c: max((m[2] for m in mates if c(m)), default=None)
        expected[i] = (len(mates) + 1, sum(m[0] for m in mates), best(lambda m: m[0]), best(lambda m: not m[0]), sum(m[1] for m in mates), best(lambda m: m[1]))
    for block in (2048, 20):
        monkeypatch.setattr(search, "GROUP_BLOCK", block)
        got = {r.id: tuple(r)[1:] for r in best_relatives(df).collect()}
        assert set(got) == set(expected)
        for i, e in expected.items():
            assert all(a == b if a is None or b is None else abs(a - b) < 1e-12 for a, b in zip(got[i], e))


@pytest.mark.parametrize("by", [(), ("g",), ("g", "h")])
def test_quantiles(spark, by):
    rng = np.random.default_rng(3)
    rows = [(None if i % 11 == 0 else f"g{i % 4}", i % 2, float(rng.choice([rng.normal(), 1.0, -2.5]))) for i in range(700)] + [("g1", 1, None), ("g1", 1, float("nan")), ("lone", 0, 5.0)]
    got = {tuple(r)[: len(by)]: tuple(r)[len(by) :] for r in quantiles(spark.createDataFrame(rows, "g string, h int, v double"), "v", {"q1": 0.25, "mid": 0.5, "p9": 0.9}, *by).collect()}
    groups = {}
    for g, h, v in rows:
        if v is not None and v == v:
            groups.setdefault((g, h)[: len(by)], []).append(v)
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k][0] == len(v) and np.allclose(got[k][1:], np.percentile(v, [25, 50, 90]))


def test_mean_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 6))
    rows = [(None if i % 9 == 0 else f"k{i % 5}", v.tolist()) for i, v in enumerate(x)] + [("k1", None)]
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(3)
    whole = {r.dim: r["mean"] for r in mean_vector(df, "v").collect()}
    assert np.allclose([whole[d] for d in range(6)], x.mean(axis=0))
    got = {(r.k, r.dim): r["mean"] for r in mean_vector(df, "v", "k").collect()}
    for k in {r[0] for r in rows}:
        at = [i for i in range(200) if rows[i][0] == k]
        assert np.allclose([got[k, d] for d in range(6)], x[at].mean(axis=0))
    assert mean_vector(df.limit(0), "v").collect() == []


def test_setups_and_fallback(spark):
    asked = spark.createDataFrame([("q1", "k", "A", "pos", "20"), ("q2", "k", "B", "pos", "20"), ("q3", "k", "C", "neg", "unknown")], "q string, key string, adduct string, mode string, energy string")
    library = spark.createDataFrame([("k", "A", "pos", "20"), ("k", "A", "pos", "40"), ("k", "B", "pos", "60"), ("k", None, "neg", "20"), ("k", "A", "pos", "20")], "key string, o_adduct string, o_mode string, o_energy string")
    got = {(r.q, r.setup) for r in R.comparable_setups(asked, library, "mode").collect()}
    assert got == {("q1", "k|A|pos|20"), ("q2", "k|A|pos|20"), ("q2", "k|A|pos|40"), ("q2", "k|B|pos|60"), ("q3", "k|?|neg|20")}
    assert {(r.q, r.setup) for r in R.comparable_setups(asked, library, "adduct").collect()} == {("q1", "k|A|pos|20"), ("q2", "k|B|pos|60")}


def test_rank_queries(spark):
    library = spark.createDataFrame([("t", 100.0, [1.0, 0.0]), ("t", 100.0, [0.0, 1.0]), ("d", 100.0005, [0.0, 1.0]), ("far", 101.0, [1.0, 1.0])], "key string, mass double, bits array<double>")
    queries = spark.createDataFrame([(1, "t", 100.0, [0.9, 0.2]), (2, "far", 100.0, [0.1, 0.7]), (3, "t", 500.0, [0.5, 0.5])], "query bigint, true_key string, mass_q double, p array<double>")
    from ionloom.functions.vectors import SCORERS

    got = {r["query"]: (r.rank_dot, r.rank_likelihood, r.n_candidates) for r in R.rank_queries(queries, library, SCORERS).collect()}
    assert got == {1: (1, 1, 2), 2: (None, None, 2), 3: (None, None, 0)}


def test_in_batch_metrics(spark):
    rows = [("a", True, 1.0), ("a", False, 2.0), ("a", False, None), ("b", True, 3.0), ("b", False, None), ("c", False, 1.0)]
    r = R.in_batch_metrics(spark.createDataFrame(rows, "q string, t boolean, s double"), "q", "s", F.col("t")).first()
    assert r.queries == 2 and abs(r.ranking_loss - np.log(1 + np.e)) < 1e-9 and r.top1 == 0.5 and r.mrr == 0.75


def test_lookup_that_fails(spark):
    df, dim = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    assert {tuple(r) for r in lookup_or_fail(df, dim, "k", "v").collect()} == {("a", 1), ("b", None)}
    with pytest.raises(Exception, match="no v for b"):
        lookup_or_fail(df, dim.where("k = 'a'"), "k", "v").collect()


def test_embedding_columns(spark):
    df = spark.createDataFrame([(1, [0.5, -1.0]), (2, None)], "i int, u array<double>").select("i", embedding_columns(F.col("u"), 2, 4.0).alias("x"))
    assert {r.i: r.x for r in df.collect()} == {1: [2.0, -4.0, 1.0], 2: [0.0, 0.0, 0.0]}

import math

import numpy as np
from pyspark.sql import functions as F

from ionloom.operators import ranking as R
from ionloom.operators import sampling as P
from ionloom.operators import stats


def test_rank_and_metrics(spark):
    rows = [("q", "a", 0.9, 1.0), ("q", "a", 0.95, 2.0), ("q", "b", 0.95, 1.0), ("q", "c", 0.1, 0.0), ("r", "x", 0.5, 1.0)]
    df = spark.createDataFrame(rows, "q string, k string, s double, e double")
    ranked = R.rank_per_query(df, "q", "k", F.desc("s"), F.col("e"), F.col("k"))
    assert {(r.q, r.k): r["rank"] for r in ranked.collect()} == {("q", "b"): 1, ("q", "a"): 2, ("q", "c"): 3, ("r", "x"): 1}
    ranks = R.truth_ranks(ranked, "q", F.col("k") == "a")
    assert {r.q: (r["rank"], r.n_candidates) for r in ranks.collect()} == {"q": (2, 3), "r": (None, 1)}
    m = R.rank_metrics(ranks).first()
    assert m.mrr == 0.25 and m.top1 == 0 and m.top5 == 0.5 and math.isclose(m.random_mrr, (1 + 1 / 2 + 1 / 3) / 3 / 2)
    assert {r.q: r.k for r in R.submission(ranked, "q", "k").collect()} == {"q": "b;a;c", "r": "x"}


def test_rank_25_counts_and_26_not(spark):
    m = R.rank_metrics(spark.createDataFrame([(25, 30), (26, 30)], "rank bigint, n_candidates bigint")).first()
    assert math.isclose(m.mrr, 1 / 50) and m.top25 == 0.5


def test_fallback_and_mean_of_max(spark):
    rows = [("q1", "a", True, True, 0.2), ("q1", "a", False, True, 0.9), ("q1", "b", False, True, 0.4), ("q1", "c", False, False, 1.0), ("q1", "d", None, None, 1.0)]
    df = spark.createDataFrame(rows, "q string, k string, exact boolean, same boolean, s double")
    kept = R.comparable(df, ["q", "k"], F.col("exact"), F.col("same"))
    assert {(r.k, r.s) for r in kept.collect()} == {("a", 0.2), ("b", 0.4)}
    spectra = spark.createDataFrame([("m", "q1"), ("m", "q2")], "m string, q string")
    means = R.mean_of_max(kept.withColumn("m", F.lit("m")), spectra, "m", "q", "k", "s")
    assert {r.k: r.s for r in means.collect()} == {"a": 0.1, "b": 0.2}


def test_auc_and_spearman_with_ties(spark):
    df = spark.createDataFrame([(0.9, True, 1.0), (0.5, True, 2.0), (0.5, False, 2.0), (0.1, False, 5.0), (None, True, 1.0)], "s double, y boolean, z double")
    assert stats.roc_auc(df, "s", F.col("y")).first().auc == (1 + 1 + 0.5 + 1) / 4
    ranks = np.corrcoef([4, 2.5, 2.5, 1], [1, 2.5, 2.5, 4])[0, 1]
    assert math.isclose(stats.spearman(df, "s", "z").first().spearman, ranks)
    assert stats.roc_auc(df.limit(0), "s", F.col("y")).first().auc is None


def test_pairs_are_capped_per_group(spark):
    df = spark.createDataFrame([("hot", i) for i in range(50)] + [("b", 100), (None, 200), (None, 201)], "g string, i int")
    pairs = stats.pairs_within(df, "g", "i", 5, F.col("i")).collect()
    assert sorted((p.a, p.b) for p in pairs) == [(a, b) for a in range(5) for b in range(a + 1, 5)]


def test_principal_components(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 4)) * [3, 2, 1, 0.1] + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "i int, v array<double>")
    mean, components, values, total = stats.principal_components(df, "v", 2)
    cov = np.cov(x.T)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(values, np.sort(np.linalg.eigvalsh(cov))[::-1][:2]) and math.isclose(total, np.trace(cov))
    y = {r.i: r.y for r in stats.project(df, "v", mean, components, "y").collect()}
    assert np.allclose(y[0], (x[0] - mean) @ components.T) and y[999] == [0, 0]


def test_samples(spark):
    df = spark.createDataFrame([(i, f"g{i % 3}", 100.0) for i in range(300)], "i int, g string, m double")
    assert P.n_per_group(df, ["g"], "i", 4).groupBy("g").count().select("count").distinct().first()[0] == 4
    assert 10 < P.bernoulli(df, "i", 0.1).count() < 60 and P.bernoulli(df, "i", 0.1).count() == P.bernoulli(df.repartition(7), "i", 0.1).count()
    assert P.whole_groups(df, "g", 30, 20).count() == 2
    bank = df.select(F.concat(F.lit("k"), F.col("i")).alias("key"), F.col("m").alias("mass")).where("i < 40")
    queries = bank.limit(3).select(F.col("key").alias("qk"), F.col("mass").alias("qm"))
    names = dict(query_key="qk", query_mass="qm", key="key", mass="mass")
    fixed = P.fixed_decoys(queries, bank, **names).collect()
    assert {r.window_size for r in fixed} == {40} and all(r.qk != r.key for r in fixed) and max(r.slot for r in fixed) == 32
    fresh = P.fresh_decoys(queries, bank, **names).collect()
    assert all(r.qk != r.key for r in fresh) and len(fresh) <= 96

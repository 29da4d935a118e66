import numpy as np
from pyspark.sql import functions as F

from ionloom.llm.graph import ShardGraph
from ionloom.llm.neighbours import most_similar, nearest, similar_pairs
from ionloom.llm.shards import distinct_vectors

SCHEMA = "row_id bigint, embedding array<float>, id string, v string, sim int"


def clumps(rng, n, width=32, groups=20, spread=0.15):
    centre = rng.standard_normal((groups, width))
    x = centre[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, width)) * np.sqrt(1)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def brute(ids, x, k, floor=-1.0):
    x = x.astype(np.float64)
    s = x @ x.T
    out = {}
    for i, a in enumerate(ids):
        s[i, i] = -9
        order = np.lexsort((ids, -np.round(s[i], 7)))[:k]
        out[int(a)] = [int(ids[j]) for j in order if s[i, j] >= floor]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, e, "x", "y", 1) for i, e in rows], SCHEMA)


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = np.concatenate([clumps(rng, 1200), rng.standard_normal((300, 32)).astype(np.float32)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = ShardGraph(x)
    assert (graph.edges[:, 0] >= 0).all() and (graph.edges != np.arange(len(x))[:, None]).all()
    found, sims = graph.search(x, 40)
    true = np.argsort(-(x @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(f[:6]) & set(t)) / 6 for f, t in zip(found, true)]) > 0.95
    assert (np.diff(sims, axis=1)[:, :5] <= 0).all()


def test_small_graphs():
    for n in (1, 2, 3):
        graph = ShardGraph(np.eye(3, dtype=np.float32)[:n])
        found, _ = graph.search(np.eye(3, dtype=np.float32)[:n], 8)
        assert [set(f[f >= 0]) for f in found] == [set(range(n))] * n


def test_recall_over_shards(spark):
    rng = np.random.default_rng(2)
    x = clumps(rng, 3000)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    _, vectors = distinct_vectors(frame(spark, rows), "row_id", "embedding")
    true = brute(np.arange(3000), x, 5)
    # one level of pivots; two levels; two levels, asking every shard
    for how in ({"shard_rows": 400}, {"shard_rows": 150, "max_pivots": 5}, {"shard_rows": 150, "max_pivots": 3, "every_shard": True}):
        got = {}
        for r in nearest(vectors, 5, **how).collect():
            got.setdefault(r.id, set()).add(r.neighbour)
        assert np.mean([len(got[i] & set(t)) / 5 for i, t in true.items()]) > 0.9


def test_dirty_rows_and_copies(spark):
    rng = np.random.default_rng(3)
    x = clumps(rng, 200)
    x[50:130] = x[7]  # a class of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    dirty = rows + rows[:20] + [(900, None), (901, [0.0] * 32), (902, [1.0] * 3), (903, [float("nan")] * 32), (904, [None] * 32), (905, []), (None, [1.0] * 32)]
    got = {}
    for r in most_similar(frame(spark, dirty), "row_id", "embedding", 5).collect():
        got.setdefault(r.id, []).append((-r.sim, r.neighbour))
    true = brute(np.arange(200), x, 5)
    assert set(got) == set(true)
    assert all([n for _, n in sorted(got[i])] == t for i, t in true.items() if i in range(50, 130) or i == 7)
    assert np.mean([len({n for _, n in got[i]} & set(t)) / 5 for i, t in true.items()]) > 0.95
    pairs = {(r.row_id_a, r.row_id_b) for r in similar_pairs(frame(spark, dirty), "row_id", "embedding").collect()}
    assert pairs == {(min(a, b), max(a, b)) for a, t in brute(np.arange(200), x, 5, 0.9).items() for b in t}


def test_asking_copies(spark):
    rng = np.random.default_rng(4)
    x = clumps(rng, 250)
    x[100] = x[7]  # a pair, of which only the larger id asks
    x[[150, 200, 220]] = x[31]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in most_similar(frame(spark, rows), "row_id", "embedding", 5, asked=F.col("id") % 100 == 0, every_shard=True, beam=96).where("id % 100 = 0").collect():
        got.setdefault(r.id, []).append((-r.sim, r.neighbour))
    true = brute(np.arange(250), x, 5)
    assert {i: [n for _, n in sorted(v)] for i, v in got.items()} == {i: true[i] for i in (0, 100, 200)}


def test_empty(spark):
    assert similar_pairs(frame(spark, []), "row_id", "embedding").collect() == []
    assert most_similar(frame(spark, [(1, [1.0, 2.0])]), "row_id", "embedding").collect() == []

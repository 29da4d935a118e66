import random

from ionloom.llm.topn import LoserTree, merge_groups, merge_runs, top_n_per_group

SCHEMA = "g string, item string, s double, e double, bucket string, run string, place int"


def brute(rows, n):
    best = {}
    for g, i, s, e, *_ in rows:
        if g is None or i is None or s is None or s != s:
            continue
        order = (-s, float("inf") if e is None or e != e else e, i)
        if (g, i) not in best or order < best[g, i]:
            best[g, i] = order
    out = set()
    for g in {k[0] for k in best}:
        for place, (order, i) in enumerate(sorted((o, k[1]) for k, o in best.items() if k[0] == g)[:n], 1):
            out.add((g, i, place))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(30)}", f"k{rng.randrange(40)}", rng.choice([0.1, 0.5, 0.5, 0.9, None, float("nan")]), rng.choice([1.0, 2.0, None, float("nan")]), "b", "r", 7) for _ in range(4000)]
    rows += [(None, "k", 1.0, 1.0, "", "", 0), ("g", None, 1.0, 1.0, "", "", 0), ("only null", "k", None, 1.0, "", "", 0)]
    for parts in (1, 9):
        df = spark.createDataFrame(rows + rows[:50], SCHEMA).repartition(parts)
        got = {(r.g, r.item, r.place) for r in top_n_per_group(df, "g", "item", "s", "e", 5).collect()}
        assert got == brute(rows, 5)


def test_empty(spark):
    assert top_n_per_group(spark.createDataFrame([], SCHEMA), "g", "item", "s", "e").collect() == []


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in range(8):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
        at = [0] * k
        tree = LoserTree([(r[0],) if r else None for r in runs])
        out = []
        while k and tree.heads[tree.winner] is not None:
            w = tree.winner
            out.append(runs[w][at[w]])
            at[w] += 1
            tree.replace((runs[w][at[w]],) if at[w] < len(runs[w]) else None)
        assert out == sorted(x for r in runs for x in r)


def test_seek_skips_the_rest_of_a_group():
    runs = [[("a", (i,), f"i{i}") for i in range(100)] + [("b", (0,), "z")], [("a", (0.5,), "y")]]
    assert [(r[0], r[2], p) for r, p in merge_runs(runs, 2)] == [("a", "i0", 1), ("a", "y", 2), ("b", "z", 1)]


def test_many_runs_are_merged_in_passes():
    rng = random.Random(6)
    rows = [(f"g{g}", run, (rng.random(), 0.0, i), i) for g in range(3) for run in range(50) for i in {f"i{rng.randrange(30)}" for _ in range(6)}]
    rows.sort(key=lambda r: r[:3])
    for width in (2, 3, 64):
        got = [(r[0], r[2], place) for r, place in merge_groups(rows, 4, width)]
        expected = []
        for g in ("g0", "g1", "g2"):
            best = {}
            for r in rows:
                if r[0] == g:
                    best[r[3]] = min(best.get(r[3], r[2]), r[2])
            expected += [(g, o, p) for p, o in enumerate(sorted(best.values())[:4], 1)]
        assert got == expected

import random

from ionloom.llm.components import frontier_components, split_components, split_rows, unclear_entities


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components_against_union_find(spark):
    rng = random.Random(2)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    star = [("hub", f"leaf{i}") for i in range(200)]
    loose = [(f"r{rng.randrange(150)}", f"r{rng.randrange(150)}") for _ in range(90)]
    edges = chain + star + loose + loose[:20] + [("alone", "alone"), (None, "x"), ("y", None)]
    got = {r.node: r.component for r in frontier_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == brute(edges)


def test_no_edges(spark):
    assert frontier_components(spark.createDataFrame([], "a string, b string")).collect() == []


K = ["AAAAAAAAAAAAAA", "BBBBBBBBBBBBBB", "CCCCCCCCCCCCCC"]
SPECTRA = "row_id bigint, inchikey14 string, normalized_smiles string, ingest_lib string, component string, n int"


def tables(spark, rows):
    m = spark.createDataFrame([(K[2], "OC"), (K[1], "CC/C"), (None, "NN"), (K[0], None)], "inchikey14 string, normalized_smiles string")
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SPECTRA), m


def test_unclear_entities(spark):
    rows = [
        (1, K[0], "C", "l"),  # clear
        (2, K[0].lower(), None, "l"),  # key as written
        (3, f"InChIKey={K[1]}-ABC-N", "C", "l"),  # its own key comes first
        (4, None, "C", "l"),  # by another row's SMILES
        (5, "N/A", "OC", "l"),  # by the molecules
        (6, "", "CCCC", "l"),  # unknown SMILES
        (7, None, None, "l"),
        (8, "-", " ", "l"),
        (9, K[2] + " ", "OC", "l"),
        (10, None, "x" * 50_000, "l"),
    ]
    got = {tuple(r) for r in unclear_entities(*tables(spark, rows)).collect()}
    # row 3 links the SMILES of row 1 to a second key: one component, named by its smallest key
    assert got == {(2, K[0]), (3, K[1]), (4, K[0]), (5, K[2]), (9, K[2])}


def test_splits_keep_molecules_together(spark):
    rng = random.Random(5)
    rows = [(i, K[0] if rng.random() < 0.3 else f"{'ABCDEFGHIJKLMN'[: 14 - 4]}{i % 500:04}".translate(str.maketrans("0123456789", "QRSTUVWXYZ")), f"s{i % 500}", "l") for i in range(4000)]
    rows = [(i, k, "hot" if k == K[0] else s, lib) for i, k, s, lib in rows] + [(9000, None, None, None)]
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    got = split_rows(*tables(spark, rows), shares).collect()
    assert len(got) == len(rows) and len({r.row_id for r in got}) == len(rows)
    by_key = {}
    for r in got:
        key = rows[r.row_id][1] if r.row_id < 4000 else None
        by_key.setdefault(key, set()).add(r.split)
    assert all(len(s) == 1 for s in by_key.values())
    n = {s: sum(r.split == s for r in got) / len(got) for s in shares}
    assert all(abs(n[s] - shares[s]) < 0.02 for s in shares)


def test_splits_of_nothing(spark):
    spectra, molecules = tables(spark, [])
    assert split_rows(spectra, molecules, {"train": 1.0}).collect() == [] and unclear_entities(spectra, molecules).collect() == []
    assert split_components(spark.createDataFrame([], "component string, n bigint"), {"a": 0.5, "b": 0.5}).collect() == []

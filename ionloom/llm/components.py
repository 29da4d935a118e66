"""Connected components by frontier breadth-first search, and splits that keep them together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.functions.keys import clean_key
from ionloom.operators.skew import salted_join
from ionloom.session import cut

#: Hash ranges over which components are counted when their order is cut into splits.
ORDER_BUCKETS = 4096


def frontier_components(edges: DataFrame) -> DataFrame:
    """(node, component): components of the graph with ``edges`` (a, b); the component is its smallest node.

    Adjacency lists are partitioned by node. Every node whose hash is the smallest among its neighbours is a seed
    (each component has one), and all seeds expand together, a frontier a round. A node that several seeds reach takes
    the smallest of their labels; the collisions are the edges of a small graph of labels, whose components are found
    in the same way, a level deeper. Rounds are bounded by the distance to the nearest seed; each level at least halves
    the labels that still collide. Nothing is collected; every round is cut by a checkpoint.

    An edge (a, a) makes a node known; repeated edges count once; an edge with a null end is left out; an empty table
    gives an empty result.
    """
    both = edges.select("a", "b").where("a is not null and b is not null")
    sym = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
    label = sym.groupBy("a").agg(F.min(rank("b")).alias("near")).select(F.col("a").alias("node"), F.when(rank("a") <= F.col("near"), F.col("a")).alias("label"))
    adjacency = sym.where("a <> b")
    visited = cut(label.where("label is not null"))
    frontier, clashes = visited, []
    while not frontier.isEmpty():
        reached = frontier.join(adjacency, frontier.node == adjacency.a).select(F.col("b").alias("node"), "label").distinct()
        known = cut(reached.join(visited.withColumnRenamed("label", "old"), "node", "left"))
        fresh = known.where("old is null").groupBy("node").agg(F.min("label").alias("label"))
        clashes.append(known.where("old is not null and old <> label").select(F.col("label").alias("a"), F.col("old").alias("b")))
        clashes.append(known.where("old is null").join(fresh.withColumnRenamed("label", "low"), "node").where("low <> label").select(F.col("label").alias("a"), F.col("low").alias("b")))
        frontier = cut(fresh)
        visited = visited.unionByName(frontier)
    merged = None
    if clashes:
        graph = clashes[0]
        for more in clashes[1:]:
            graph = graph.unionByName(more)
        graph = cut(graph.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        merged = None if graph.isEmpty() else frontier_components(graph)
    rooted = visited if merged is None else visited.join(merged.select(F.col("node").alias("label"), F.col("component").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    smallest = rooted.groupBy("label").agg(F.min("node").alias("component"))
    return cut(rooted.join(smallest, "label").select("node", "component"))


def _nodes(df: DataFrame, *keep: str) -> DataFrame:
    """key_node, smiles_node: 128-bit ids of the molecule key and the SMILES of a row."""
    key = clean_key(F.col("inchikey14"))
    smiles = F.when(F.trim("normalized_smiles") != "", F.trim("normalized_smiles"))
    return df.select(*keep, key.alias("key"), F.md5(F.concat(F.lit("k"), key)).alias("key_node"), F.md5(F.concat(F.lit("s"), smiles)).alias("smiles_node"))


def entities(spectra: DataFrame, molecules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the keys and SMILES that ``spectra`` and ``molecules`` link, and (component, entity_key).

    Rows are reduced to distinct (key, SMILES) pairs before anything is shuffled by key, so a molecule with a third
    of all rows is one edge.
    """
    pairs = _nodes(spectra).unionByName(_nodes(molecules)).distinct()
    pairs = cut(pairs)
    edges = pairs.select(F.coalesce("key_node", "smiles_node").alias("a"), F.coalesce("smiles_node", "key_node").alias("b"))
    components = frontier_components(edges)
    keys = pairs.where("key is not null").select("key", F.col("key_node").alias("node")).distinct()
    return components, keys.join(components, "node").groupBy("component").agg(F.min("key").alias("entity_key"))


def rows_with_component(spectra: DataFrame, components: DataFrame) -> DataFrame:
    """(row_id, inchikey14, key, ingest_lib, component): a row with neither key nor SMILES is a component of its own.

    A hot key is spread over salts in the join.
    """
    rows = _nodes(spectra, "row_id", "inchikey14", "ingest_lib").withColumn("node", F.coalesce("key_node", "smiles_node"))
    joined = salted_join(rows, components, "node", how="left")
    alone = F.md5(F.concat(F.lit("r"), F.col("row_id").cast("string")))
    return joined.select("row_id", "inchikey14", "key", "ingest_lib", F.coalesce("component", alone).alias("component"))


def unclear_entities(spectra: DataFrame, molecules: DataFrame) -> DataFrame:
    """(row_id, entity_key): rows whose key isn't just 14 capital letters but whose molecule the row still tells.

    The row's own key as written comes first; else the (smallest) key of the component of its SMILES. Rows with
    neither are no cases. A null row_id is kept; repeated rows come out again; empty tables give an empty result.
    """
    components, names = entities(spectra, molecules)
    unclear = spectra.where(F.coalesce(~F.col("inchikey14").rlike("^[A-Z]{14}$") | F.col("inchikey14").contains("\n"), F.lit(True)))
    rows = rows_with_component(unclear, components)
    return rows.join(names, "component", "left").select("row_id", F.coalesce("key", "entity_key").alias("entity_key")).where("entity_key is not null")


def split_components(sizes: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(component, split): components in hash order, cut where the running count of rows reaches the shares.

    A component of at least half the smallest share (so a bounded number of them) would overfill a small split: these
    go to the largest split first, and the others share out what is left. Running counts are sums over hash ranges
    (``ORDER_BUCKETS`` rows at most are broadcast) plus the order within a range.
    """
    names = sorted(shares, key=lambda k: -shares[k])
    total = sizes.agg(F.sum("n")).first()[0] or 0
    giant = F.col("n") >= max(1.0, 0.5 * min(shares.values()) * total)
    taken = sizes.where(giant).agg(F.sum("n")).first()[0] or 0
    rest = total - taken
    wanted = [shares[k] * total - (taken if i == 0 else 0) for i, k in enumerate(names)]
    wanted = [max(0.0, w) for w in wanted]
    scale = rest / sum(wanted) if sum(wanted) else 0.0
    small = sizes.where(~giant).withColumn("h", F.xxhash64("component")).withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))
    from pyspark.sql import Window

    counted = small.groupBy("bucket").agg(F.sum("n").alias("in_bucket"))
    offsets = counted.select("bucket", (F.sum("in_bucket").over(Window.orderBy("bucket")) - F.col("in_bucket")).alias("before"))
    order = Window.partitionBy("bucket").orderBy("h", "component")
    placed = small.join(F.broadcast(offsets), "bucket").withColumn("at", F.col("before") + F.sum("n").over(order) - F.col("n") / 2)
    edge, split = 0.0, None
    for name, w in zip(names, wanted):
        edge += w * scale
        split = F.when(F.col("at") < edge, name) if split is None else split.when(F.col("at") < edge, name)
    split = F.lit(names[0]) if split is None else split.otherwise(names[-1])
    return placed.select("component", split.alias("split")).unionByName(sizes.where(giant).select("component", F.lit(names[0]).alias("split")))


def split_rows(spectra: DataFrame, molecules: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(row_id, ingest_lib, component, split): every row once, all rows of a component in one split."""
    components, _ = entities(spectra, molecules)
    rows = cut(rows_with_component(spectra, components).select("row_id", "ingest_lib", "component"))
    sizes = cut(rows.groupBy("component").agg(F.count("*").alias("n")))
    return salted_join(rows, split_components(sizes, shares), "component").select("row_id", "ingest_lib", "component", "split")

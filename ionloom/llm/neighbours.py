"""The most similar vectors of every vector: shards around pivots, a graph in each shard, beam search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.llm import shards as S
from ionloom.llm.graph import ShardGraph
from ionloom.operators.skew import salted_join
from ionloom.session import cut

#: Vectors that search a shard in one task; with more, the shard's graph is built in several tasks.
VISITS = 8 * S.SHARD_ROWS


def nearest(vectors: DataFrame, k: int, *, probes: int = 4, beam: int = 40, floor: float = -1.0, every_shard: bool = False, shard_rows: int = S.SHARD_ROWS, max_pivots: int = S.MAX_PIVOTS) -> DataFrame:
    """(id, neighbour, sim): up to ``k`` most similar others of each vector (id, v, asks) that asks, with ``sim`` of ``floor`` or more.

    Every vector is indexed, in the shard of its nearest pivot, and asks the graphs of its ``probes`` nearest pivots
    (``every_shard``: of all of them). ``vectors`` must be materialised.
    Equal vectors are no special case here; see :func:`most_similar` for classes of copies.
    """
    held = vectors.select("id", "v", "asks")
    layout = S.lay_out(held, held.count(), shard_rows, max_pivots)
    routed = S.route(held, layout, probes)
    home = routed.withColumn("shard", F.col("shards")[0]).drop("shards")
    away = routed.where("asks").withColumn("own", F.col("shards")[0])
    away = S.every_shard(away.drop("shards"), layout) if every_shard else away.withColumn("shard", F.explode("shards")).drop("shards")
    visits = away.groupBy("shard").agg(F.count("*").alias("visits"))
    plan = home.groupBy("shard").agg(F.count("*").alias("n")).join(visits, "shard", "left")
    plan = plan.select("shard", F.ceil(F.col("n") / (2 * shard_rows)).alias("subs"), F.greatest(F.lit(1), F.ceil(F.coalesce("visits", F.lit(0)) / max(VISITS, 8 * shard_rows))).alias("parts"))
    plan, tasks = S.numbered(plan, F.col("subs") * F.col("parts"))
    hashed = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), n)
    group = F.col("first") + F.col("sub") * F.col("parts") + F.col("part")
    # every part of a shard holds all its home vectors; each visitor goes to one part of every sub-shard
    at_home = S.joined(home, plan, tasks).withColumn("sub", hashed(1, F.col("subs"))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    at_home = at_home.select(group.alias("block"), F.lit(True).alias("home"), "id", "v", (F.col("asks") & (F.col("part") == 0)).alias("asks"))
    visitors = S.joined(away, plan, tasks).withColumn("sub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("subs") - 1))).withColumn("part", hashed(2, F.col("parts")))
    visitors = visitors.where((F.col("shard") != F.col("own")) | (F.col("sub") != hashed(1, F.col("subs")))).select(group.alias("block"), F.lit(False).alias("home"), "id", "v", F.lit(True).alias("asks"))

    def search(table: pa.Table) -> pa.Table:
        home = np.asarray(table.column("home").to_numpy(zero_copy_only=False), dtype=bool)
        asks = np.asarray(table.column("asks").to_numpy(zero_copy_only=False), dtype=bool)
        ids = table.column("id").to_numpy()
        x = S.unpack(table.column("v"))
        order = np.flatnonzero(home)[np.argsort(ids[home], kind="stable")]
        base = ids[order]
        graph = ShardGraph(x[order])
        place = np.full(len(ids), -1, dtype=np.int32)
        place[order] = np.arange(len(order))
        found, sims = graph.search(x[asks], max(beam, 2 * k), own=place[asks])
        who = ids[asks]
        sims[(found < 0) | (base[np.maximum(found, 0)] == who[:, None])] = -np.inf
        best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        r, c = np.nonzero(np.take_along_axis(sims, best, axis=1) >= floor)
        node = np.take_along_axis(found, best, axis=1)[r, c]
        exact = np.einsum("ed,ed->e", x[order][node].astype(np.float64), x[asks][r].astype(np.float64))
        return pa.table({"id": pa.array(who[r], type=pa.int64()), "neighbour": pa.array(base[node], type=pa.int64()), "sim": pa.array(exact)})

    found = S.placed(at_home.unionByName(visitors), tasks).groupBy("task", "block").applyInArrow(search, "id bigint, neighbour bigint, sim double")
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def most_similar(df: DataFrame, ident: str, vector: str, k: int = 5, *, floor: float = -1.0, asked: Column | None = None, **how) -> DataFrame:
    """(id, neighbour, sim): the ``k`` most similar others of every id, ties to the smaller id.

    Copies of a vector form a class: one stands for it in the index, so a class with a third of all rows is one node.
    A member's neighbours are members of its own class, then those of the classes found; of each class the k + 1
    smallest ids suffice. ``asked``: a condition on id for the rows that ask; a class asks if any member does, and all its
    members are answered. Members of other classes get their own copies only. See :func:`shards.distinct_vectors` for the
    rows left out; an empty table gives an empty result.
    """
    members, classes = S.distinct_vectors(df, ident, vector, asked)
    members = cut(members)
    pairs = cut(nearest(classes, k, floor=floor, **how))
    single = members.where("copies = 1").select("id")
    shared = members.where("copies > 1").select("id", "rep")
    heads = cut(shared.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select("rep", F.col("id").alias("head")))
    # neighbours of a class are spelt out to its first members; then the members of the asking class each take all
    spelt = pairs.join(heads.withColumnRenamed("rep", "neighbour"), "neighbour", "left").select("id", F.coalesce("head", "neighbour").alias("neighbour"), "sim")
    own = salted_join(shared, heads, "rep").where("id <> head").select("id", F.col("head").alias("neighbour"), F.lit(1.0).alias("sim"))
    lone = spelt.join(single, "id", "left_semi")
    others = salted_join(shared, spelt.withColumnRenamed("id", "rep"), "rep").select("id", "neighbour", "sim")
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour")
    return lone.unionByName(own).unionByName(others).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def similar_pairs(df: DataFrame, ident: str, vector: str, *, k: int = 5, floor: float = 0.9, **how) -> DataFrame:
    """(row_id_a, row_id_b): a < b with cosine ``floor`` or more, one among the ``k`` most similar of the other."""
    near = most_similar(df, ident, vector, k, floor=floor, **how)
    return near.select(F.least("id", "neighbour").alias("row_id_a"), F.greatest("id", "neighbour").alias("row_id_b")).distinct()

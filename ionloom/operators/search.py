"""Exact nearest vectors of a query set, and the nearest relatives of every member of a group, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.session import cut

#: Queries that are sent to every task at a time (4 MB at 128 numbers of 8 bytes); each block is one pass over the vectors.
QUERY_BLOCK = 4096
#: Members of a group that are compared in one task with as many others.
GROUP_BLOCK = 2048


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def nearest_exact(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, sim): the ``k`` vectors (id, u) of the highest dot product with each query (id, u), itself aside.

    Ties (to 9 digits) go to the smaller id. Meant for a stated query set: queries are taken in blocks of bounded size, each
    against all vectors; a task keeps k rows a query. Vectors of unit length without nulls; empty sides give no rows.
    """
    sc = vectors.sparkSession.sparkContext
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    numbered = queries.select("id", "u").withColumn("__b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        table = numbered.where(F.col("__b") == block).orderBy("id").toArrow()  # about QUERY_BLOCK rows
        held = sc.broadcast((table.column("id").to_numpy(), _matrix(table.column("u"))))

        def run(batches, held=held):
            who, q = held.value
            best = np.full((len(who), k), -np.inf)
            ids = np.full((len(who), k), np.iinfo(np.int64).max)
            for b in batches:
                if not b.num_rows or not len(who):
                    continue
                other = b.column(0).to_numpy()
                sim = np.round(q @ _matrix(b.column(1)).T, 9)
                sim[who[:, None] == other[None, :]] = -np.inf
                all_sim, all_ids = np.concatenate([best, sim], axis=1), np.concatenate([ids, np.broadcast_to(other, sim.shape)], axis=1)
                # those that may be among the k, ties included, then in order
                floor = -np.partition(-all_sim, k - 1, axis=1)[:, k - 1]
                for i in range(len(who)):
                    at = np.flatnonzero((all_sim[i] >= floor[i]) & np.isfinite(all_sim[i]))
                    at = at[np.lexsort((all_ids[i, at], -all_sim[i, at]))[:k]]
                    best[i], ids[i] = -np.inf, np.iinfo(np.int64).max
                    best[i, : len(at)], ids[i, : len(at)] = all_sim[i, at], all_ids[i, at]
            r, c = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(who[r], type=pa.int64()), pa.array(ids[r, c]), pa.array(best[r, c])], names=["id", "neighbour", "sim"])

        part = vectors.select("id", "u").mapInArrow(run, "id bigint, neighbour bigint, sim double")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour")
    return out.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def neighbour_recall(found: DataFrame, true: DataFrame, k: int) -> DataFrame:
    """(recall, queries): the mean share of each query's ``k`` true neighbours that are among those found."""
    hits = true.select("id", "neighbour").join(found.select("id", "neighbour", F.lit(1).alias("hit")), ["id", "neighbour"], "left")
    per = hits.groupBy("id").agg((F.coalesce(F.sum("hit"), F.lit(0)) / k).alias("share"))
    return per.agg(F.avg("share").alias("recall"), F.count("*").alias("queries"))


_BEST = "id bigint, n_own bigint, n_other bigint, own double, other double, n_setting bigint, own_setting double"


def best_relatives(members: DataFrame) -> DataFrame:
    """(id, n, n_own, own, other, n_setting, own_setting) of every member (group, id, key, setting, u) of a group.

    ``own``: the highest dot product with another member of its key, ``other``: with a member of another key,
    ``own_setting``: with one of its key at another known setting (NULL where its own is unknown); n: members of the group,
    n_own and n_setting: how many of these there are.

    A group is compared in blocks of about GROUP_BLOCK members with each other, whatever its size, all of it; only one row a
    member and block comes out, never a pair. A null group, key or vector counts nowhere.
    """
    rows = cut(members.where("group is not null and key is not null and u is not null").select("group", "id", "key", "setting", "u"))
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"), F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("blocks"))
    placed = rows.join(sizes, "group").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asks = placed.withColumn("j", every).select("group", F.col("own").alias("i"), "j", "id", "key", "setting", "u")
    # named anew: a cogroup confuses columns that both sides have from one source
    told = placed.withColumn("i", every).select(*[F.col(c).alias(c) for c in ("group", "i")], F.col("own").alias("j"), *[F.col(c).alias(c) for c in ("id", "key", "setting", "u")])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in _BEST.split(", ")]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64() if "bigint" in f else pa.float64()) for f in _BEST.split(", ")], names=names)
        ids, others = left.column("id").to_numpy(), right.column("id").to_numpy()
        key = lambda c: [np.array(t.column(c).to_pylist(), dtype=object) for t in (left, right)]
        (ka, kb), (sa, sb) = key("key"), key("setting")
        code = {v: i for i, v in enumerate({*ka, *kb, *sa, *sb})}
        ka, kb, sa, sb = (np.array([code[v] for v in x]) for x in (ka, kb, sa, sb))
        none = code.get(None, -1)
        sim = _matrix(left.column("u")) @ _matrix(right.column("u")).T
        same = ka[:, None] == kb[None, :]
        self_ = ids[:, None] == others[None, :]
        own, other = same & ~self_, ~same
        setting = own & (sa[:, None] != sb[None, :]) & (sa != none)[:, None] & (sb != none)[None, :]
        top = lambda m: np.where(m.any(axis=1), np.where(m, sim, -np.inf).max(axis=1), np.nan)
        value = lambda m: pa.array(top(m), from_pandas=True)
        count = lambda m: pa.array(m.sum(axis=1).astype(np.int64))
        return pa.table([pa.array(ids), count(own), count(other), value(own), value(other), count(setting), value(setting)], names=names)

    parts = asks.groupBy("group", "i", "j").cogroup(told.groupBy("group", "i", "j")).applyInArrow(compare, _BEST)
    total = F.sum("n_own") + F.sum("n_other") + 1
    return parts.groupBy("id").agg(total.alias("n"), F.sum("n_own").alias("n_own"), F.max("own").alias("own"), F.max("other").alias("other"), F.sum("n_setting").alias("n_setting"), F.max("own_setting").alias("own_setting"))

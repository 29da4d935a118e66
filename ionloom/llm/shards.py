"""Vectors in shards around pivots, on two levels, and groups of them placed in partitions by number."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.operators.skew import salted_join
from ionloom.session import cut, cut_in_place

#: Vectors a shard is meant to hold. A pivot with twice as many gets pivots of its own; a part of these with twice as many is split by hash.
SHARD_ROWS = 3000
#: Rows of the samples (by hash) that pivots are fitted on, of all vectors and of each pivot with too many; and the most pivots of a fit (2 MB at 128 numbers).
PIVOT_SAMPLE, MAX_PIVOTS = 32_768, 4096
#: Partitions by number: as many as there are groups up to this many, else this prime.
MAX_TASKS = 19_997
#: Vectors of a pivot that one task takes to its second level.
SALT_ROWS = 50_000


def pack(x: np.ndarray, kind: str = "<f4") -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x, dtype=kind)], type=pa.binary())


def unpack(column, kind: str = "<f4") -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1) if rows else np.empty((0, 1), dtype=kind)


def unit_rows(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, v): the rows with a vector, scaled to unit length, as bytes of float32.

    Null and zero vectors, those with a null, NaN or infinite number, and those of another length than most are left
    out: no cosine is defined for them.
    """
    slim = df.select(F.col(ident).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("e")).where("id is not null and e is not null and size(e) > 0")
    common = slim.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = common[0] if common else 1

    def run(batches):
        for b in batches:
            flat = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, dims).astype(np.float64)
            norm = np.sqrt((flat * flat).sum(axis=1))
            ok = np.isfinite(norm) & (norm > 0)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pack(flat[ok] / norm[ok, None])], names=["id", "v"])

    return slim.where(F.size("e") == dims).mapInArrow(run, "id bigint, v binary")


def unit_vectors(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, v): each id once. Of differing vectors of one id the first in byte order counts."""
    return unit_rows(df, ident, vector).groupBy("id").agg(F.min("v").alias("v"))


def distinct_vectors(df: DataFrame, ident: str, vector: str, asked: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, rep, copies) of each id, and (id, v, copies, asks) of each distinct vector; the latter materialised.

    The smallest id of equal vectors stands for them. Of differing vectors of one id, that with the first hash counts.
    ``asks``: whether any id of the vector meets the condition ``asked`` on id. Vectors are shuffled once, by hash; all
    else is 24 bytes a row, and a vector with a third of all rows is combined before it is shuffled.
    """
    rows = unit_rows(df, ident, vector).withColumn("copy", F.unhex(F.md5("v")))
    chosen = cut(rows.select("id", "copy").groupBy("id").agg(F.min("copy").alias("copy")))
    asks = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    classes = chosen.groupBy("copy").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.bool_or(asks).alias("asks"))
    members = salted_join(chosen, classes.select("copy", "rep", "copies"), "copy").select("id", "rep", "copies")
    nodes = rows.groupBy("copy").agg(F.min("v").alias("v")).join(classes, "copy").select(F.col("rep").alias("id"), "v", "copies", "asks")
    return members, cut(nodes)


def fit(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` unit pivots by spherical k-means; the first rows are the first pivots."""
    pivots = x[: min(k, len(x))].astype(np.float32, copy=True)
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ pivots.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        used, start = np.unique(near[order], return_index=True)
        total = np.add.reduceat(x[order], start, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        pivots[used] = np.where(norm > 0, total / np.maximum(norm, 1e-12), pivots[used])
    return pivots


def closest(x: np.ndarray, pivots: np.ndarray, n: int, reach: float | None = None) -> pa.ListArray:
    """Per row the ``n`` nearest pivots, nearest first, and all others with cosine ``reach`` or more."""
    lists, offsets = [np.empty(0, dtype=np.int64)], [0]
    n = min(n, len(pivots))
    for lo in range(0, len(x), 1024):
        sim = x[lo : lo + 1024] @ pivots.T
        rows = np.arange(len(sim))[:, None]
        top = np.argpartition(-sim, n - 1, axis=1)[:, :n]
        top = np.take_along_axis(top, np.argsort(-sim[rows, top], axis=1, kind="stable"), axis=1)
        if reach is None:
            lists.append(top.ravel().astype(np.int64))
            offsets += [offsets[-1] + n * (i + 1) for i in range(len(sim))]
            continue
        more = sim >= reach
        more[rows, top] = False
        for t, m in zip(top, more):
            lists.append(np.concatenate([t, np.flatnonzero(m)]).astype(np.int64))
            offsets.append(offsets[-1] + len(lists[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(np.concatenate(lists)))


class Layout(NamedTuple):
    """``pivots`` with the vectors that each is nearest to; ``split``: (p, pivots, parts, salts) of those that have pivots of their own, at most MAX_PIVOTS rows of MAX_PIVOTS vectors; None if there is none."""

    pivots: np.ndarray
    sizes: dict[int, int]
    split: DataFrame | None


#: Shards of a pivot are numbered p * WIDE (not split), p * WIDE + 1 and so on.
WIDE = 2 * MAX_PIVOTS


def cells(vectors: DataFrame, pivots: np.ndarray, n: int, reach: float | None = None) -> DataFrame:
    """``vectors`` with ``cells``: the nearest ``n`` pivots, nearest first, and all within ``reach``."""
    held = vectors.sparkSession.sparkContext.broadcast(pivots)
    at = vectors.columns.index("v")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, closest(unpack(b.column(at)), held.value, n, reach)], names=[*b.schema.names, "cells"])

    return vectors.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes) + ", cells array<bigint>")


def _sampled(vectors: DataFrame, share: Column) -> DataFrame:
    return vectors.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) <= F.floor(share * (1 << 20)))


def lay_out(vectors: DataFrame, rows: int, shard_rows: int = SHARD_ROWS, max_pivots: int = MAX_PIVOTS) -> Layout:
    """Pivots for the vectors (id, v), fitted on a hash sample of about PIVOT_SAMPLE of them.

    A pivot that is nearest to more than twice ``shard_rows`` gets pivots of its own, fitted on as large a sample of its
    vectors, so shards go on multiplying with the rows: up to MAX_PIVOTS squared of them.
    """
    k = int(min(max_pivots, max(1, -(-rows // shard_rows))))
    sample = _sampled(vectors, F.lit(min(1.0, PIVOT_SAMPLE / max(1, rows)))).select("id", "v").orderBy(F.xxhash64("id", F.lit(12)), "id").limit(2 * PIVOT_SAMPLE).toArrow()
    x = unpack(sample.column("v"))
    if not len(x):
        return Layout(np.zeros((1, 1), dtype=np.float32), {}, None)
    pivots = fit(x, k)
    nearest = cells(vectors.select("id", "v"), pivots, 1).withColumn("p", F.col("cells")[0])
    counted = {r.p: r.n for r in nearest.groupBy("p").agg(F.count("*").alias("n")).collect()}  # at most max_pivots rows
    large = [(p, n) for p, n in counted.items() if n > 2 * shard_rows]
    if not large:
        return Layout(pivots, counted, None)
    sizes = vectors.sparkSession.createDataFrame(large, "p bigint, n bigint")

    def split(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        n = table.column("n")[0].as_py()
        rng = np.random.default_rng(3)
        found = fit(rng.permutation(unpack(table.column("v"))), int(min(max_pivots, -(-n // shard_rows))))
        return pa.table({"p": table.column("p").slice(0, 1), "pivots": pa.array([found.tobytes()], type=pa.binary()), "parts": pa.array([len(found)]), "salts": pa.array([-(-n // SALT_ROWS)])})

    own = _sampled(nearest.join(F.broadcast(sizes), "p"), F.least(F.lit(1.0), PIVOT_SAMPLE / F.col("n"))).select("id", "v", "p", "n")
    return Layout(pivots, counted, cut(own.groupBy("p").applyInArrow(split, "p bigint, pivots binary, parts bigint, salts bigint")))


def route(vectors: DataFrame, layout: Layout, probes: int, reach: float | None = None) -> DataFrame:
    """``vectors`` (id, v, ...) with ``shards``: those of the nearest ``probes`` pivots, its home first, and of all with cosine ``reach`` or more.

    Of a pivot that is split: the nearest ``probes`` parts of the first, two of the others (and those within reach).
    Under two levels the result is materialised.
    """
    at = cells(vectors, layout.pivots, probes, reach)
    if layout.split is None:
        return at.withColumn("shards", F.transform("cells", lambda p: p * WIDE)).drop("cells")
    at = cut(at)
    known = layout.split.select("p", "salts")
    flat = at.select("id", "v", F.posexplode("cells").alias("pos", "p")).join(F.broadcast(known), "p", "left")
    whole = flat.where("salts is null").select("id", "pos", F.array(F.col("p") * WIDE).alias("s"))
    deep = flat.where("salts is not null").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))
    parts = layout.split.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).select("p", "salt", "pivots")

    def choose(key, rows: pa.Table, split: pa.Table) -> pa.Table:
        if not rows.num_rows or not split.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "pos": pa.array([], pa.int32()), "s": pa.array([], pa.list_(pa.int64()))})
        x = unpack(rows.column("v"))
        own = np.frombuffer(split.column("pivots")[0].as_py(), dtype="<f4").reshape(-1, x.shape[1])
        near = closest(x, own, probes, reach).to_pylist()
        pos, p = rows.column("pos").to_pylist(), key[0].as_py()
        far = 2 if reach is None else len(own)
        return pa.table({"id": rows.column("id"), "pos": pa.array(pos, pa.int32()), "s": pa.array([[p * WIDE + 1 + c for c in (n if k == 0 else n[:far])] for k, n in zip(pos, near)], pa.list_(pa.int64()))})

    found = deep.select("p", "salt", "id", "v", "pos").groupBy("p", "salt").cogroup(parts.groupBy("p", "salt")).applyInArrow(choose, "id bigint, pos int, s array<bigint>")
    # at most a few shards a vector
    lists = whole.unionByName(found).groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda r: r.s)).alias("shards"))
    return cut(at.drop("cells").join(lists, "id"))


def every_shard(vectors: DataFrame, layout: Layout) -> DataFrame:
    """``vectors`` once for each shard, in ``shard``: for a query set only."""
    every = vectors.withColumn("p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(len(layout.pivots) - 1).cast("bigint"))))
    if layout.split is None:
        return every.withColumn("shard", F.col("p") * WIDE).drop("p")
    parts = every.join(F.broadcast(layout.split.select("p", "parts")), "p", "left")
    inner = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(1).cast("bigint"), F.col("parts")))
    return parts.withColumn("part", F.explode(inner)).withColumn("shard", F.col("p") * WIDE + F.col("part")).drop("p", "parts", "part")


def numbered(plan: DataFrame, groups: Column) -> tuple[DataFrame, int]:
    """``plan`` (shard, ...) with ``first``, so that the groups of a shard are first, first + 1 and so on; and the number of partitions.

    A group g belongs to partition g modulo that number: one group a partition while there are at most MAX_TASKS, else the
    numbers are spread over a prime, so partitions hold about as many groups each.
    """
    plan = cut(plan.withColumn("groups", groups.cast("bigint")))
    total = plan.agg(F.sum("groups")).first()[0] or 0
    if total <= MAX_TASKS:  # so at most as many rows stand in the window
        return plan.withColumn("first", F.sum("groups").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("groups")), max(1, total)
    return plan.withColumn("first", F.col("shard") * 65_536), MAX_TASKS


def home_plan(home: DataFrame, layout: Layout, shard_rows: int) -> tuple[DataFrame, int]:
    """(shard, subs, first) of the shards of ``home``, and the number of partitions: a shard is in parts of at most about twice ``shard_rows``."""
    if layout.split is None:  # no shard is larger
        rows = [(p * WIDE, 1, i) for i, p in enumerate(sorted(layout.sizes))]
        return home.sparkSession.createDataFrame(rows, "shard bigint, subs bigint, first bigint"), max(1, len(rows))
    return numbered(home.groupBy("shard").agg(F.ceil(F.count("*") / (2 * shard_rows)).alias("subs")), F.col("subs"))


def joined(rows: DataFrame, plan: DataFrame, tasks: int) -> DataFrame:
    """``rows`` (shard, ...) with the columns of the plan, which is broadcast while it has at most MAX_TASKS rows."""
    return rows.join(F.broadcast(plan) if tasks < MAX_TASKS else plan, "shard")


def placed(rows: DataFrame, tasks: int, group: str = "block") -> DataFrame:
    """``rows`` with their ``task``, each in the partition of that number.

    Columns are named anew, as a cogroup confuses those that both sides have from one source.
    """
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])
    return rows.withColumn("task", F.pmod(F.col(group), F.lit(tasks)).cast("int")).repartitionById(tasks, "task")


def cut_placed(rows: DataFrame, tasks: int, group: str = "block") -> DataFrame:
    """``rows`` placed, sorted and materialised so that later groupings by (task, group) find them in place."""
    return cut_in_place(placed(rows, tasks, group).sortWithinPartitions("task", group))

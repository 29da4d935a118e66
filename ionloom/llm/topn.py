"""The N best items of every group, by merging sorted runs with a loser tree."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs of one group that are merged at a time; more are merged in several passes, so memory is bounded by WIDTH x n rows.
WIDTH = 64
#: Rows of a batch of results.
OUT_ROWS = 10_000


class LoserTree:
    """Multiway merge of sorted runs: inner nodes hold the loser of each match, so replaying one path finds the next head.

    ``heads[i]`` is the current key of run i, None when it is used up; equal keys go to the smaller run.
    """

    def __init__(self, heads: list):
        self.heads = heads
        self.k = max(1, len(heads))
        self.loser = [-1] * self.k
        self.winner = -1
        if heads:
            self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.loser[node] = lose
        return win

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def replace(self, key) -> None:
        """Give the winning run its next key (None: it has ended) and replay its path."""
        at = self.winner
        self.heads[at] = key
        node = (at + self.k) // 2
        while node >= 1:
            if self._beats(self.loser[node], at):
                self.loser[node], at = at, self.loser[node]
            node //= 2
        self.winner = at


def merge_runs(runs: list[list[tuple]], n: int) -> list[tuple[tuple, int]]:
    """(row, place) of the first ``n`` distinct items of every group; a row is (group, order, item, ...), a run sorted so.

    After n outputs of a group each run seeks to its next group by binary search.
    """
    at = [0] * len(runs)
    groups = [[row[0] for row in run] for run in runs]
    tree = LoserTree([run[0][:2] if run else None for run in runs])
    out: list[tuple[tuple, int]] = []
    group, seen = None, set()
    while runs and tree.heads[tree.winner] is not None:
        w = tree.winner
        row = runs[w][at[w]]
        if row[0] != group:
            group, seen = row[0], set()
        if len(seen) < n and row[2] not in seen:
            seen.add(row[2])
            out.append((row, len(seen)))
        at[w] = at[w] + 1 if len(seen) < n else bisect_right(groups[w], group, lo=at[w])
        tree.replace(runs[w][at[w]][:2] if at[w] < len(runs[w]) else None)
    return out


def _prune(table: pa.Table, n: int, carry: tuple) -> tuple[np.ndarray, tuple]:
    """Rows of a sorted batch that may be among the first n distinct items of their group; carry: (group, items so far)."""
    groups, items = table.column("g").to_pylist(), table.column("item").to_pylist()
    keep = np.zeros(len(groups), dtype=bool)
    group, seen = carry
    i, size = 0, len(groups)
    while i < size:
        g = groups[i]
        if g != group:
            group, seen = g, set()
        elif len(seen) >= n:
            i = bisect_right(groups, g, lo=i)  # seek: the run is sorted by group
            continue
        if items[i] not in seen:
            seen.add(items[i])
            keep[i] = True
        i += 1
    return keep, (group, seen)


def merge_groups(rows: Iterable[tuple], n: int, width: int = WIDTH) -> Iterator[tuple[tuple, int]]:
    """(row, place) of the first ``n`` distinct items of every group; rows are (group, run, order, item, ...), by group, run and order.

    Holds the runs of one group only, at most ``width`` of them, each of n rows at most if it was cut: these are merged to one of ``n`` rows before more are read.
    """
    group, run, runs = None, None, []

    def merged() -> list[tuple[tuple, int]]:
        return merge_runs([[(r[0], r[2], r[3], r) for r in rows] for rows in runs], n)

    for row in rows:
        if row[0] != group:
            for best, place in merged():
                yield best[3], place
            group, run, runs = row[0], row[1], [[row]]
        elif row[1] != run:
            if len(runs) == width:
                runs = [[best[3] for best, _ in merged()]]
            run = row[1]
            runs.append([row])
        else:
            runs[-1].append(row)
    for best, place in merged():
        yield best[3], place


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, tie: str, n: int = 10) -> DataFrame:
    """(<group>, <item>, <score>, <tie>, place): the best row of each item, places 1 to n in every group.

    Better is the higher score, then the smaller ``tie`` (null and NaN last), then the smaller item, so the order
    is total and never changes. Rows with a null or NaN score, or a null group or item, are set aside; repeated rows
    count once; an empty table gives an empty result; other columns aren't read.

    Every input partition becomes a run sorted by (group, order), cut to n items a group before it is stored: what is
    shuffled is bounded by runs x groups x n, however many rows a group has. The shuffle stores the runs by bucket, its
    partitions (a hash of the group); there they are sorted by (group, run, order), outside memory if they must be, and a
    loser tree merges the runs of one group after the other. No task holds a whole group or a whole bucket.
    """
    err = F.col(tie).cast("double")
    slim = (
        df.select(F.col(group).cast("string").alias("g"), F.col(item).cast("string").alias("item"), F.col(score).cast("double").alias("s"), F.when(err.isNull() | F.isnan(err), F.lit(float("inf"))).otherwise(err).alias("e"), err.alias("t"))
        .where(F.col("s").isNotNull() & ~F.isnan("s") & F.col("g").isNotNull() & F.col("item").isNotNull())
    )
    runs = slim.sortWithinPartitions("g", F.desc("s"), "e", "item").withColumn("run", F.spark_partition_id())

    def prune(batches):
        carry = (None, set())
        for batch in batches:
            keep, carry = _prune(pa.Table.from_batches([batch]), n, carry)
            yield batch.filter(pa.array(keep))

    stored = runs.mapInArrow(prune, runs.schema).repartition("g").sortWithinPartitions("g", "run", F.desc("s"), "e", "item")

    def merge(batches):
        def rows():
            for b in batches:
                for g, i, s, e, t, run in zip(*(c.to_pylist() for c in b.columns)):
                    yield g, run, (-s, e, i), i, s, t

        def table(out):
            columns = list(zip(*((g, i, s, t, place) for (g, _, _, i, s, t), place in out))) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["g", "item", "s", "t", "place"])

        out = []
        for best in merge_groups(rows(), n):
            out.append(best)
            if len(out) == OUT_ROWS:
                yield table(out)
                out = []
        yield table(out)

    merged = stored.mapInArrow(merge, "g string, item string, s double, t double, place bigint")
    return merged.select(F.col("g").alias(group), F.col("item").alias(item), F.col("s").alias(score), F.col("t").alias(tie), "place")

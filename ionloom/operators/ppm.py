"""Joins on a relative mass window."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.operators.skew import salted_join
from ionloom.session import cut


def ppm_join(queries: DataFrame, structures: DataFrame, query_mass: str, mass: str, ppm: float = 10.0, same: tuple[str, str] | None = None) -> DataFrame:
    """Rows of both sides with mass in [M - M*ppm/1e6, M + M*ppm/1e6], M the query's mass, both ends included.

    Equi-join on buckets of log mass, a query in every bucket that its window touches, then the exact bounds; a mass
    that holds a large share of the structures is spread over salts. Null, NaN and masses of 0 or less match nothing.
    ``same``: a column of the queries and one of the structures that must be equal too; it is part of the join's key.
    """
    w = ppm * 1e-6
    bucket = lambda m: F.floor(F.ln(m) / math.log1p(w))
    q = queries.where((F.col(query_mass) > 0) & ~F.isnan(query_mass)).withColumn("__low", F.col(query_mass) - F.col(query_mass) * w).withColumn("__high", F.col(query_mass) + F.col(query_mass) * w)
    q = q.withColumn("__b", F.explode(F.sequence(bucket(F.col("__low")) - 1, bucket(F.col("__high")) + 1)))
    s = structures.where((F.col(mass) > 0) & ~F.isnan(mass)).withColumn("__b", bucket(F.col(mass)))
    if same:
        key = lambda c: F.concat_ws("|", F.col("__b").cast("string"), c)
        q, s = q.where(F.col(same[0]).isNotNull()).withColumn("__b", key(same[0])), s.where(F.col(same[1]).isNotNull()).withColumn("__b", key(same[1]))
    joined = salted_join(s, q, "__b", heavy_share=0.02)
    return joined.where((F.col(mass) >= F.col("__low")) & (F.col(mass) <= F.col("__high"))).drop("__b", "__low", "__high")


def adaptive_window(queries: DataFrame, structures: DataFrame, query_id: str, query_mass: str, mass: str, *, least: int = 25, ppm: float = 10.0, last: float = 50.0) -> DataFrame:
    """ppm_join with a window that doubles while it holds fewer than ``least`` structures and is under ``last`` ppm.

    One join at the widest window; per query the smallest window with enough structures is kept, in ``ppm``.
    """
    steps = [ppm]
    while steps[-1] < last:
        steps.append(2 * steps[-1])
    wide = ppm_join(queries, structures, query_mass, mass, steps[-1])
    inside = lambda p: (F.col(mass) >= F.col(query_mass) - F.col(query_mass) * (p * 1e-6)) & (F.col(mass) <= F.col(query_mass) + F.col(query_mass) * (p * 1e-6))
    counts = wide.groupBy(F.col(query_id).alias("__q")).agg(*[F.count_if(inside(p)).alias(f"n{i}") for i, p in enumerate(steps)])
    chosen = F.lit(steps[-1])
    for i in reversed(range(len(steps) - 1)):
        chosen = F.when(F.col(f"n{i}") >= least, steps[i]).otherwise(chosen)
    kept = wide.join(counts.select("__q", chosen.alias("ppm")), F.col(query_id) == F.col("__q")).drop("__q")
    return kept.where(inside(F.col("ppm")))


def ppm_error(mass, query_mass):
    return F.abs(mass - query_mass) / query_mass * 1e6


def window_sizes(queries: DataFrame, structures: DataFrame, query_id: str, query_mass: str, mass: str, ppm: float = 10.0) -> DataFrame:
    """(query_id, window_size): structures in each query's window, 0 where there is none."""
    sizes = ppm_join(queries, structures, query_mass, mass, ppm).groupBy(query_id).agg(F.count("*").alias("n"))
    return queries.select(query_id).distinct().join(sizes, query_id, "left").select(query_id, F.coalesce("n", F.lit(0)).alias("window_size"))


def mass_chunks(structures: DataFrame, mass: str, rows: int) -> DataFrame:
    """``structures`` with the chunk of each row: about ``rows`` a chunk in order of mass, equal masses together.

    Counts per distinct mass are summed up over a coarse grid of masses first, so no task sorts all of them.
    """
    counts = structures.where(F.col(mass).isNotNull()).groupBy(F.col(mass).alias("m")).agg(F.count("*").alias("n")).withColumn("cell", F.floor("m"))
    cells = counts.groupBy("cell").agg(F.sum("n").alias("c"))  # one row a dalton: thousands, however many structures
    before = cells.select("cell", (F.sum("c").over(Window.orderBy("cell")) - F.col("c")).alias("before"))
    inside = Window.partitionBy("cell").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    chunks = counts.join(F.broadcast(before), "cell").select("m", F.floor((F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))) / rows).cast("bigint").alias("chunk"))
    return structures.join(chunks, F.col(mass) == F.col("m")).drop("m")


def with_position(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """``df`` with the place of each row, from 0, in a global order: range partitions, then the sizes of those before.

    Only one row a partition is broadcast; the sorted rows are kept, so the places can't change on a retry.
    """
    width = 1 << 33
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.floor(F.col("__id") / width).alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return placed.withColumn("__part", F.floor(F.col("__id") / width)).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__id") % width).drop("__id", "__part", "__before")


def window_spans(queries: DataFrame, placed: DataFrame, query_mass: str, mass: str, ppm: float = 10.0, position: str = "position") -> DataFrame:
    """``queries`` with the first position and the number of structures in their window (queries without any are left out).

    Windows are joined on distinct masses with their counts, so a mass that many structures and queries share is one row.
    """
    masses = placed.where(F.col(mass).isNotNull()).groupBy(F.col(mass).alias("__s")).agg(F.count("*").alias("__c"), F.min(position).alias("__f"))
    asked = queries.select(F.col(query_mass).alias("__m")).distinct()
    spans = ppm_join(asked, masses, "__m", "__s", ppm).groupBy("__m").agg(F.min("__f").alias("first"), F.sum("__c").alias("n"))
    return queries.join(spans, F.col(query_mass) == F.col("__m")).drop("__m")

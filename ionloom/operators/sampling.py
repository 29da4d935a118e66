"""Samples and splits in hash order: uniform, and the same on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.operators.dedupe import first_n
from ionloom.operators.ppm import window_spans, with_position


def hash_order(seed: int, *ids: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def hash_share(seed: int, ident: Column) -> Column:
    """A number in [0, 1) from 32 bits of the hash."""
    return F.conv(F.substring(hash_order(seed, ident), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def bernoulli(df: DataFrame, ident: str, share: float, seed: int = 0) -> DataFrame:
    """Each row by itself with probability ``share``."""
    return df.where(hash_share(seed, F.col(ident)) < share)


def n_per_group(df: DataFrame, keys: list[str], ident: str, n: int, seed: int = 0) -> DataFrame:
    return first_n(df, keys, n, hash_order(seed, F.col(ident)), ident)


def split_keys(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """(key, held_out): distinct non-null keys, about ``share`` of them held out."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return keys.withColumn("held_out", hash_share(seed, F.col(key)) < share)


def whole_groups(df: DataFrame, key: str, rows: int, cap: int, seed: int = 0) -> DataFrame:
    """(key, taken): groups in hash order until their rows, at most ``cap`` a group, reach ``rows``.

    Only the groups that may be needed (``rows`` at most) are put in order.
    """
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.least(F.count("*"), F.lit(cap)).alias("taken")).withColumn("h", hash_order(seed, F.col(key)))
    first = sizes.orderBy("h", key).limit(rows)
    before = F.coalesce(F.sum("taken").over(Window.orderBy("h", key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("before", before).where(F.col("before") < rows).select(key, "taken")


#: Step between the draws of fixed_decoys: a prime, so that draws repeat only in windows of a multiple of its size.
STEP = 1_000_003


def _spans(queries: DataFrame, structures: DataFrame, query_key: str, query_mass: str, key: str, mass: str, ppm: float) -> tuple[DataFrame, DataFrame]:
    placed = with_position(structures.where(F.col(mass).isNotNull()).select(F.col(mass).alias("s"), F.col(key).alias("k")), "s", "k")
    return window_spans(queries.select(F.col(query_key).alias("q"), F.col(query_mass).alias("m")), placed, "m", "s", ppm), placed


def fixed_decoys(queries: DataFrame, structures: DataFrame, *, query_key: str, query_mass: str, key: str, mass: str, drawn: int = 48, kept: int = 32, ppm: float = 10.0, seed: int = 0) -> DataFrame:
    """(query_key, key, slot, window_size): up to ``kept`` structures of a query's window that aren't itself.

    ``drawn`` are drawn without replacement, from a hashed start in steps of STEP around the window; of these the first
    that differ from the query are kept. Windows are spans of positions: no window is ever listed.
    """
    spans, placed = _spans(queries, structures, query_key, query_mass, key, mass, ppm)
    draws = spans.withColumn("j", F.explode(F.sequence(F.lit(0), F.least(F.lit(drawn), F.col("n")).cast("int") - 1)))
    at = (F.floor(hash_share(seed, F.col("q")) * F.col("n")).cast("bigint") + F.col("j").cast("bigint") * STEP) % F.col("n")
    found = draws.withColumn("position", F.col("first") + at).join(placed.select("position", "k"), "position").where("q <> k")
    slots = found.withColumn("slot", F.row_number().over(Window.partitionBy("q").orderBy("j")).cast("bigint")).where(F.col("slot") <= kept)
    return slots.select(F.col("q").alias(query_key), F.col("k").alias(key), "slot", F.col("n").alias("window_size"))


def fresh_decoys(queries: DataFrame, structures: DataFrame, *, query_key: str, query_mass: str, key: str, mass: str, slots: int = 32, ppm: float = 10.0, seed: int = 0) -> DataFrame:
    """(query_key, slot, key): ``slots`` draws with replacement from a query's window; a smaller window gives each row once.

    A draw of the query itself leaves its slot empty (no row). Windows are spans of positions, as in fixed_decoys.
    """
    spans, placed = _spans(queries, structures, query_key, query_mass, key, mass, ppm)
    draws = spans.withColumn("slot", F.explode(F.sequence(F.lit(0), F.least(F.lit(slots), F.col("n")).cast("int") - 1)))
    at = F.when(F.col("n") < slots, F.col("slot")).otherwise(F.floor(hash_share(seed, F.concat_ws("#", "q", "slot")) * F.col("n"))).cast("bigint")
    drawn = draws.withColumn("position", F.col("first") + at).join(placed.select("position", "k"), "position").where("q <> k")
    return drawn.select(F.col("q").alias(query_key), F.col("slot").cast("bigint").alias("slot"), F.col("k").alias(key))

"""Results per key when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_counts(df: DataFrame, key: Column, salts: int = 16) -> DataFrame:
    """(key, n): rows per non-null key, counted per (key, salt) and merged by key.

    The partial counts are combined before the shuffle; the salt bounds what any reducer gets of one key.
    """
    salted = df.select(key.alias("key"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("salt")).where(F.col("key").isNotNull())
    return salted.groupBy("key", "salt").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"))


def heavy_keys(df: DataFrame, key: Column, share: float) -> DataFrame:
    """(key, n): the keys with at least ``share`` of all rows of ``df``, null keys aside; never more than 1/share rows.

    One aggregation gives the counts and, added up, the total; nothing runs while the plan is built.
    """
    counts = df.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("__total")))  # one row
    return counts.join(total, F.col("key").isNotNull() & (F.col("n") >= F.lit(share) * F.col("__total"))).drop("__total")


def salted_aggregate(df: DataFrame, key: Column, distinct: Column, value: Column, *, heavy_share: float = 0.01, salts: int = 32) -> DataFrame:
    """(key, n, n_distinct, mean_value, is_heavy): two-stage salted aggregation.

    Keys with ``heavy_share`` of the rows or more (at most 1/heavy_share of them, so broadcast) get a salt. It is
    made from the value counted distinctly, so equal values share a salt and the distinct counts of the salts add up;
    rows without such a value take a random salt. Stage one aggregates per (key, salt, value), stage two per
    (key, salt), the merge per key. No row is dropped.

    Null keys form one group; null values count in ``n`` only; an empty table gives an empty result. Columns of
    ``df`` beyond the three expressions aren't read.
    """
    slim = df.select(key.alias("key"), distinct.cast("string").alias("d"), value.cast("double").alias("v"))
    heavy = F.broadcast(heavy_keys(slim, F.col("key"), heavy_share).select(F.col("key").alias("hk"), F.lit(True).alias("is_heavy")))
    flagged = slim.join(heavy, F.col("key") == F.col("hk"), "left").withColumn("is_heavy", F.coalesce("is_heavy", F.col("key").isNull()))
    salt = F.when(F.col("is_heavy"), F.pmod(F.coalesce(F.xxhash64("d"), F.monotonically_increasing_id()), F.lit(salts))).otherwise(F.lit(0))
    # xxhash64 of NULL is the seed, not NULL
    salt = F.when(F.col("d").isNull() & F.col("is_heavy"), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(salt)
    first = flagged.withColumn("salt", salt).groupBy("key", "salt", "d").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.count("v").alias("c"), F.max("is_heavy").alias("is_heavy"))
    second = first.groupBy("key", "salt").agg(F.sum("n").alias("n"), F.count("d").alias("nd"), F.sum("s").alias("s"), F.sum("c").alias("c"), F.max("is_heavy").alias("is_heavy"))
    merged = second.groupBy("key").agg(F.sum("n").alias("n"), F.sum("nd").alias("n_distinct"), F.try_divide(F.sum("s"), F.sum("c")).alias("mean_value"), F.max("is_heavy").alias("is_heavy"))
    return merged.withColumn("is_heavy", F.col("is_heavy") & F.col("key").isNotNull())


def salted_join(left: DataFrame, right: DataFrame, key: str, *, how: str = "inner", heavy_share: float = 0.01, salts: int = 32, sample: DataFrame | None = None) -> DataFrame:
    """Equi-join on ``key`` in which a hot key of ``left`` is spread over ``salts`` reducers.

    ``right`` repeats only the rows of the hot keys (at most 1/heavy_share keys). Null keys never match; with
    how="left" their rows stay. ``sample``: rows of the left side to find the hot keys in, where counting all would cost
    as much as the join; that changes where rows go, never which come out.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how={how}: a salted join keeps rows of the left side only once")
    hot = heavy_keys(left if sample is None else sample, F.col(key), heavy_share).select(F.col("key").alias("__hot"))
    spread = left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__hot").isNotNull() | F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("__hot")
    wide = right.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return spread.join(wide, [key, "__salt"], how).drop("__salt")

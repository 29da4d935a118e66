"""One row per key, by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of every key by ``order`` (nulls first, as Spark sorts them ascending); ties must not be left open.

    The rank is limited to 1 before the shuffle, so a hot key sends one row a task.
    """
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def first_n(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def mark(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with a flag whether its key stands in ``other``."""
    known = other.select(F.col(key).alias("__k")).where("__k is not null").distinct()
    return df.join(known, F.col(key) == F.col("__k"), "left").withColumn(name, F.col("__k").isNotNull()).drop("__k")


def lookup_or_fail(df: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """``df`` with ``value`` by ``key`` from ``dim`` (one row a key); a key that isn't there stops the query and names it."""
    joined = df.join(dim.select(F.col(key).alias("__k"), F.col(value).alias("__v")), F.col(key) == F.col("__k"), "left")
    missing = F.raise_error(F.concat(F.lit(f"no {value} for "), F.coalesce(F.col(key).cast("string"), F.lit("a null key"))))
    return joined.withColumn(value, F.when(F.col("__k").isNull(), missing).otherwise(F.col("__v"))).drop("__k", "__v")

"""Sinks: Parquet, mass-ordered parts, parts that resume, CSV, submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.sources.cache import finished


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_mass_parts(df: DataFrame, path: str, mass: str, parts: int, mode: str = "errorifexists") -> None:
    """Parts in order of mass: every mass of a part lies below those of the next, equal masses stay together."""
    df.repartitionByRange(parts, mass).sortWithinPartitions(mass).write.mode(mode).option("compression", "zstd").parquet(path)


def write_missing(df: DataFrame, path: str, part: str) -> list:
    """Append only the values of ``part`` that ``path`` has no finished partition of; returns those written.

    Spark's committer publishes a part when its job ends, so an interrupted run leaves no half part behind; ``part`` takes
    few values.
    """
    spark, todo = df.sparkSession, df
    if finished(spark, path):
        done = spark.read.parquet(path).select(F.col(part).cast("string").alias("__done")).distinct()
        todo = df.join(done, F.col(part).cast("string") == F.col("__done"), "left_anti")
    written = [r[0] for r in todo.select(part).distinct().collect()]
    if written:
        todo.repartition(part).write.mode("append").partitionBy(part).option("compression", "zstd").parquet(path)
    return written


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; arrays must be joined to text before."""
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"')

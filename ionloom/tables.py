"""Loading tables of a data folder: one Parquet file or directory per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str, *columns: str | Column) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df

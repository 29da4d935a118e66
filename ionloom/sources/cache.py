"""Tables that are computed once and read from then on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a job has written ``path`` to its end: the committer's mark is there."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def computed_or_read(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; computed and written there first unless a finished one is there. A half-written one is replaced."""
    if not finished(spark, path):
        compute().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def missing_rows(spark: SparkSession, path: str, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``wanted`` whose key a cache at ``path`` doesn't hold: all of them where there is none."""
    if not finished(spark, path):
        return wanted
    return wanted.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")

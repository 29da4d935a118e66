"""Spectra as a stream: quality filter, counts by event time, candidates from a static library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions import metadata as M
from ionloom.functions import spectra as S


def read_spectra(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def clean_only(stream: DataFrame) -> DataFrame:
    """The spectra that pass the quality rule; no state."""
    return stream.where(S.is_clean(F.col("precursor_error_ppm"), F.col("num_peaks"), F.col("ms2_mzs"), F.col("precursor_mz")))


def counts_by_time(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Spectra per window of event time; rows later than ``late`` behind the newest are left out, state is dropped with them."""
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    counted = timed.groupBy(F.window("__t", width), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def first_of_each(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Repeated deposits within the watermark, once."""
    return stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late).dropDuplicatesWithinWatermark([key]).drop("__t")


def candidates(stream: DataFrame, structures: DataFrame, ppm: float = 10.0) -> DataFrame:
    """(row_id, fp_index): stream-static join on buckets of log mass; the stream's side is spread over its buckets."""
    import math

    w = ppm * 1e-6
    bucket = lambda m: F.floor(F.ln(m) / math.log1p(w))
    q = stream.select("row_id", M.neutral_mass(F.col("precursor_mz"), F.col("adduct")).alias("m")).where("m > 0")
    q = q.withColumn("b", F.explode(F.sequence(bucket(F.col("m") - F.col("m") * w) - 1, bucket(F.col("m") + F.col("m") * w) + 1)))
    s = structures.where("mass > 0").select("fp_index", "mass", bucket(F.col("mass")).alias("b"))
    joined = q.join(s, "b").where((F.col("mass") >= F.col("m") - F.col("m") * w) & (F.col("mass") <= F.col("m") + F.col("m") * w))
    return joined.select("row_id", "fp_index")

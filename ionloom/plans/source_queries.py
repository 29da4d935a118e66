"""Sinks and sources, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.plans.registry import Registry
from ionloom.session import scratch
from ionloom.sources import cache, readers, writers
from ionloom.tables import load

registry = Registry()


@registry.query("SELECT fp_index, normalized_smiles, inchikey14, exact_mass FROM molecules WHERE exact_mass IS NOT NULL")
def mass_parts_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Parts in order of mass, read by a glob of their names."""
    path = scratch(spark)
    writers.write_mass_parts(load(spark, folder, "molecules").where("exact_mass is not null"), path, "exact_mass", 4)
    return readers.parquet(spark, f"{path}/part-*.parquet", "fp_index", "normalized_smiles", "inchikey14", "exact_mass")


@registry.query("SELECT fp_index, normalized_smiles, exact_mass FROM molecules")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    writers.write_csv(load(spark, folder, "molecules", "fp_index", "normalized_smiles", "exact_mass"), path)
    return readers.csv(spark, path, "fp_index bigint, normalized_smiles string, exact_mass double")


@registry.query("SELECT source, count(*) AS n FROM candidates WHERE source IS NOT NULL GROUP BY source")
def resumed_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts by source: an interrupted run wrote some, the next writes the rest, a third nothing."""
    path, rows = scratch(spark), load(spark, folder, "candidates", "molecule_id", "key", "source").where("source is not null")
    writers.write_missing(rows.where("source < 'm'"), path, "source")
    writers.write_missing(rows, path, "source")
    if writers.write_missing(rows, path, "source"):
        raise RuntimeError("a finished part was written again")
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"))


@registry.query("SELECT 'm' || fp_index AS title, 0 AS atoms, nullif(trim(normalized_smiles), '') AS smiles FROM molecules")
def sdf_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Structure records in compressed text files."""
    path = scratch(spark)
    record = F.concat(F.lit("m"), F.col("fp_index").cast("string"), F.lit("\n  made\n\n  0  0  0  0  0  0            999 V2000\nM  END\n> <SMILES>\n"), F.coalesce("normalized_smiles", F.lit("")), F.lit("\n\n$$$$"))
    load(spark, folder, "molecules").select(record.alias("value")).write.option("compression", "gzip").text(path)
    return readers.sdf(spark, path, "SMILES").select("title", "atoms", F.col("SMILES").alias("smiles"))


@registry.query("SELECT ingest_lib, count(*) AS n FROM train GROUP BY ingest_lib")
def cached_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A table computed on the first call and read on the second."""
    path = scratch(spark)
    compute = lambda: load(spark, folder, "train", "ingest_lib").groupBy("ingest_lib").agg(F.count("*").alias("n"))
    cache.computed_or_read(spark, path, compute)
    return cache.computed_or_read(spark, path, lambda: compute().where("false"))

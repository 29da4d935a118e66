"""Inputs that several queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions import metadata as M
from ionloom.functions.keys import clean_key
from ionloom.functions.spectra import peaks
from ionloom.functions.vectors import doubles
from ionloom.operators.dedupe import keep_first
from ionloom.tables import load

CLEAN_KEY = r"""(CASE WHEN regexp_matches(regexp_replace(upper(regexp_replace(inchikey14, '\s', '', 'g')), '^INCHIKEY[=:]', ''), '^[A-Z]{14}(-.*)?$')
 THEN substr(regexp_replace(upper(regexp_replace(inchikey14, '\s', '', 'g')), '^INCHIKEY[=:]', ''), 1, 14) END)"""

ADDUCT_VALUES = "(VALUES " + ", ".join(f"('{a}', {n}, {s!r}::DOUBLE)" for a, (n, s) in M.ADDUCTS.items()) + ") AS ad(name, n_mol, shift)"
NEUTRAL = "(precursor_mz - coalesce(shift, 0.0)) / coalesce(n_mol::DOUBLE, 1.0)"

#: Sorted peaks of the SQL side: list of {mz, i}; test oracles use it wherever Spark uses peaks().
PEAKS = "list_transform(list_zip(ms2_mzs, ms2_normalized_intensities), lambda p: {'mz': p[1], 'i': p[2]})"


def train(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "train")


def train_spectra(spark: SparkSession, folder: str) -> DataFrame:
    """row_id, key, adduct, mode, precursor_mz, energies, p (peaks) of every training spectrum."""
    return load(spark, folder, "train").select(
        "row_id", clean_key(F.col("inchikey14")).alias("key"), "adduct", F.col("ionization_mode").alias("mode"), "precursor_mz", F.col("collision_energy_ev").alias("energies"), peaks(F.col("ms2_mzs"), F.col("ms2_normalized_intensities")).alias("p")
    )


def test_spectra(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "test").select("molecule_id", "spectrum_id", "adduct", F.col("ionization_mode").alias("mode"), "precursor_mz", F.col("collision_energy_orig").alias("energy"), peaks(F.col("ms2_mzs"), F.col("ms2_normalized_intensities")).alias("p"))


def structures(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "molecules").select("fp_index", clean_key(F.col("inchikey14")).alias("key"), F.col("normalized_smiles").alias("smiles"), F.col("exact_mass").alias("mass"))


#: One embedding a row_id, as DOUBLE; zero vectors set aside.
EMBEDDINGS = """
emb AS (
  SELECT row_id, e FROM (SELECT row_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM (SELECT DISTINCT row_id, embedding FROM spectrum_embeddings WHERE embedding IS NOT NULL))
  WHERE list_dot_product(e, e) > 0
)"""


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """row_id, e: as EMBEDDINGS."""
    raw = load(spark, folder, "spectrum_embeddings").where("embedding is not null").select("row_id", doubles(F.col("embedding")).alias("e"))
    return keep_first(raw, ["row_id"], "e").where(F.exists("e", lambda x: x != 0))


UNIT = "list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))"

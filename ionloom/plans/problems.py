"""Queries of the general data problems: units (2) and heavy keys (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions.keys import clean_key
from ionloom.operators.skew import salted_aggregate
from ionloom.operators.units import energies_in_ev, incomplete_energies, tenths
from ionloom.plans.registry import Registry
from ionloom.tables import load

registry = Registry()

#: Share of all rows from which a value is heavy.
ADDUCT_SHARE, MASS_SHARE = 0.05, 0.02


def mass_key():
    """floor(exact_mass * 10000 + 0.5) as text; NULL for a null or NaN mass."""
    return F.when(~F.isnan("exact_mass"), F.floor(F.col("exact_mass") * 10000 + 0.5).cast("bigint").cast("string"))


def _energy_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return load(spark, folder, "train"), load(spark, folder, "libraries"), load(spark, folder, "energy_units")


def energy_cte(p: str = "", table: str = "train", ident: str = "row_id", have: str = "collision_energy_ev", lib: str = "replace(lower(trim(ingest_lib)), '_', '-')", bare: str = "l.bare_energy_unit") -> str:
    """CTEs ending in <p>e: every number of the text, with the unit beside it, by patterns of its own."""
    return rf"""
{p}t AS (
  SELECT {ident} AS row_id, precursor_mz, {have} AS collision_energy_ev, lower(regexp_replace(collision_energy_orig, '[‐‑‒–—−]', '-', 'g')) AS x,
         {lib} AS lib
  FROM {table} WHERE regexp_matches(collision_energy_orig, '[0-9]')
), {p}u AS (
  SELECT t.*, CASE
      WHEN regexp_matches(x, 'kj[ ./]') THEN 'kj_per_mol'
      WHEN regexp_matches(x, 'kcal[ ./]') THEN 'kcal_per_mol'
      WHEN regexp_matches(x, 'mev') THEN 'mev'
      WHEN regexp_matches(x, 'kv') THEN 'kv'
      WHEN regexp_matches(x, 'nce|%|normali[sz]ed') THEN 'nce'
      WHEN regexp_matches(x, 'ev\b|electron') THEN 'ev'
      WHEN regexp_matches(x, '[0-9] ?v(olts?)?\b') THEN 'v'
      ELSE {bare} END AS unit
  FROM {p}t t LEFT JOIN libraries l ON t.lib = l.ingest_lib
), {p}n AS (
  SELECT row_id, precursor_mz, collision_energy_ev, unit,
         unnest(regexp_extract_all(regexp_replace(regexp_replace(x, 'mol-1', 'mol', 'g'), '^([^0-9]*[0-9]+),([0-9])( |$)', '\1.\2 '), '[0-9]+(\.[0-9]+)?'))::DOUBLE AS v
  FROM {p}u
), {p}e AS (
  SELECT row_id, collision_energy_ev, v, n.unit,
         v * ev_per_unit * CASE WHEN scales_with_mz THEN precursor_mz / 500.0 ELSE 1.0 END AS ev
  FROM {p}n n LEFT JOIN energy_units f ON n.unit = f.unit
)"""


_ENERGY_SQL = "WITH" + energy_cte()


@registry.query(
    _ENERGY_SQL
    + """, s AS (
  SELECT row_id, list_sort(list(DISTINCT floor(ev * 10.0 + 0.5)::BIGINT)) AS stated,
         coalesce(list_sort(list_distinct(list_transform(any_value(collision_energy_ev), lambda y: floor(y * 10.0 + 0.5)::BIGINT))), []) AS have
  FROM e WHERE ev IS NOT NULL GROUP BY row_id
)
SELECT row_id, unnest(stated) AS ev_tenths FROM s WHERE stated <> have"""
)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return incomplete_energies(*_energy_inputs(spark, folder))


@registry.query(_ENERGY_SQL + " SELECT row_id, v AS stated_value, unit, floor(ev * 10.0 + 0.5)::BIGINT AS ev_tenths FROM e")
def p2_energies(spark: SparkSession, folder: str) -> DataFrame:
    """Every stated energy in eV."""
    ev = energies_in_ev(*_energy_inputs(spark, folder))
    return ev.select("row_id", F.col("value").alias("stated_value"), "unit", tenths(F.col("ev")).alias("ev_tenths"))


def by_adduct(spark: SparkSession, folder: str) -> DataFrame:
    train = load(spark, folder, "train", "adduct", "inchikey14", "num_peaks")
    return salted_aggregate(train, F.col("adduct"), clean_key(F.col("inchikey14")), F.col("num_peaks"), heavy_share=ADDUCT_SHARE)


def by_mass(spark: SparkSession, folder: str) -> DataFrame:
    molecules = load(spark, folder, "molecules", "exact_mass", "inchikey14")
    return salted_aggregate(molecules, mass_key(), clean_key(F.col("inchikey14")), F.lit(None), heavy_share=MASS_SHARE)


_CLEAN_KEY = r"""(CASE WHEN regexp_matches(regexp_replace(upper(regexp_replace(inchikey14, '\s', '', 'g')), '^INCHIKEY[=:]', ''), '^[A-Z]{14}(-.*)?$')
 THEN substr(regexp_replace(upper(regexp_replace(inchikey14, '\s', '', 'g')), '^INCHIKEY[=:]', ''), 1, 14) END)"""


@registry.query(f"SELECT adduct, count(*) AS spectra, count(DISTINCT {_CLEAN_KEY}) AS molecules, round(avg(num_peaks), 6) AS mean_peaks FROM train GROUP BY adduct")
def p7_adducts(spark: SparkSession, folder: str) -> DataFrame:
    return by_adduct(spark, folder).select(F.col("key").alias("adduct"), F.col("n").alias("spectra"), F.col("n_distinct").alias("molecules"), F.round("mean_value", 6).alias("mean_peaks"))


@registry.query(f"SELECT CAST(floor(exact_mass * 10000 + 0.5) AS BIGINT)::VARCHAR AS mass, count(*) AS structures, count(DISTINCT {_CLEAN_KEY}) AS keys FROM molecules GROUP BY 1")
def p7_masses(spark: SparkSession, folder: str) -> DataFrame:
    return by_mass(spark, folder).select(F.col("key").alias("mass"), F.col("n").alias("structures"), F.col("n_distinct").alias("keys"))


@registry.query("""
SELECT 'adduct' AS field, adduct AS key FROM train WHERE adduct IS NOT NULL GROUP BY adduct HAVING count(*) >= 0.05 * (SELECT count(*) FROM train)
UNION ALL
SELECT 'exact_mass' AS field, key FROM (SELECT CAST(floor(exact_mass * 10000 + 0.5) AS BIGINT)::VARCHAR AS key FROM molecules)
WHERE key IS NOT NULL GROUP BY key HAVING count(*) >= 0.02 * (SELECT count(*) FROM molecules)""")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    heavy = lambda df, field: df.where("is_heavy").select(F.lit(field).alias("field"), "key")
    return heavy(by_adduct(spark, folder), "adduct").unionByName(heavy(by_mass(spark, folder), "exact_mass"))

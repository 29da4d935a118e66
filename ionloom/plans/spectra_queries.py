"""Profiles, predicates, metadata and peak preparation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions import metadata as M
from ionloom.functions import spectra as S
from ionloom.functions.chemistry import MONOISOTOPIC, formula_mass
from ionloom.operators.model import predict
from ionloom.operators.stats import quantiles
from ionloom.plans.common import ADDUCT_VALUES, NEUTRAL, PEAKS, test_spectra, train, train_spectra
from ionloom.plans.registry import Registry
from ionloom.tables import load

registry = Registry()
#: Length of metadata_features.
N_FEATURES = 3 + len(M.ENERGIES) + 1 + len(M.ADDUCTS) + 1

_BASIC = "SELECT count(*) AS spectra, count(DISTINCT inchikey14) AS keys, count(DISTINCT normalized_smiles) AS smiles, count(DISTINCT ingest_lib) AS libraries FROM {t}"
_GROUPS = "SELECT ingest_lib, instrument_type, ionization_mode, count(*) AS n FROM {t} GROUP BY ingest_lib, instrument_type, ionization_mode ORDER BY n DESC, ingest_lib, instrument_type, ionization_mode"
_NULLS = "SELECT " + ", ".join(f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS {c}" for c in ("normalized_smiles", "inchikey14", "adduct", "collision_energy_orig", "collision_energy_ev", "precursor_error_ppm", "ms2_mzs")) + " FROM {t}"
_FIRST = "SELECT row_id, adduct, precursor_mz, ingest_lib FROM {t} ORDER BY row_id LIMIT 5"


def _sql_query(name: str, text: str) -> None:
    """Register SQL that runs straight on the Parquet path, as it runs on the view."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return spark.sql(text.format(t=f"parquet.`{folder}/train.parquet`"))

    registry.query(text.format(t="train"), name)(run)


for _name, _text in (("sql_basic_stats", _BASIC), ("sql_group_counts", _GROUPS), ("sql_null_counts", _NULLS), ("sql_first_rows", _FIRST)):
    _sql_query(_name, _text)

_PROFILED = ("normalized_smiles", "inchikey14", "molecular_formula", "adduct", "ionization_mode", "ingest_lib", "instrument_type", "collision_energy_orig")


@registry.query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) - count({c}) AS nulls, count(DISTINCT {c}) + (count(*) > count({c}))::INT AS n_unique FROM train" for c in _PROFILED))
def profile_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Nulls and distinct values (null is one) per column, in one pass over the table."""
    t = train(spark, folder)
    wide = t.agg(*[F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), (F.countDistinct(c) + F.max(F.col(c).isNull()).cast("int")).alias("n_unique")).alias(c) for c in _PROFILED])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c + ".nulls"), F.col(c + ".n_unique")) for c in _PROFILED])).alias("r")).select("r.*")


@registry.query(" UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, round(min({c}::DOUBLE), 4) AS low, round(median({c}::DOUBLE), 4) AS mid, round(max({c}::DOUBLE), 4) AS high FROM train" for c in ("precursor_mz", "precursor_error_ppm", "num_peaks")))
def profile_numbers(spark: SparkSession, folder: str) -> DataFrame:
    names = ("precursor_mz", "precursor_error_ppm", "num_peaks")
    long = train(spark, folder).select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in names])).alias("r")).select("r.*")
    r = lambda c: F.round(c, 4)
    rest = long.groupBy("field").agg(F.count("v").alias("n"), r(F.avg("v")).alias("mean"), r(F.stddev_samp("v")).alias("sd"), r(F.min("v")).alias("low"), r(F.max("v")).alias("high"))
    return rest.join(quantiles(long, "v", {"mid": 0.5}, "field").select("field", r("mid").alias("mid")), "field")


@registry.query("""
SELECT row_id, coalesce(abs(precursor_error_ppm) <= 20, true) AND num_peaks >= 3 AND coalesce(list_max(ms2_mzs) - precursor_mz <= 3.0, true) AS is_clean FROM train""")
def clean_spectrum_mask(spark: SparkSession, folder: str) -> DataFrame:
    return train(spark, folder).select("row_id", S.is_clean(F.col("precursor_error_ppm"), F.col("num_peaks"), F.col("ms2_mzs"), F.col("precursor_mz")).alias("is_clean"))


_EMBEDDED = ", ".join(f"'{a}'" for a in M.EMBEDDED_ADDUCTS)
_SIGN = "((adduct LIKE '%+' AND ionization_mode = 'positive') OR (adduct LIKE '%-' AND ionization_mode = 'negative'))"


@registry.query(f"SELECT row_id, {_SIGN} AS sign_matches, coalesce({_SIGN} AND adduct IN ({_EMBEDDED}), false) AS gets_embedding FROM train")
def charge_sign(spark: SparkSession, folder: str) -> DataFrame:
    a, m = F.col("adduct"), F.col("ionization_mode")
    return train(spark, folder).select("row_id", M.sign_matches(a, m).alias("sign_matches"), M.gets_embedding(a, m).alias("gets_embedding"))


@registry.query(f"SELECT adduct, count(*) AS n FROM train WHERE {_SIGN} GROUP BY adduct HAVING count(*) >= 20")
def common_adducts(spark: SparkSession, folder: str) -> DataFrame:
    return train(spark, folder).where(M.sign_matches(F.col("adduct"), F.col("ionization_mode"))).groupBy("adduct").agg(F.count("*").alias("n")).where("n >= 20")


@registry.query(f"SELECT row_id, round({NEUTRAL}, 6) AS neutral_mass FROM train LEFT JOIN {ADDUCT_VALUES} ON adduct = name")
def neutral_mass(spark: SparkSession, folder: str) -> DataFrame:
    return train(spark, folder).select("row_id", F.round(M.neutral_mass(F.col("precursor_mz"), F.col("adduct")), 6).alias("neutral_mass"))


_STRICT = ", ".join(f"'{a}'" for a in M.STRICT_ADDUCTS)


@registry.query(f"SELECT molecule_id, round(avg(precursor_mz - shift), 5) AS mass, count(*) AS n FROM test JOIN {ADDUCT_VALUES} ON adduct = name WHERE adduct IN ({_STRICT}) GROUP BY molecule_id")
def query_masses(spark: SparkSession, folder: str) -> DataFrame:
    """The mean neutral mass of every test molecule's spectra with a known adduct."""
    known = load(spark, folder, "test", "molecule_id", "adduct", "precursor_mz").where(F.col("adduct").isin(*M.STRICT_ADDUCTS))
    return known.groupBy("molecule_id").agg(F.round(F.avg(M.strict_neutral_mass(F.col("precursor_mz"), F.col("adduct"))), 5).alias("mass"), F.count("*").alias("n"))


_FEATURES = ", ".join(
    [f"round(coalesce(precursor_mz / 1000.0, 0.0), 10) AS precursor, round(coalesce({NEUTRAL} / 1000.0, 0.0), 10) AS neutral, coalesce((ionization_mode = 'positive')::DOUBLE, 0.0) AS is_positive"]
    + [f"coalesce(list_contains(collision_energy_ev, {e})::DOUBLE, 0.0) AS energy_{int(e)}" for e in M.ENERGIES]
    + ["CASE WHEN len(list_filter(collision_energy_ev, lambda x: x NOT IN (20.0, 40.0, 60.0))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS energy_other"]
    + [f"coalesce((adduct = '{a}')::DOUBLE, 0.0) AS adduct_{i}" for i, a in enumerate(M.ADDUCTS)]
    + [f"coalesce((adduct NOT IN ({', '.join(repr(a) for a in M.ADDUCTS)}))::DOUBLE, 0.0) AS adduct_other"]
)


@registry.query(f"SELECT row_id, {_FEATURES} FROM train LEFT JOIN {ADDUCT_VALUES} ON adduct = name")
def metadata_features(spark: SparkSession, folder: str) -> DataFrame:
    f = M.metadata_features(F.col("precursor_mz"), F.col("adduct"), F.col("ionization_mode"), F.col("collision_energy_ev"))
    wide = train(spark, folder).select("row_id", *f)
    return wide.withColumns({c: F.round(c, 10) for c in ("precursor", "neutral")})


@registry.query("""
SELECT row_id, array_to_string(list_transform(collision_energy_ev, lambda e: trunc(e)::INT::VARCHAR), ',') AS energy,
       round(list_sum(collision_energy_ev) / nullif(len(collision_energy_ev), 0), 6) AS mean_energy FROM train""")
def energy_labels(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("collision_energy_ev")
    return train(spark, folder).select("row_id", M.energy_label(e).alias("energy"), F.round(M.mean_energy(e), 6).alias("mean_energy"))


@registry.query("""
WITH c AS (SELECT adduct, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, adduct) AS r FROM train WHERE adduct IS NOT NULL GROUP BY adduct)
SELECT CASE WHEN t.adduct IS NULL THEN 'unknown' WHEN r <= 5 THEN t.adduct ELSE 'other' END AS category, count(*) AS n FROM train t LEFT JOIN c ON t.adduct = c.adduct GROUP BY 1""")
def top_categories(spark: SparkSession, folder: str) -> DataFrame:
    t = train(spark, folder).select("adduct")
    top = F.broadcast(t.where("adduct is not null").groupBy("adduct").count().orderBy(F.desc("count"), "adduct").limit(5).select(F.col("adduct").alias("top")))
    named = t.join(top, F.col("adduct") == F.col("top"), "left")
    return named.groupBy(F.when(F.col("adduct").isNull(), "unknown").otherwise(F.coalesce("top", F.lit("other"))).alias("category")).agg(F.count("*").alias("n"))


@registry.query(f"""
SELECT molecule_id, count(*) AS n_spectra, array_to_string(list_sort(list(DISTINCT ionization_mode)), '+') AS polarities,
       coalesce(array_to_string(list_sort(list(DISTINCT adduct) FILTER (adduct IS NOT NULL)), '+'), '') AS adducts,
       coalesce(array_to_string(list_sort(list(collision_energy_orig) FILTER (collision_energy_orig IS NOT NULL)), ','), '') AS energies,
       round(avg({NEUTRAL}), 5) AS mass, round((max({NEUTRAL}) - min({NEUTRAL})) / avg({NEUTRAL}) * 1e6, 3) AS spread_ppm,
       coalesce(sum(len(ms2_mzs)), 0)::BIGINT AS peaks
FROM test LEFT JOIN {ADDUCT_VALUES} ON adduct = name GROUP BY molecule_id""")
def test_profile(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "test").withColumn("m", M.neutral_mass(F.col("precursor_mz"), F.col("adduct")))
    return t.groupBy("molecule_id").agg(
        F.count("*").alias("n_spectra"), F.array_join(F.sort_array(F.collect_set("ionization_mode")), "+").alias("polarities"), F.array_join(F.sort_array(F.collect_set("adduct")), "+").alias("adducts"),
        F.array_join(F.sort_array(F.collect_list("collision_energy_orig")), ",").alias("energies"), F.round(F.avg("m"), 5).alias("mass"), F.round((F.max("m") - F.min("m")) / F.avg("m") * 1e6, 3).alias("spread_ppm"),
        F.coalesce(F.sum(F.size("ms2_mzs").cast("bigint")), F.lit(0)).alias("peaks"),
    )


@registry.query("""
WITH p AS (SELECT row_id, precursor_mz, unnest(ms2_mzs) AS mz, unnest(ms2_normalized_intensities) AS i FROM train)
SELECT row_id, count(*) AS n, round(avg(CASE WHEN mz / precursor_mz > 1 THEN 1.0 ELSE 0.0 END), 6) AS above, round(avg(CASE WHEN i < 0.01 THEN 1.0 ELSE 0.0 END), 6) AS faint, round(max(mz / precursor_mz), 6) AS max_rel_mz
FROM p GROUP BY row_id""")
def peaks_long_profile(spark: SparkSession, folder: str) -> DataFrame:
    long = train_spectra(spark, folder).select("row_id", "precursor_mz", F.inline("p")).withColumn("rel", F.col("mz") / F.col("precursor_mz"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return long.groupBy("row_id").agg(F.count("*").alias("n"), share(F.col("rel") > 1).alias("above"), share(F.col("i") < 0.01).alias("faint"), F.round(F.max("rel"), 6).alias("max_rel_mz"))


@registry.query(f"""
WITH k AS (SELECT row_id, list_transform(list_filter({PEAKS}, lambda x: x.i >= 0.01 AND x.mz < precursor_mz - 1.5), lambda x: {{'mz': x.mz, 'i': sqrt(x.i)}}) AS p FROM train WHERE ms2_mzs IS NOT NULL),
n AS (SELECT row_id, p, sqrt(coalesce(list_sum(list_transform(p, lambda x: x.i * x.i)), 0)) AS n FROM k)
SELECT row_id, list_transform(p, lambda x: x.mz) AS mz, list_transform(p, lambda x: round(CASE WHEN n > 0 THEN x.i / n ELSE x.i END, 6)) AS i FROM n""")
def unit_spectra(spark: SparkSession, folder: str) -> DataFrame:
    p = train_spectra(spark, folder).where("p is not null").select("row_id", S.unit_peaks(F.col("p"), F.col("precursor_mz")).alias("p"))
    return p.select("row_id", F.transform("p", lambda x: x.mz).alias("mz"), F.transform("p", lambda x: F.round(x.i, 6)).alias("i"))


@registry.query(f"""
WITH p AS (SELECT row_id, precursor_mz, unnest({PEAKS}) AS x FROM train WHERE ms2_mzs IS NOT NULL),
r AS (SELECT row_id, precursor_mz, x.mz AS mz, x.i AS i, row_number() OVER (PARTITION BY row_id ORDER BY x.i DESC, x.mz) AS k FROM p),
t AS (SELECT row_id, any_value(precursor_mz) AS pm, max(i) AS top, list({{'mz': mz, 'i': i}} ORDER BY mz, i) AS p FROM r WHERE k <= 100 GROUP BY row_id),
e AS (SELECT row_id, precursor_mz AS pm FROM train WHERE ms2_mzs IS NOT NULL)
SELECT e.row_id, list_concat([e.pm], coalesce(list_transform(p, lambda x: x.mz), [])) AS mz, list_concat([1.1::DOUBLE], coalesce(list_transform(p, lambda x: round(x.i / top, 6)), [])) AS i
FROM e LEFT JOIN t ON e.row_id = t.row_id""")
def model_input_peaks(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred largest peaks by m/z behind the precursor's own entry."""
    p = train_spectra(spark, folder).where("p is not null").select("row_id", S.model_peaks(F.col("p"), F.col("precursor_mz")).alias("p"))
    return p.select("row_id", F.transform("p", lambda x: x.mz).alias("mz"), F.transform("p", lambda x: F.round(x.i, 6)).alias("i"))


@registry.query("""
WITH p AS (SELECT row_id, unnest(ms2_mzs) AS mz, unnest(ms2_normalized_intensities) AS i FROM train),
r AS (SELECT row_id, mz, i, row_number() OVER (PARTITION BY row_id ORDER BY i DESC, mz) AS k FROM p WHERE mz < 1000)
SELECT row_id, trunc(mz / 0.1)::INT AS bin, round(max(sqrt(i)), 6) AS value FROM r WHERE k <= 100 GROUP BY 1, 2""")
def peak_bins_max(spark: SparkSession, folder: str) -> DataFrame:
    """The largest root of intensity per bin: the sparse form of a model's input."""
    bins = train_spectra(spark, folder).select("row_id", F.inline(S.binned(F.col("p"))))
    return bins.groupBy("row_id", "bin").agg(F.round(F.max("v"), 6).alias("value"))


@registry.query("""
WITH p AS (SELECT unnest(ms2_mzs) AS mz, unnest(ms2_normalized_intensities) AS i FROM train)
SELECT floor(trunc(mz / 0.1) / 10)::BIGINT AS dalton, round(sum(i), 4) AS total, count(*) AS n FROM p WHERE mz >= 0 AND mz < 1000 GROUP BY 1""")
def rebinned_intensity(spark: SparkSession, folder: str) -> DataFrame:
    """Sums per 0.1 Da bin, added up to 1 Da."""
    long = train_spectra(spark, folder).select(F.inline("p")).where((F.col("mz") >= 0) & (F.col("mz") < 1000))
    fine = long.groupBy((F.col("mz") / 0.1).cast("int").alias("bin")).agg(F.sum("i").alias("s"), F.count("*").alias("c"))
    return fine.groupBy(F.floor(F.col("bin") / 10).alias("dalton")).agg(F.round(F.sum("s"), 4).alias("total"), F.sum("c").alias("n"))


@registry.query("""
WITH p AS (SELECT precursor_mz, trunc(unnest(ms2_mzs) / 0.1) AS bin, unnest(ms2_normalized_intensities) AS i FROM train)
SELECT floor(precursor_mz - (bin + 0.5) * 0.1)::BIGINT AS loss, round(sum(i), 4) AS total FROM p WHERE precursor_mz - (bin + 0.5) * 0.1 >= 0 GROUP BY 1""")
def neutral_loss_bins(spark: SparkSession, folder: str) -> DataFrame:
    long = train_spectra(spark, folder).select("precursor_mz", F.inline("p"))
    loss = F.col("precursor_mz") - ((F.col("mz") / 0.1).cast("int") + 0.5) * 0.1
    return long.where(loss >= 0).groupBy(F.floor(loss).alias("loss")).agg(F.round(F.sum("i"), 4).alias("total"))


@registry.query("""
WITH p AS (SELECT ionization_mode, precursor_mz, unnest(ms2_mzs) AS mz, unnest(ms2_normalized_intensities) AS i FROM train)
SELECT ionization_mode, round(sum(CASE WHEN abs(mz - precursor_mz) <= 1.5 THEN i ELSE 0 END) / sum(i), 6) AS precursor_share, round(sum(CASE WHEN mz > precursor_mz + 1.5 THEN i ELSE 0 END) / sum(i), 6) AS above_share,
       round(sum(CASE WHEN mz < precursor_mz - 1.5 THEN i ELSE 0 END) / sum(i), 6) AS rest_share FROM p GROUP BY ionization_mode""")
def category_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Intensity near the precursor (1.5 Da), above it, and below."""
    long = load(spark, folder, "train").select("ionization_mode", "precursor_mz", F.inline(S.peaks(F.col("ms2_mzs"), F.col("ms2_normalized_intensities"))))
    d = F.col("mz") - F.col("precursor_mz")
    share = lambda c: F.round(F.sum(F.when(c, F.col("i")).otherwise(0.0)) / F.sum("i"), 6)
    return long.groupBy("ionization_mode").agg(share((F.abs(F.col("mz") - F.col("precursor_mz")) <= 1.5)).alias("precursor_share"), share(F.col("mz") > F.col("precursor_mz") + 1.5).alias("above_share"), share(F.col("mz") < F.col("precursor_mz") - 1.5).alias("rest_share"))


@registry.query("SELECT instrument_type, adduct AS most_common, n FROM (SELECT instrument_type, adduct, count(*) AS n, row_number() OVER (PARTITION BY instrument_type ORDER BY count(*) DESC, adduct) AS r FROM train WHERE adduct IS NOT NULL GROUP BY 1, 2) WHERE r = 1")
def most_common_adduct(spark: SparkSession, folder: str) -> DataFrame:
    counts = train(spark, folder).where("adduct is not null").groupBy("instrument_type", "adduct").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("o"), "adduct"))
    return counts.groupBy("instrument_type").agg(best.alias("b")).select("instrument_type", F.col("b.adduct").alias("most_common"), (-F.col("b.o")).alias("n"))


@registry.query("""
SELECT CASE WHEN ms2_mzs IS NULL THEN 'no peaks' WHEN len(ms2_mzs) = 0 THEN 'empty' WHEN len(ms2_mzs) < 3 THEN 'few peaks' WHEN abs(precursor_error_ppm) > 20 THEN 'mass error'
 WHEN list_max(ms2_mzs) - precursor_mz > 3 THEN 'above precursor' ELSE 'kept' END AS reason, count(*) AS n FROM train GROUP BY 1""")
def drop_reasons(spark: SparkSession, folder: str) -> DataFrame:
    mz = F.col("ms2_mzs")
    reason = F.when(mz.isNull(), "no peaks").when(F.size(mz) == 0, "empty").when(F.size(mz) < 3, "few peaks").when(F.abs("precursor_error_ppm") > 20, "mass error").when(F.array_max(mz) - F.col("precursor_mz") > 3, "above precursor").otherwise("kept")
    return train(spark, folder).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_MASSES = "(VALUES " + ", ".join(f"('{e}', {m!r}::DOUBLE)" for e, m in MONOISOTOPIC.items()) + ") AS mm(element, em)"


@registry.query(f"""
WITH f AS (SELECT DISTINCT molecular_formula AS formula FROM train WHERE molecular_formula IS NOT NULL),
p AS (SELECT formula, unnest(regexp_extract_all(formula, '[A-Z][a-z]?[0-9]*')) AS p FROM f),
m AS (SELECT formula, sum(em * coalesce(nullif(regexp_extract(p, '([0-9]*)$', 1), '')::DOUBLE, 1.0)) AS s, count(*) = count(em) AS known FROM p LEFT JOIN {_MASSES} ON element = regexp_extract(p, '^([A-Z][a-z]?)', 1) GROUP BY formula)
SELECT formula, round(CASE WHEN known THEN s END, 5) AS mass FROM m""")
def formula_masses(spark: SparkSession, folder: str) -> DataFrame:
    """Exact masses, computed once a distinct formula."""
    return load(spark, folder, "train", F.col("molecular_formula").alias("formula")).where("formula is not null").distinct().select("formula", F.round(formula_mass(F.col("formula")), 5).alias("mass"))


@registry.query()
def model_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """A small network with fixed pseudo-random weights over every spectrum's bins and features: mean probability and bits set."""
    rng = np.random.default_rng(5)
    sizes = [10_000 + N_FEATURES, 32, 32, 64]
    layers = [(rng.standard_normal((a, b)).astype(np.float32) / np.sqrt(a), np.zeros(b, dtype=np.float32)) for a, b in zip(sizes[:-1], sizes[1:])]
    t = train(spark, folder)
    f = F.array(*M.metadata_features(F.col("precursor_mz"), F.col("adduct"), F.col("ionization_mode"), F.col("collision_energy_ev")))
    p = S.binned(S.peaks(F.col("ms2_mzs"), F.col("ms2_normalized_intensities")))
    out = predict(t.select("row_id", p.alias("peaks"), f.alias("features")), "row_id", layers)
    return out.select("row_id", F.round(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x) / F.size("probabilities"), 4).alias("mean_probability"), F.size(F.filter("probabilities", lambda x: x >= 0.5)).alias("bits"))

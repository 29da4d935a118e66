"""Scorers, library search and analyses of the embedding space."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionloom.functions import spectra as S
from ionloom.functions import vectors as V
from ionloom.functions.keys import clean_key
from ionloom.functions.metadata import ADDUCTS
from ionloom.functions.metadata import neutral_mass as neutral
from ionloom.operators import ranking as R
from ionloom.operators import stats
from ionloom.operators.ppm import with_position
from ionloom.operators.sampling import hash_order
from ionloom.operators.units import energies_in_ev, energy_setting
from ionloom.operators.windows import peak_cosines, search_library
from ionloom.plans.common import ADDUCT_VALUES, CLEAN_KEY, EMBEDDINGS, NEUTRAL, PEAKS, UNIT, embeddings, structures, test_spectra, train_spectra
from ionloom.plans.problems import energy_cte
from ionloom.plans.registry import Registry
from ionloom.session import cut
from ionloom.tables import load

registry = Registry()
#: Members of a molecule that are paired: part of these analyses' definition (a hundred spectra a molecule), so that pairs don't grow with the square of a group.
PAIR_CAP = 100


def keyed_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """row_id, key, adduct, mode, u (unit vector) of the spectra that have one."""
    t = load(spark, folder, "train").select("row_id", clean_key(F.col("inchikey14")).alias("key"), "adduct", F.col("ionization_mode").alias("mode"), "precursor_mz")
    return embeddings(spark, folder).join(t, "row_id").select("row_id", "key", "adduct", "mode", "precursor_mz", "e", V.unit(F.col("e")).alias("u"))


def key_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """key, a, b: pairs of spectra of one molecule, among its first PAIR_CAP in hash order."""
    return stats.pairs_within(keyed_embeddings(spark, folder), "key", "row_id", PAIR_CAP, hash_order(0, F.col("row_id")))


def pair_vectors(spark: SparkSession, folder: str) -> DataFrame:
    k = keyed_embeddings(spark, folder)
    pick = lambda s: k.select(F.col("row_id").alias(s), F.col("u").alias("u" + s), F.col("adduct").alias("adduct_" + s), F.col("mode").alias("mode_" + s))
    return key_pairs(spark, folder).join(pick("a"), "a").join(pick("b"), "b")


_KEYED = f"""{EMBEDDINGS}, t AS (SELECT row_id, {CLEAN_KEY} AS key, adduct, ionization_mode AS mode, precursor_mz FROM train),
ke AS (SELECT row_id, key, adduct, mode, precursor_mz, e, {UNIT} AS u FROM emb JOIN t USING (row_id))"""
_PAIRS = f"""{_KEYED},
m AS (SELECT key, row_id FROM (SELECT key, row_id, row_number() OVER (PARTITION BY key ORDER BY md5('0|' || row_id), row_id) AS r FROM ke WHERE key IS NOT NULL) WHERE r <= {PAIR_CAP}),
pr AS (SELECT x.key, x.row_id AS a, y.row_id AS b FROM m x JOIN m y ON x.key = y.key AND x.row_id < y.row_id),
pv AS (SELECT pr.key, a, b, x.u AS ua, y.u AS ub, x.adduct AS adduct_a, y.adduct AS adduct_b, x.mode AS mode_a, y.mode AS mode_b FROM pr JOIN ke x ON a = x.row_id JOIN ke y ON b = y.row_id)"""
_DOT = "list_dot_product(ua, ub)"
_ANGLE = f"acos(least(greatest({_DOT}, -1.0), 1.0)) / pi()"


@registry.query(f"WITH {_PAIRS} SELECT a, b, round(greatest({_DOT}, 0.0), 6) AS cosine, round(sqrt(greatest(2 - 2 * {_DOT}, 0.0)), 6) AS distance, round({_ANGLE}, 6) AS angle FROM pv")
def embedding_cosine(spark: SparkSession, folder: str) -> DataFrame:
    s = V.dot(F.col("ua"), F.col("ub"))
    return pair_vectors(spark, folder).select("a", "b", F.round(V.cosine_of_units(F.col("ua"), F.col("ub")), 6).alias("cosine"), F.round(V.euclidean(s), 6).alias("distance"), F.round(V.angular(s), 6).alias("angle"))


@registry.query(f"WITH {_KEYED} SELECT (d - 1)::INT AS dim, round(avg(u[d]), 8) AS mean FROM ke, range(1, 129) r(d) GROUP BY d")
def embedding_mean(spark: SparkSession, folder: str) -> DataFrame:
    return stats.mean_vector(keyed_embeddings(spark, folder), "u").select("dim", F.round("mean", 8).alias("mean"))


@registry.query(f"WITH {_KEYED} SELECT key, (d - 1)::INT AS dim, round(avg(u[d]), 8) AS mean FROM ke, range(1, 129) r(d) WHERE key IS NOT NULL GROUP BY key, d")
def molecule_mean_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return stats.mean_vector(keyed_embeddings(spark, folder).where("key is not null"), "u", "key").select("key", "dim", F.round("mean", 8).alias("mean"))


@registry.query(f"""
WITH {_PAIRS}, mu AS (SELECT list(x ORDER BY d) AS c FROM (SELECT d, avg(u[d]) AS x FROM ke, range(1, 129) r(d) GROUP BY d)),
c AS (SELECT a, b, list_transform(list_zip(ua, c), lambda p: p[1] - p[2]) AS x, list_transform(list_zip(ub, c), lambda p: p[1] - p[2]) AS y FROM pv, mu)
SELECT a, b, round(greatest(list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)), 0.0), 6) AS cosine FROM c""")
def embedding_cosine_centred(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine once the mean vector of all is taken off; that vector is one row, so it is broadcast."""
    mean = stats.mean_vector(keyed_embeddings(spark, folder), "u").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("c"))
    centre = [float(x) for x in mean.first()["c"] or []]
    off = lambda u: V.unit(F.zip_with(u, F.array(*[F.lit(x) for x in centre]), lambda x, m: x - m))
    return pair_vectors(spark, folder).select("a", "b", F.round(V.cosine_of_units(off(F.col("ua")), off(F.col("ub"))), 6).alias("cosine"))


_BITS = "list_transform({v}, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
_PROB = "list_transform(ua, lambda x: 1.0 / (1.0 + exp(-8.0 * x)))"
_SCORED = f"sc AS (SELECT a, b, {_PROB} AS p, {_BITS.format(v='ub')} AS bits FROM pv)"
_CLIP = "greatest(least(x, 1 - 1e-6), 1e-6)"


def _probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """a, b, p, bits: probabilities from the vector of a, bits from the signs of b's."""
    return pair_vectors(spark, folder).select("a", "b", V.sigmoid(F.col("ua"), 8.0).alias("p"), F.transform("ub", lambda x: F.when(x > 0, 1.0).otherwise(0.0)).alias("bits"))


@registry.query(f"""
WITH {_PAIRS}, {_SCORED} SELECT a, b, round(list_dot_product(bits, list_transform(p, lambda x: ln({_CLIP}) - ln(1 - {_CLIP}))), 5) AS likelihood,
 round(list_dot_product(p, bits) / (list_sum(p) + list_sum(bits) - list_dot_product(p, bits)), 6) AS tanimoto, round(list_dot_product(p, bits), 6) AS dot, round(list_dot_product(p, bits) / sqrt(greatest(list_sum(bits), 1.0)), 6) AS dot_over_root FROM sc""")
def fingerprint_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every scorer of the registry over predicted probabilities and bits."""
    digits = {"likelihood": 5}
    return _probabilities(spark, folder).select("a", "b", *[F.round(f(F.col("p"), F.col("bits")), digits.get(name, 6)).alias(name) for name, f in V.SCORERS.items()])


@registry.query(f"WITH {_KEYED}, p AS (SELECT row_id, {_PROB.replace('ua', 'u')} AS p FROM ke) SELECT row_id, round(list_sum(list_transform(p, lambda x: -x * log2(x + 1e-10) - (1 - x) * log2(1 - x + 1e-10))) / 128, 6) AS entropy FROM p")
def bit_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """The mean entropy of every spectrum's probabilities."""
    return keyed_embeddings(spark, folder).select("row_id", F.round(V.mean_entropy(V.sigmoid(F.col("u"), 8.0)), 6).alias("entropy"))


_WORDS = "[" + ", ".join(f"list_reduce(list_transform({{v}}[{32 * w + 1}:{32 * w + 32}], lambda x: CASE WHEN x > 0 THEN 1::BIGINT ELSE 0::BIGINT END), lambda s, x: s * 2 + x)" for w in range(4)) + "]"


@registry.query(f"""
WITH {_PAIRS}, w AS (SELECT a, b, {_WORDS.format(v='ua')} AS wa, {_WORDS.format(v='ub')} AS wb FROM pv)
SELECT a, b, round(list_sum(list_transform(list_zip(wa, wb), lambda p: bit_count(p[1] & p[2]))) / greatest(list_sum(list_transform(list_zip(wa, wb), lambda p: bit_count(p[1] | p[2]))), 1), 6) AS tanimoto FROM w""")
def binary_tanimoto_bits(spark: SparkSession, folder: str) -> DataFrame:
    """Tanimoto on packed sign bits, 32 a word."""
    return pair_vectors(spark, folder).select("a", "b", F.round(V.bit_tanimoto(V.sign_words(F.col("ua")), V.sign_words(F.col("ub"))), 6).alias("tanimoto"))


@registry.query(f"WITH {_KEYED}, b AS (SELECT key, d, max((u[d] > 0)::INT) AS x FROM ke, range(1, 129) r(d) WHERE key IS NOT NULL GROUP BY key, d) SELECT (d - 1)::INT AS bit, round(avg(x), 6) AS frequency, row_number() OVER (ORDER BY avg(x) DESC, d)::INT AS place FROM b GROUP BY d")
def bit_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """How often a bit is set, a molecule counting once, and the order of bits (one row a bit)."""
    long = keyed_embeddings(spark, folder).where("key is not null").select("key", F.posexplode("u").alias("bit", "x"))
    per = long.groupBy("key", "bit").agg(F.max((F.col("x") > 0).cast("int")).alias("x")).groupBy("bit").agg(F.avg("x").alias("f"))
    return per.select("bit", F.round("f", 6).alias("frequency"), F.row_number().over(Window.orderBy(F.desc("f"), "bit")).alias("place"))


@registry.query(f"""
WITH {_KEYED}, b AS (SELECT key, d, max((u[d] > 0)::INT) AS x FROM ke, range(1, 129) r(d) WHERE key IS NOT NULL GROUP BY key, d),
o AS (SELECT d, row_number() OVER (ORDER BY avg(x) DESC, d) AS place FROM b GROUP BY d), k AS (SELECT unnest(range(5, 101, 5)) AS k),
i AS (SELECT key, k, sum(CASE WHEN place <= k THEN x ELSE 0 END) AS shared, sum(x) AS bits FROM b JOIN o USING (d), k GROUP BY key, k)
SELECT k::INT AS k, round(avg(shared / (k + bits - shared)), 6) AS tanimoto FROM i GROUP BY k""")
def constant_bits_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Mean Tanimoto of the k commonest bits, k from 5 to 100, to every molecule's bits: one pass for all k."""
    long = keyed_embeddings(spark, folder).where("key is not null").select("key", F.posexplode("u").alias("bit", "x"))
    bits = long.groupBy("key", "bit").agg(F.max((F.col("x") > 0).cast("int")).alias("x"))
    placed = bits.join(F.broadcast(bit_frequency(spark, folder).select("bit", "place")), "bit")
    ks = list(range(5, 101, 5))
    per = placed.groupBy("key").agg(F.sum("x").alias("bits"), *[F.sum(F.when(F.col("place") <= k, F.col("x")).otherwise(0)).alias(f"k{k}") for k in ks])
    rows = per.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"k{k}") / (k + F.col("bits") - F.col(f"k{k}"))).alias("t")) for k in ks])).alias("r")).select("r.*")
    return rows.groupBy("k").agg(F.round(F.avg("t"), 6).alias("tanimoto"))


# --- peak scores and library search ----------------------------------------------------------------------------------

_UNIT_PEAKS = f"list_transform(list_filter({PEAKS}, lambda x: x.i >= 0.01 AND x.mz < precursor_mz - 1.5), lambda x: {{{{'mz': x.mz, 'i': sqrt(x.i)}}}})".replace("{{", "{").replace("}}", "}")
#: Settings in whole eV, by the unit operator on both sides; a test spectrum's bare number is in eV.
ENERGY_SETTING = "(SELECT row_id, array_to_string(list_sort(list(DISTINCT floor(ev + 0.5)::BIGINT)), ',') AS energy FROM {p}e WHERE ev IS NOT NULL GROUP BY row_id)"
_SPECTRA_SQL = f"""
{energy_cte('l')}, {energy_cte('q', 'test', 'spectrum_id', 'NULL', 'NULL', "'ev'")}, les AS {ENERGY_SETTING.format(p='l')}, qes AS {ENERGY_SETTING.format(p='q')},
sp0 AS (SELECT 't' || row_id AS id, {CLEAN_KEY} AS key, adduct, ionization_mode AS mode, precursor_mz, coalesce(energy, 'unknown') AS energy, {_UNIT_PEAKS} AS p FROM train LEFT JOIN les USING (row_id) WHERE ms2_mzs IS NOT NULL),
sp AS (SELECT id, key, adduct, mode, precursor_mz, energy, CASE WHEN n > 0 THEN list_transform(p, lambda x: {{'mz': x.mz, 'i': x.i / n}}) ELSE p END AS p FROM (SELECT *, sqrt(coalesce(list_sum(list_transform(p, lambda x: x.i * x.i)), 0)) AS n FROM sp0)),
te0 AS (SELECT spectrum_id AS id, molecule_id, adduct, ionization_mode AS mode, precursor_mz, coalesce(energy, 'unknown') AS energy, {_UNIT_PEAKS} AS p FROM test LEFT JOIN qes ON spectrum_id = row_id WHERE ms2_mzs IS NOT NULL),
te AS (SELECT id, molecule_id, adduct, mode, precursor_mz, energy, CASE WHEN n > 0 THEN list_transform(p, lambda x: {{'mz': x.mz, 'i': x.i / n}}) ELSE p END AS p FROM (SELECT *, sqrt(coalesce(list_sum(list_transform(p, lambda x: x.i * x.i)), 0)) AS n FROM te0))"""


def _cosine_sql(pairs: str, q: str, o: str) -> str:
    """(q, o, cosine) for ``pairs`` (q, o) over tables of spectra with p; nearest peak within 0.01, ties to the higher m/z."""
    return f"""
qp AS (SELECT id, unnest(p).mz AS mz, unnest(p).i AS i FROM {q} WHERE id IN (SELECT q FROM {pairs})), op AS (SELECT id, unnest(p).mz AS mz, unnest(p).i AS i FROM {o} WHERE id IN (SELECT o FROM {pairs})),
mt AS (SELECT pp.q, pp.o, a.mz, a.i, b.i AS bi, row_number() OVER (PARTITION BY pp.q, pp.o, a.mz, a.i ORDER BY abs(b.mz - a.mz), b.mz DESC, b.i) AS r FROM {pairs} pp JOIN qp a ON a.id = pp.q JOIN op b ON b.id = pp.o AND abs(b.mz - a.mz) <= 0.01),
cs AS (SELECT q, o, least(1.0, sum(i * bi)) AS cosine FROM mt WHERE r = 1 GROUP BY q, o)"""


def library_settings(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, energy): the stated energies of the training spectra in whole eV."""
    return energy_setting(energies_in_ev(load(spark, folder, "train"), load(spark, folder, "libraries"), load(spark, folder, "energy_units")))


def query_settings(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, energy) of the test spectra, row_id being their spectrum_id; a bare number is in eV."""
    t = load(spark, folder, "test", F.col("spectrum_id").alias("row_id"), "collision_energy_orig", "precursor_mz", F.lit("test").alias("ingest_lib"))
    bare = spark.createDataFrame([("test", "ev")], "ingest_lib string, bare_energy_unit string")
    return energy_setting(energies_in_ev(t, bare, load(spark, folder, "energy_units")))


def library_spectra(spark: SparkSession, folder: str) -> DataFrame:
    t = train_spectra(spark, folder).where("p is not null").join(library_settings(spark, folder), "row_id", "left")
    return t.select(F.concat(F.lit("t"), F.col("row_id").cast("string")).alias("o"), "key", F.col("adduct").alias("o_adduct"), F.col("mode").alias("o_mode"), F.col("precursor_mz").alias("o_mz"), F.coalesce("energy", F.lit("unknown")).alias("o_energy"), S.unit_peaks(F.col("p"), F.col("precursor_mz")).alias("o_p"))


def query_spectra(spark: SparkSession, folder: str) -> DataFrame:
    t = test_spectra(spark, folder).where("p is not null").drop("energy").join(query_settings(spark, folder).withColumnRenamed("row_id", "spectrum_id"), "spectrum_id", "left")
    return t.select(F.col("spectrum_id").alias("q"), "molecule_id", "adduct", "mode", "precursor_mz", F.coalesce("energy", F.lit("unknown")).alias("energy"), S.unit_peaks(F.col("p"), F.col("precursor_mz")).alias("p"))


@registry.query(f"""
WITH {_SPECTRA_SQL}, pp AS (SELECT te.id AS q, sp.id AS o FROM te JOIN sp ON te.adduct = sp.adduct AND sp.precursor_mz >= te.precursor_mz - te.precursor_mz * (10.0 * 1e-6) AND sp.precursor_mz <= te.precursor_mz + te.precursor_mz * (10.0 * 1e-6)),
{_cosine_sql('pp', 'te', 'sp')}
SELECT pp.q AS spectrum_id, pp.o AS library_id, round(coalesce(cosine, 0), 6) AS cosine FROM pp LEFT JOIN cs USING (q, o)""")
def peak_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of every test spectrum with the training spectra of its adduct and precursor mass (10 ppm)."""
    unit = S.unit_peaks(F.col("p"), F.col("precursor_mz"))
    queries = test_spectra(spark, folder).where("p is not null").select(F.col("spectrum_id").alias("q"), "adduct", "precursor_mz", unit.alias("p"))
    library = train_spectra(spark, folder).where("p is not null").select(F.concat(F.lit("t"), F.col("row_id").cast("string")).alias("o"), F.col("adduct").alias("o_adduct"), F.col("precursor_mz").alias("o_mz"), unit.alias("o_p"))
    return peak_cosines(queries, library).select(F.col("q").alias("spectrum_id"), F.col("o").alias("library_id"), "cosine")


def _search(spark: SparkSession, folder: str, rule: str) -> DataFrame:
    """Candidates in the mass window, their spectra by the fallback rule, mean over query spectra of the best cosine, top 25: pairs stay inside a group of near masses."""
    queries = cut(query_spectra(spark, folder).where(F.col("adduct").isin(*ADDUCTS)))
    masses = queries.groupBy("molecule_id").agg(F.avg(neutral(F.col("precursor_mz"), F.col("adduct"))).alias("m"))
    found = structures(spark, folder).where("key is not null").groupBy("key").agg(F.min("mass").alias("mass"))
    spectra = library_spectra(spark, folder).where("key is not null")
    keys = load(spark, folder, "train", clean_key(F.col("inchikey14")).alias("key")).where("key is not null")
    best = search_library(masses, queries, found, spectra, keys, {"polarity": "mode", "adduct": "adduct"}[rule])
    return best.select("molecule_id", "key", F.round("score", 6).alias("score"), "rank")


def _search_sql(rule: str) -> str:
    same = {"polarity": "x.mode = s.mode", "adduct": "x.adduct = s.adduct"}[rule]
    return f"""
WITH {_SPECTRA_SQL}, qq AS (SELECT te.*, {NEUTRAL} AS nm FROM te JOIN {ADDUCT_VALUES} ON adduct = name), ms AS (SELECT molecule_id, avg(nm) AS m, count(*) AS n FROM qq GROUP BY molecule_id),
st AS (SELECT inchikey14 AS key, min(exact_mass) AS mass FROM molecules WHERE inchikey14 IS NOT NULL GROUP BY 1),
wd AS (SELECT molecule_id, key, abs(mass - m) / m * 1e6 AS err, n FROM ms JOIN st ON mass >= m - m * (10.0 * 1e-6) AND mass <= m + m * (10.0 * 1e-6)),
al AS (SELECT x.id AS q, s.id AS o, x.molecule_id, s.key, coalesce(x.adduct = s.adduct AND x.energy = s.energy, false) AS exact FROM wd JOIN qq x USING (molecule_id) JOIN sp s ON s.key = wd.key WHERE (x.adduct = s.adduct AND x.energy = s.energy) OR {same}),
pp AS (SELECT q, o, molecule_id, key FROM (SELECT *, max(exact) OVER (PARTITION BY q, key) AS any_exact FROM al) WHERE exact = any_exact),
{_cosine_sql('pp', 'te', 'sp')},
bs AS (SELECT pp.molecule_id, pp.q, pp.key, greatest(max(coalesce(cosine, 0)), 0) AS b FROM pp LEFT JOIN cs USING (q, o) GROUP BY ALL),
sc AS (SELECT molecule_id, key, sum(b) / any_value(n) AS score, any_value(err) AS err FROM bs JOIN wd USING (molecule_id, key) GROUP BY molecule_id, key)
SELECT molecule_id, key, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY molecule_id ORDER BY round(score, 9) DESC, err, key) AS rank FROM sc) WHERE rank <= 25"""


@registry.query(_search_sql("polarity"))
def library_search_polarity_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return _search(spark, folder, "polarity")


@registry.query(_search_sql("adduct"))
def library_search_adduct_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return _search(spark, folder, "adduct")


@registry.query(f"""
WITH {_PAIRS}, {_SPECTRA_SQL}, pp AS (SELECT 't' || a AS q, 't' || b AS o, a, b, {_DOT} AS dot FROM pv), {_cosine_sql('pp', 'sp', 'sp')}
SELECT a, b, round(0.5 * (coalesce(cosine, 0) + greatest(dot, 0.0)), 6) AS hybrid FROM pp LEFT JOIN cs USING (q, o)""")
def hybrid_score(spark: SparkSession, folder: str) -> DataFrame:
    """The mean of peak cosine and embedding cosine."""
    lib = library_spectra(spark, folder)
    pick = lambda s: lib.select(F.col("o").alias("i" + s), F.col("o_p").alias("p" + s))
    tag = lambda c: F.concat(F.lit("t"), F.col(c).cast("string"))
    pairs = pair_vectors(spark, folder).withColumns({"ia": tag("a"), "ib": tag("b")}).join(pick("a"), "ia", "left").join(pick("b"), "ib", "left")
    return pairs.select("a", "b", F.round(0.5 * (S.peak_cosine(F.col("pa"), F.col("pb")) + V.cosine_of_units(F.col("ua"), F.col("ub"))), 6).alias("hybrid"))


@registry.query("""
WITH p AS (SELECT molecule_id, spectrum_id, unnest(ms2_mzs) AS mz, unnest(ms2_normalized_intensities) AS i FROM test),
c AS (SELECT a.spectrum_id, a.mz, a.i, max((b.spectrum_id IS NOT NULL)::INT) AS hit FROM p a LEFT JOIN p b ON a.molecule_id = b.molecule_id AND a.spectrum_id <> b.spectrum_id AND abs(a.mz - b.mz) < 0.01 GROUP BY 1, 2, 3)
SELECT spectrum_id, round(sum(hit * i) / sum(i), 6) AS shared FROM c GROUP BY 1""")
def shared_intensity(spark: SparkSession, folder: str) -> DataFrame:
    """The share of a spectrum's intensity that other spectra of its molecule have peaks for: join on buckets of m/z."""
    p = test_spectra(spark, folder).select("molecule_id", "spectrum_id", F.inline("p"))
    cell = F.floor(F.col("mz") / 0.01)
    left = p.groupBy("molecule_id", "spectrum_id", "mz", "i").count().drop("count").withColumn("c", F.explode(F.array(cell - 1, cell, cell + 1)))
    right = p.select("molecule_id", F.col("spectrum_id").alias("other"), F.col("mz").alias("omz"), cell.alias("c")).distinct()
    hits = left.join(right, ["molecule_id", "c"], "left").groupBy("spectrum_id", "mz", "i").agg(F.max(F.coalesce(((F.col("other") != F.col("spectrum_id")) & (F.abs(F.col("mz") - F.col("omz")) < 0.01)).cast("int"), F.lit(0))).alias("hit"))
    return hits.groupBy("spectrum_id").agg(F.round(F.sum(F.col("hit") * F.col("i")) / F.sum("i"), 6).alias("shared"))


# --- embedding space -------------------------------------------------------------------------------------------------

_GROUPED = f"CASE WHEN mode_a IS DISTINCT FROM mode_b THEN 'other mode' WHEN adduct_a IS DISTINCT FROM adduct_b THEN 'other adduct' ELSE 'same adduct' END"


def pair_angles(spark: SparkSession, folder: str) -> DataFrame:
    group = F.when(~F.col("mode_a").eqNullSafe(F.col("mode_b")), "other mode").when(~F.col("adduct_a").eqNullSafe(F.col("adduct_b")), "other adduct").otherwise("same adduct")
    return pair_vectors(spark, folder).select("key", "a", "b", "adduct_a", "adduct_b", group.alias("relation"), V.dot(F.col("ua"), F.col("ub")).alias("dot"), V.angular(V.dot(F.col("ua"), F.col("ub"))).alias("angle"))


_ANGLES = f"ag AS (SELECT key, a, b, adduct_a, adduct_b, {_GROUPED} AS relation, {_DOT} AS dot, {_ANGLE} AS angle FROM pv)"


@registry.query(f"WITH {_PAIRS}, {_ANGLES} SELECT relation, count(*) AS n, round(quantile_cont(angle, 0.25), 6) AS q1, round(median(angle), 6) AS mid, round(quantile_cont(angle, 0.75), 6) AS q3 FROM ag GROUP BY relation")
def pair_angles_by_group(spark: SparkSession, folder: str) -> DataFrame:
    found = stats.quantiles(pair_angles(spark, folder), "angle", {"q1": 0.25, "mid": 0.5, "q3": 0.75}, "relation")
    return found.select("relation", "n", *[F.round(c, 6).alias(c) for c in ("q1", "mid", "q3")])


@registry.query(f"WITH {_PAIRS}, {_ANGLES} SELECT least(adduct_a, adduct_b) AS first, greatest(adduct_a, adduct_b) AS second, count(*) AS n, CASE WHEN count(*) >= 50 THEN round(median(angle), 6) END AS mid FROM ag WHERE adduct_a IS NOT NULL AND adduct_b IS NOT NULL GROUP BY 1, 2")
def adduct_pair_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Median angle per unordered pair of adducts; cells of under 50 pairs stay empty."""
    known = pair_angles(spark, folder).where("adduct_a is not null and adduct_b is not null")
    cells = known.select(F.least("adduct_a", "adduct_b").alias("first"), F.greatest("adduct_a", "adduct_b").alias("second"), "angle")
    return stats.quantiles(cells, "angle", {"mid": 0.5}, "first", "second").withColumn("mid", F.when(F.col("n") >= 50, F.round("mid", 6)))


@registry.query(f"WITH {_PAIRS}, {_ANGLES} SELECT relation, least(floor(angle / 0.05)::BIGINT, 19) AS bin, count(*) AS n FROM ag WHERE angle >= 0 AND angle < 1 GROUP BY 1, 2")
def histogram_angles(spark: SparkSession, folder: str) -> DataFrame:
    return stats.histogram(pair_angles(spark, folder), F.col("angle"), 0.0, 1.0, 20, "relation")


def _random_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every row with the next one in hash order, where that is of another molecule: as many pairs as rows."""
    k = keyed_embeddings(spark, folder).where("key is not null").select("row_id", "key", "mode", "u")
    order = with_position(k.select("row_id", "key", "mode", hash_order(0, F.col("row_id")).alias("h")), "h", "row_id")
    after = order.select(F.col("row_id").alias("b"), F.col("key").alias("key_b"), F.col("mode").alias("mode_b"), (F.col("position") - 1).alias("position"))
    ids = order.select(F.col("row_id").alias("a"), "key", "mode", "position").join(after, "position").where("key <> key_b")
    vector = lambda s: k.select(F.col("row_id").alias(s), F.col("u").alias("u" + s))
    return ids.join(vector("a"), "a").join(vector("b"), "b").select("a", "b", F.col("mode").eqNullSafe(F.col("mode_b")).alias("same_mode"), V.dot(F.col("ua"), F.col("ub")).alias("dot"))


_RANDOM = """rp AS (SELECT a, b, mode IS NOT DISTINCT FROM mode_b AS same_mode, list_dot_product(u, ub) AS dot FROM (SELECT row_id AS a, key, mode, u, lead(row_id) OVER w AS b, lead(key) OVER w AS key_b, lead(mode) OVER w AS mode_b, lead(u) OVER w AS ub FROM ke WHERE key IS NOT NULL
 WINDOW w AS (ORDER BY md5('0|' || row_id), row_id)) WHERE b IS NOT NULL AND key <> key_b)"""


@registry.query(f"""WITH {_KEYED}, {_RANDOM}, g AS (SELECT 'all' AS pairs, dot FROM rp UNION ALL SELECT 'same mode', dot FROM rp WHERE same_mode)
SELECT pairs, count(*) AS n, round(avg(acos(least(greatest(dot, -1.0), 1.0)) / pi()), 6) AS mean_angle, round(median(acos(least(greatest(dot, -1.0), 1.0)) / pi()), 6) AS mid FROM g GROUP BY pairs""")
def random_pair_angles(spark: SparkSession, folder: str) -> DataFrame:
    """Angles of pairs of different molecules: of all, and of those of one ionisation mode."""
    pairs = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("same_mode"), "same mode")))).alias("pairs")
    a = _random_pairs(spark, folder).select(pairs, V.angular(F.col("dot")).alias("angle"))
    mean = a.groupBy("pairs").agg(F.round(F.avg("angle"), 6).alias("mean_angle"))
    return stats.quantiles(a, "angle", {"mid": 0.5}, "pairs").withColumn("mid", F.round("mid", 6)).join(mean, "pairs")


@registry.query(f"""
WITH {_PAIRS}, {_RANDOM}, x AS (SELECT round({_DOT}, 6) AS s, 1 AS y FROM pv UNION ALL SELECT round(dot, 6), 0 FROM rp),
r AS (SELECT s, y, (min(k) OVER (PARTITION BY s) + max(k) OVER (PARTITION BY s)) / 2.0 AS rk FROM (SELECT s, y, row_number() OVER (ORDER BY s) AS k FROM x))
SELECT round((sum(rk * y) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * sum(1 - y)), 6) AS auc, sum(y)::BIGINT AS n_positive, sum(1 - y)::BIGINT AS n_negative FROM r""")
def same_molecule_auc(spark: SparkSession, folder: str) -> DataFrame:
    """How well the cosine parts pairs of one molecule from pairs of two."""
    same = pair_vectors(spark, folder).select(F.round(V.dot(F.col("ua"), F.col("ub")), 6).alias("s"), F.lit(True).alias("y"))
    other = _random_pairs(spark, folder).select(F.round("dot", 6).alias("s"), F.lit(False).alias("y"))
    return stats.roc_auc(same.unionByName(other), "s", F.col("y")).select(F.round("auc", 6).alias("auc"), "n_positive", "n_negative")


@registry.query(f"""
WITH {_PAIRS}, x AS (SELECT round({_DOT}, 6) AS s, abs(x.precursor_mz - y.precursor_mz) AS d FROM pv JOIN ke x ON a = x.row_id JOIN ke y ON b = y.row_id),
r AS (SELECT (rank() OVER (ORDER BY s) + count(*) OVER (PARTITION BY s) / 2.0) AS a, (rank() OVER (ORDER BY d) + count(*) OVER (PARTITION BY d) / 2.0) AS b FROM x)
SELECT round(corr(a, b), 6) AS spearman, count(*) AS n FROM r""")
def spearman_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation of the cosine with the difference of precursor masses."""
    mz = keyed_embeddings(spark, folder)
    pick = lambda s: mz.select(F.col("row_id").alias(s), F.col("precursor_mz").alias("mz" + s))
    both = pair_vectors(spark, folder).join(pick("a"), "a").join(pick("b"), "b").select(F.round(V.dot(F.col("ua"), F.col("ub")), 6).alias("s"), F.abs(F.col("mza") - F.col("mzb")).alias("d"))
    return stats.spearman(both, "s", "d").select(F.round("spearman", 6).alias("spearman"), "n")


@registry.query(f"""
WITH {_PAIRS}, b AS (SELECT key, count(*) AS n, avg({_DOT}) AS s FROM pv GROUP BY key), z AS (SELECT key, count(*) AS size FROM ke WHERE key IS NOT NULL GROUP BY key)
SELECT CASE WHEN size = 1 THEN '1' WHEN size < 5 THEN '2-4' WHEN size < 20 THEN '5-19' ELSE '20+' END AS size_class, count(*) AS molecules, round(avg(s), 6) AS mean_cosine FROM z LEFT JOIN b USING (key) GROUP BY 1""")
def similarity_by_group_size(spark: SparkSession, folder: str) -> DataFrame:
    per = pair_vectors(spark, folder).groupBy("key").agg(F.avg(V.dot(F.col("ua"), F.col("ub"))).alias("s"))
    sizes = keyed_embeddings(spark, folder).where("key is not null").groupBy("key").agg(F.count("*").alias("size"))
    label = F.when(F.col("size") == 1, "1").when(F.col("size") < 5, "2-4").when(F.col("size") < 20, "5-19").otherwise("20+")
    return sizes.join(per, "key", "left").groupBy(label.alias("size_class")).agg(F.count("*").alias("molecules"), F.round(F.avg("s"), 6).alias("mean_cosine"))


@registry.query(f"""
WITH {_KEYED}, mu AS (SELECT d, avg(u[d]) AS m FROM ke, range(1, 129) r(d) GROUP BY d), n AS (SELECT count(*) AS n FROM ke)
SELECT round(sum((u[d] - m) * (u[d] - m)) / (any_value(n) - 1), 6) AS total_variance, any_value(n) AS n FROM ke, mu, n""")
def covariance_trace(spark: SparkSession, folder: str) -> DataFrame:
    _, cov, n = stats.covariance(keyed_embeddings(spark, folder), "u")
    return spark.createDataFrame([(round(float(cov.trace()), 6), n)], "total_variance double, n bigint")


@registry.query()
def pca_explained_variance(spark: SparkSession, folder: str) -> DataFrame:
    """Explained variance of the first 32 components and its running share."""
    _, _, values, total = stats.principal_components(keyed_embeddings(spark, folder), "u", 32)
    rows = [(i, round(float(v), 6), round(float(values[: i + 1].sum() / total), 6)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "component int, variance double, running_share double")


@registry.query()
def pca_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors on 16 components, scaled so that the mean square is 1; a spectrum without a vector gets zeros."""
    known = keyed_embeddings(spark, folder)
    mean, components, values, _ = stats.principal_components(known, "u", 16)
    scale = 1 / math.sqrt(max(1e-12, float(values.mean()))) if len(values) else 1.0
    rows = load(spark, folder, "train", "row_id").join(known.select("row_id", "u"), "row_id", "left")
    out = stats.project(rows, "u", mean, components, "y", scale)
    return out.select("row_id", F.col("u").isNotNull().alias("has_embedding"), F.round(F.sqrt(F.aggregate("y", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("length"))

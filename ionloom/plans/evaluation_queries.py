"""Evaluation end to end: ranking with every scorer, search scenarios, exact neighbours, isomers, splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionloom.functions import metadata as M
from ionloom.functions import spectra as S
from ionloom.functions import structures as X
from ionloom.functions import vectors as V
from ionloom.functions.keys import clean_key, clean_name
from ionloom.operators import ranking as R
from ionloom.operators import sampling as P
from ionloom.operators import stats
from ionloom.operators.dedupe import keep_first, lookup_or_fail
from ionloom.operators.ppm import adaptive_window, with_position
from ionloom.operators.search import best_relatives, nearest_exact, neighbour_recall
from ionloom.operators.skew import salted_join
from ionloom.operators.windows import rank_known
from ionloom.plans.common import ADDUCT_VALUES, CLEAN_KEY, EMBEDDINGS, NEUTRAL, embeddings, structures, train_spectra
from ionloom.plans.library_queries import _BEST, _TRUTH, ranked_candidates, true_keys
from ionloom.plans.problems import energy_cte
from ionloom.plans.registry import Registry
from ionloom.plans.similarity_queries import _KEYED, _UNIT_PEAKS, ENERGY_SETTING, _cosine_sql, constant_bits_baseline, keyed_embeddings, library_settings
from ionloom.plans.similarity_queries import registry as similarity
from ionloom.session import cut
from ionloom.tables import load

registry = Registry()

# --- ranking with every scorer ---------------------------------------------------------------------------------------

_HALVES = f"""{_KEYED},
half AS (SELECT *, ('0x' || md5('0|' || row_id)[1:1])::INT % 2 AS h FROM ke WHERE key IS NOT NULL),
lb AS (SELECT key, d, (avg(u[d]) > 0)::INT::DOUBLE AS bit FROM half, range(1, 129) r(d) WHERE h = 0 GROUP BY key, d),
ms AS (SELECT inchikey14 AS key, min(exact_mass) AS mass FROM molecules WHERE inchikey14 IS NOT NULL AND exact_mass IS NOT NULL GROUP BY 1),
lib AS (SELECT key, any_value(mass) AS mass, list(bit ORDER BY d) AS bits FROM lb JOIN ms USING (key) GROUP BY key),
qs AS (SELECT half.*, (precursor_mz - shift) / n_mol AS nm FROM half JOIN {ADDUCT_VALUES} ON adduct = name WHERE h = 1),
qv AS (SELECT key, d, avg({{p}}) AS p FROM qs, range(1, 129) r(d) GROUP BY key, d),
q AS (SELECT key AS query, n_spectra, mass_q, p FROM (SELECT key, list(p ORDER BY d) AS p FROM qv GROUP BY key) JOIN (SELECT key, count(*) AS n_spectra, avg(nm) AS mass_q FROM qs GROUP BY key) USING (key)),
pr AS (SELECT query, key, p, bits FROM q JOIN lib ON mass >= mass_q - mass_q * (10.0 * 1e-6) AND mass <= mass_q + mass_q * (10.0 * 1e-6)),
sc AS ({{scores}}),
rk AS (SELECT query, key, scorer, row_number() OVER (PARTITION BY query, scorer ORDER BY score DESC, key) AS rank FROM sc),
fr AS (SELECT query, {{ranks}}, count(*) FILTER (scorer = '{{first}}') AS n_candidates FROM rk GROUP BY query)
SELECT query, n_spectra, round(mass_q, 5) AS neutral_mass, {{names}}, coalesce(n_candidates, 0) AS n_candidates FROM q LEFT JOIN fr USING (query)"""
_CLIP = "greatest(least(x, 1 - 1e-6), 1e-6)"
_SCORE_SQL = {
    "likelihood": f"list_dot_product(bits, list_transform(p, lambda x: ln({_CLIP}) - ln(1 - {_CLIP})))",
    "tanimoto": "list_dot_product(p, bits) / (list_sum(p) + list_sum(bits) - list_dot_product(p, bits))",
    "dot": "list_dot_product(p, bits)",
    "dot_over_root": "list_dot_product(p, bits) / sqrt(greatest(list_sum(bits), 1.0))",
}


def _ranks_sql(p: str, scorers: tuple[str, ...]) -> str:
    scores = " UNION ALL ".join(f"SELECT query, key, '{s}' AS scorer, round({_SCORE_SQL[s]}, 9) AS score FROM pr" for s in scorers)
    ranks = ", ".join(f"min(rank) FILTER (scorer = '{s}' AND key = query) AS rank_{s}" for s in scorers)
    text = "WITH " + _HALVES
    for name, value in {"p": p, "scores": scores, "ranks": ranks, "first": scorers[0], "names": ", ".join(f"rank_{s}" for s in scorers)}.items():
        text = text.replace("{" + name + "}", value)
    return text


def _ranked(spark: SparkSession, folder: str, value, scorers: tuple[str, ...]) -> DataFrame:
    """Spectra of one half of the hash are the queries, a molecule's together; the bits of a structure are the signs of the other half's mean vector."""
    e = keep_first(load(spark, folder, "spectrum_embeddings").where("embedding is not null").select("row_id", F.col("embedding").alias("e")), ["row_id"], "e")
    # keys are cleaned behind the join, on the rows that have a vector
    t = load(spark, folder, "train", "row_id", "inchikey14", "adduct", "precursor_mz")
    half = F.conv(F.substring(P.hash_order(0, F.col("row_id")), 1, 1), 16, 10).cast("int") % 2
    # the mass is averaged with the vector, over the spectra that have one
    m = M.neutral_mass(F.col("precursor_mz"), F.col("adduct"))
    k = e.join(t, "row_id").select(clean_key(F.col("inchikey14")).alias("key"), F.when(half == 0, 0).when(F.col("adduct").isin(*M.ADDUCTS), 1).alias("h"), m.alias("m"), "e")
    masses = structures(spark, folder).where("key is not null and mass is not null").groupBy("key").agg(F.min("mass").alias("mass"))
    known = cut(stats.bits_and_means(k, value).join(masses, "key", "left"))
    there = F.col("bits").isNotNull()
    asked = known.where("p is not null").select(F.col("key").alias("query"), F.col("key").alias("true_key"), F.when(there, F.col("mass")).alias("true_mass"), F.col("bits").alias("true_bits"), F.col("m").alias("mass_q"), "p")
    ranks = rank_known(asked, known.where(there & F.col("mass").isNotNull()).select("key", "mass", "bits"), scorers)
    mass = F.round(F.col("m") * 1e5) / 1e5  # halves as the SQL rounds them, by the product
    queries = known.where("p is not null").select(F.col("key").alias("query"), F.col("n").alias("n_spectra"), mass.alias("neutral_mass"))
    return queries.join(ranks, "query", "left").select("query", "n_spectra", "neutral_mass", *[f"rank_{s}" for s in scorers], F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


@registry.query(_ranks_sql("1.0 / (1.0 + exp(-8.0 * u[d]))", tuple(V.SCORERS)))
def rank_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Mean probabilities of each query molecule, the library in its mass window, the rank of the truth by every scorer."""
    return _ranked(spark, folder, lambda u: 1.0 / (1.0 + np.exp(-8.0 * u)), tuple(V.SCORERS))


@registry.query(_ranks_sql("8.0 * u[d]", ("dot", "dot_over_root")))
def rank_by_logits(spark: SparkSession, folder: str) -> DataFrame:
    """The same by another model's logits: they may be negative, so only the linear scorers apply."""
    return _ranked(spark, folder, lambda u: 8.0 * u, ("dot", "dot_over_root"))


@registry.query(f"""
WITH {_BEST}, {_TRUTH}, o AS (SELECT b.molecule_id, b.score, b.key = true_key AS is_truth, row_number() OVER (PARTITION BY b.molecule_id, b.key = true_key ORDER BY md5('0|' || b.key), b.key) AS slot FROM b JOIN truth USING (molecule_id)),
sl AS (SELECT * FROM o WHERE is_truth OR slot <= 32), t AS (SELECT molecule_id, max(CASE WHEN is_truth THEN score END) AS t, max(score) AS m, count(*) FILTER (NOT is_truth) AS d FROM sl GROUP BY 1),
r AS (SELECT molecule_id, t, m, d, 1 + count(*) FILTER (NOT is_truth AND score > t) AS r, sum(exp(score - m)) AS e FROM sl JOIN t USING (molecule_id) WHERE t IS NOT NULL GROUP BY ALL)
SELECT count(*) AS queries, round(avg(CASE WHEN d > 0 THEN m + ln(e) - t END), 6) AS ranking_loss, round(avg((r = 1)::INT), 6) AS top1, round(avg(1.0 / r), 6) AS mrr FROM r""")
def in_batch_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The truth against 32 decoys a query, drawn by hash; a query with fewer has empty slots."""
    best = ranked_candidates(spark, folder).select("molecule_id", "key", "score").join(true_keys(spark, folder), "molecule_id").withColumn("is_truth", F.col("key") == F.col("true_key"))
    slot = Window.partitionBy("molecule_id", "is_truth").orderBy(P.hash_order(0, F.col("key")), "key")
    slots = best.withColumn("slot", F.row_number().over(slot)).where(F.col("is_truth") | (F.col("slot") <= 32))
    out = R.in_batch_metrics(slots, "molecule_id", "score", F.col("is_truth"))
    return out.select("queries", *[F.round(c, 6).alias(c) for c in ("ranking_loss", "top1", "mrr")])


# --- search scenarios ------------------------------------------------------------------------------------------------

#: The library that test molecules come from, and the split: molecules, spectra of each, spectra a molecule must have.
TEST_LIBRARY, N_TEST, PER_QUERY, LEAST_SPECTRA = "ursa-tims", 200, 3, 4
_STRICT = ", ".join(f"'{a}'" for a in M.STRICT_ADDUCTS)
_SPLIT_SQL = f"""
{energy_cte('l')}, les AS {ENERGY_SETTING.format(p='l')},
sp0 AS (SELECT row_id, {CLEAN_KEY} AS key, replace(lower(trim(ingest_lib)), '_', '-') AS lib, adduct, ionization_mode AS mode, precursor_mz, coalesce(energy, 'unknown') AS energy, coalesce({_UNIT_PEAKS}, []) AS p FROM train LEFT JOIN les USING (row_id) WHERE adduct IN ({_STRICT})),
sp AS (SELECT row_id, row_id AS id, key, lib, adduct, mode, precursor_mz, energy, CASE WHEN n > 0 THEN list_transform(p, lambda x: {{'mz': x.mz, 'i': x.i / n}}) ELSE p END AS p FROM (SELECT *, sqrt(coalesce(list_sum(list_transform(p, lambda x: x.i * x.i)), 0)) AS n FROM sp0)),
st AS (SELECT inchikey14 AS key, min(exact_mass) AS mass FROM molecules WHERE inchikey14 IS NOT NULL AND exact_mass IS NOT NULL GROUP BY 1),
tk AS (SELECT key FROM sp JOIN st USING (key) WHERE lib = '{TEST_LIBRARY}' GROUP BY key HAVING count(*) >= {LEAST_SPECTRA} ORDER BY md5('0|' || key), key LIMIT {N_TEST}),
qr AS (SELECT * FROM (SELECT sp.*, row_number() OVER (PARTITION BY key ORDER BY md5('0|' || row_id), row_id) AS r FROM sp JOIN tk USING (key) WHERE lib = '{TEST_LIBRARY}') WHERE r <= {PER_QUERY})"""


def _split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spectra with a usable adduct, structures (key, mass), and the query spectra of the test molecules."""
    spectra = train_spectra(spark, folder).where(F.col("adduct").isin(*M.STRICT_ADDUCTS)).join(library_settings(spark, folder), "row_id", "left").join(load(spark, folder, "train", "row_id", clean_name(F.col("ingest_lib")).alias("lib")), "row_id")
    peaks = F.coalesce(S.unit_peaks(F.col("p"), F.col("precursor_mz")), F.array().cast("array<struct<mz:double,i:double>>"))
    spectra = spectra.select("row_id", "key", "lib", "adduct", "mode", "precursor_mz", F.coalesce("energy", F.lit("unknown")).alias("energy"), peaks.alias("p"))
    found = structures(spark, folder).where("key is not null and mass is not null").groupBy("key").agg(F.min("mass").alias("mass"))
    ours = spectra.where((F.col("lib") == TEST_LIBRARY) & F.col("key").isNotNull())
    eligible = ours.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SPECTRA).join(found.select("key"), "key", "left_semi")
    keys = F.broadcast(eligible.orderBy(P.hash_order(0, F.col("key")), "key").limit(N_TEST).select("key"))  # N_TEST rows
    return spectra, found, P.n_per_group(ours.join(keys, "key"), ["key"], "row_id", PER_QUERY)


@registry.query(f"WITH {_SPLIT_SQL} SELECT key, row_id FROM qr")
def test_query_split(spark: SparkSession, folder: str) -> DataFrame:
    """The spectra that are the queries: of N_TEST molecules of one library with enough spectra and a structure."""
    return _split(spark, folder)[2].select("key", "row_id")


_WIDE = "mass >= m - m * ({w} * 1e-6) AND mass <= m + m * ({w} * 1e-6)"


@registry.query(f"""
WITH {EMBEDDINGS}, {_SPLIT_SQL}, rules AS (SELECT unnest(['polarity fallback', 'adduct fallback']) AS rule),
qm AS (SELECT key AS mk, avg(precursor_mz - shift) AS m, count(*) AS n FROM qr JOIN {ADDUCT_VALUES} ON adduct = name GROUP BY key),
w0 AS (SELECT mk, m, n, key, mass FROM qm JOIN st ON {_WIDE.format(w='80.0')}),
wn AS (SELECT mk, CASE WHEN count(*) FILTER ({_WIDE.format(w='10.0')}) >= 25 THEN 10.0 WHEN count(*) FILTER ({_WIDE.format(w='20.0')}) >= 25 THEN 20.0 WHEN count(*) FILTER ({_WIDE.format(w='40.0')}) >= 25 THEN 40.0 ELSE 80.0 END AS w FROM w0 GROUP BY mk),
wd AS (SELECT mk, key, n, abs(mass - m) / m * 1e6 AS err FROM w0 JOIN wn USING (mk) WHERE {_WIDE.format(w='w')}),
lb AS (SELECT * FROM sp WHERE key IS NOT NULL AND row_id NOT IN (SELECT row_id FROM qr)),
al AS (SELECT rule, x.row_id AS q, s.row_id AS o, wd.mk, wd.key, coalesce(x.adduct = s.adduct AND x.energy = s.energy, false) AS exact FROM wd JOIN qr x ON x.key = wd.mk JOIN lb s ON s.key = wd.key, rules
 WHERE (x.adduct = s.adduct AND x.energy = s.energy) OR (rule = 'polarity fallback' AND x.mode = s.mode) OR (rule = 'adduct fallback' AND x.adduct = s.adduct)),
kp AS (SELECT * FROM (SELECT *, max(exact) OVER (PARTITION BY rule, q, key) AS any_exact FROM al) WHERE exact = any_exact),
pp AS (SELECT DISTINCT q, o FROM kp), {_cosine_sql('pp', 'qr', 'lb')},
un AS (SELECT row_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM emb),
mu AS (SELECT list(x ORDER BY d) AS c FROM (SELECT d, avg(u[d]) AS x FROM (SELECT u FROM lb JOIN un USING (row_id) WHERE key IN (SELECT key FROM wd)), range(1, 129) r(d) GROUP BY d)),
ce AS (SELECT row_id, u, list_transform(list_zip(u, c), lambda z: z[1] - z[2]) AS v FROM un, mu),
es AS (SELECT q, o, coalesce(cosine, 0) AS cosine, coalesce(greatest(list_dot_product(a.u, b.u), 0.0), 0.0) AS embedding, coalesce(greatest(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 0.0), 0.0) AS centred
 FROM pp LEFT JOIN cs USING (q, o) LEFT JOIN ce a ON a.row_id = q LEFT JOIN ce b ON b.row_id = o),
sl AS (SELECT q, o, unnest(['cosine', 'embedding', 'embedding centred', 'cosine + embedding']) AS scorer, unnest([cosine, embedding, centred, 0.5 * (cosine + embedding)]) AS s FROM es),
bs AS (SELECT rule, scorer, mk, q, key, greatest(max(s), 0.0) AS b FROM kp JOIN sl USING (q, o) GROUP BY ALL),
ss AS (SELECT rule, scorer, mk, key, sum(b) AS s FROM bs GROUP BY ALL),
gr AS (SELECT DISTINCT scenario, rule, scorer FROM (SELECT unnest(['known', 'novel']) AS scenario), rules, (SELECT unnest(['cosine', 'embedding', 'embedding centred', 'cosine + embedding']) AS scorer)),
fu AS (SELECT scenario, gr.rule, gr.scorer, wd.mk, wd.key, err, CASE WHEN scenario = 'novel' AND wd.key IN (SELECT key FROM tk) THEN 0.0 ELSE coalesce(s / n, 0.0) END AS score FROM wd CROSS JOIN gr LEFT JOIN ss ON ss.rule = gr.rule AND ss.scorer = gr.scorer AND ss.mk = wd.mk AND ss.key = wd.key),
rk AS (SELECT scenario, rule, scorer, mk, key, row_number() OVER (PARTITION BY scenario, rule, scorer, mk ORDER BY round(score, 9) DESC, err, key) AS rank FROM fu),
tr AS (SELECT scenario, rule, scorer, qm.mk, min(rank) FILTER (key = rk.mk AND rank <= 25) AS rank FROM gr CROSS JOIN qm LEFT JOIN rk USING (scenario, rule, scorer, mk) GROUP BY ALL)
SELECT scenario, rule AS comparison, scorer, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr25, round(avg(coalesce(rank = 1, false)::INT), 6) AS top1, round(avg(coalesce(rank <= 5, false)::INT), 6) AS top5, round(avg((rank IS NOT NULL)::INT), 6) AS top25, count(*) AS n_test, 0 AS seed FROM tr GROUP BY scenario, rule, scorer""")
def scenario_table(spark: SparkSession, folder: str) -> DataFrame:
    """Known and novel molecules by two comparison rules and four scorers. A novel molecule keeps its structure and loses its spectra."""
    spectra, found, queries = _split(spark, folder)
    masses = queries.groupBy(F.col("key").alias("mk")).agg(F.avg(M.strict_neutral_mass(F.col("precursor_mz"), F.col("adduct"))).alias("m"), F.count("*").alias("n"))
    window = adaptive_window(masses, found, "mk", "m", "mass").select("mk", "key", "n", (F.abs(F.col("mass") - F.col("m")) / F.col("m") * 1e6).alias("err"))
    library = spectra.where("key is not null").join(F.broadcast(queries.select("row_id")), "row_id", "left_anti")  # N_TEST * PER_QUERY rows
    library = library.select(F.col("row_id").alias("o"), "key", F.col("adduct").alias("o_adduct"), F.col("mode").alias("o_mode"), F.col("energy").alias("o_energy"), F.col("p").alias("o_p"))
    asked = window.select("mk", "key").join(queries.select(F.col("key").alias("mk"), F.col("row_id").alias("q"), "adduct", "mode", "energy"), "mk")
    rules = {"polarity fallback": "mode", "adduct fallback": "adduct"}
    chosen = None
    for rule, same in rules.items():
        part = R.comparable_setups(asked, library, same).select(F.lit(rule).alias("comparison"), "mk", "q", "key", "setup")
        chosen = part if chosen is None else chosen.unionByName(part)
    # a pair that both rules compare is scored once
    wanted = chosen.groupBy("mk", "q", "key", "setup").agg(F.sort_array(F.collect_set("comparison")).alias("rules"))
    pairs = salted_join(library.select("o", R.setup_of().alias("setup"), "o_p"), wanted.join(queries.select(F.col("row_id").alias("q"), "p"), "q"), "setup")
    units = embeddings(spark, folder).select("row_id", V.unit(F.col("e")).alias("u"))
    near = library.join(window.select("key").distinct(), "key", "left_semi").select(F.col("o").alias("row_id")).join(units, "row_id")
    centre = [float(r["mean"]) for r in stats.mean_vector(near, "u").orderBy("dim").collect()] or [0.0] * 128  # one vector
    off = lambda u: V.unit(F.zip_with(u, F.array(*[F.lit(x) for x in centre]), lambda x, m: x - m))
    vector = lambda s: units.select(F.col("row_id").alias(s), F.col("u").alias("u" + s), off(F.col("u")).alias("v" + s))
    scored = pairs.select("rules", "mk", "q", "key", "o", S.peak_cosine(F.col("p"), F.col("o_p")).alias("c")).join(vector("q"), "q", "left").join(vector("o"), "o", "left")
    e, v = V.cosine_of_units(F.col("uq"), F.col("uo")), V.cosine_of_units(F.col("vq"), F.col("vo"))
    scored = scored.select("rules", "mk", "q", "key", "c", e.alias("e"), v.alias("v"))
    names = {"cosine": F.col("c"), "embedding": F.col("e"), "embedding centred": F.col("v"), "cosine + embedding": 0.5 * (F.col("c") + F.col("e"))}
    best = scored.groupBy("rules", "mk", "q", "key").agg(*[F.max(s).alias(f"s{i}") for i, s in enumerate(names.values())])
    long = best.select(F.explode("rules").alias("comparison"), "mk", "q", "key", F.explode(F.array(*[F.struct(F.lit(n).alias("scorer"), F.col(f"s{i}").alias("s")) for i, n in enumerate(names)])).alias("x")).select("comparison", "mk", "q", "key", "x.*")
    sums = long.groupBy("comparison", "scorer", "mk", "q", "key").agg(F.greatest(F.max("s"), F.lit(0.0)).alias("b")).groupBy("comparison", "scorer", "mk", "key").agg(F.sum("b").alias("s"))
    groups = F.explode(F.array(*[F.struct(F.lit(sc).alias("scenario"), F.lit(r).alias("comparison"), F.lit(n).alias("scorer")) for sc in ("known", "novel") for r in rules for n in names])).alias("g")
    full = window.select("mk", "key", "n", "err", groups).select("mk", "key", "n", "err", "g.*").join(sums, ["comparison", "scorer", "mk", "key"], "left")
    full = full.join(masses.select(F.col("mk").alias("key"), F.lit(True).alias("tested")), "key", "left")
    score = F.when((F.col("scenario") == "novel") & F.col("tested").isNotNull(), F.lit(0.0)).otherwise(F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)))
    ranked = full.withColumn("rank", F.row_number().over(Window.partitionBy("scenario", "comparison", "scorer", "mk").orderBy(F.desc(F.round(score, 9)), "err", "key")))
    truth = ranked.where((F.col("key") == F.col("mk")) & (F.col("rank") <= 25)).select("scenario", "comparison", "scorer", "mk", "rank")
    ranks = masses.select("mk", groups).select("mk", "g.*").join(truth, ["scenario", "comparison", "scorer", "mk"], "left")
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return ranks.groupBy("scenario", "comparison", "scorer").agg(F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr25"), rate(F.col("rank") == 1).alias("top1"), rate(F.col("rank") <= 5).alias("top5"), rate(F.col("rank").isNotNull()).alias("top25"), F.count("*").alias("n_test"), F.lit(0).alias("seed"))


# --- exact neighbours and isomers ------------------------------------------------------------------------------------

_K = 15
_KNN = """nb AS (SELECT id, neighbour, s FROM (SELECT a.row_id AS id, b.row_id AS neighbour, round(list_dot_product({a}, {b}), 9) AS s, row_number() OVER (PARTITION BY a.row_id ORDER BY round(list_dot_product({a}, {b}), 9) DESC, b.row_id) AS r
 FROM ke a JOIN ke b ON a.row_id <> b.row_id WHERE a.row_id % 100 = 0) WHERE r <= 15)"""


@registry.query(f"WITH {_KEYED}, {_KNN.format(a='a.u', b='b.u')} SELECT id AS row_id, neighbour, round(s, 6) AS cosine FROM nb")
def knn_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The 15 nearest spectra of every one whose id is divisible by 100, against all, exactly."""
    k = keyed_embeddings(spark, folder).select(F.col("row_id").alias("id"), "u")
    return nearest_exact(k.where("id % 100 = 0"), k, _K).select(F.col("id").alias("row_id"), "neighbour", F.round("sim", 6).alias("cosine"))


_HEAD = "list_transform(u[1:64], lambda x: x / sqrt(list_dot_product(u[1:64], u[1:64])))"


@registry.query(f"""
WITH {_KEYED}, {_KNN.format(a='a.u', b='b.u')}, hd AS (SELECT row_id, key, {_HEAD} AS v FROM ke), {_KNN.format(a='a.v', b='b.v').replace('nb AS', 'nh AS').replace('FROM ke a JOIN ke b', 'FROM hd a JOIN hd b')},
sh AS (SELECT nb.id, count(nh.neighbour) / 15.0 AS share FROM nb LEFT JOIN nh ON nb.id = nh.id AND nb.neighbour = nh.neighbour GROUP BY nb.id)
SELECT round(avg(share), 6) AS recall, count(*) AS queries FROM sh""")
def knn_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The share of the 15 true neighbours that stay after a projection: the first 64 numbers of the vector."""
    k = keyed_embeddings(spark, folder).select(F.col("row_id").alias("id"), "u")
    low = k.select("id", V.unit(F.slice("u", 1, 64)).alias("u")).where("u is not null")
    true, found = (nearest_exact(x.where("id % 100 = 0"), x, _K) for x in (k, low))
    return neighbour_recall(found, true, _K).select(F.round("recall", 6).alias("recall"), "queries")


_ISOMERS = f"""{_KEYED}, {energy_cte('l')}, les AS {ENERGY_SETTING.format(p='l')},
g AS (SELECT ke.row_id, key, u, energy AS setting, molecular_formula || '|' || ionization_mode AS grp FROM ke JOIN train USING (row_id) LEFT JOIN les ON les.row_id = ke.row_id WHERE key IS NOT NULL AND molecular_formula IS NOT NULL AND ionization_mode IS NOT NULL),
z AS (SELECT grp, count(DISTINCT key) AS molecules FROM g GROUP BY grp HAVING count(DISTINCT key) >= 2),
p AS (SELECT x.row_id, x.grp, list_dot_product(x.u, y.u) AS s, x.key = y.key AS own, x.key = y.key AND x.setting <> y.setting AS own_setting FROM g x JOIN z USING (grp) JOIN g y ON x.grp = y.grp AND x.row_id <> y.row_id),
b AS (SELECT row_id, grp, max(s) FILTER (own) AS own, max(s) FILTER (NOT own) AS other, count(*) FILTER (own) AS n_own, count(*) AS n, max(s) FILTER (own_setting) AS own_setting, count(*) FILTER (own_setting) AS n_setting FROM p GROUP BY row_id, grp),
c AS (SELECT b.*, molecules FROM b JOIN z USING (grp) WHERE own IS NOT NULL)"""


def _isomers(spark: SparkSession, folder: str) -> DataFrame:
    """best_relatives of the spectra of one formula and mode, where two molecules or more have them, with the number of molecules."""
    t = load(spark, folder, "train", "row_id", F.concat_ws("|", "molecular_formula", "ionization_mode").alias("group"), (F.col("molecular_formula").isNotNull() & F.col("ionization_mode").isNotNull()).alias("known")).where("known").drop("known")
    settings = library_settings(spark, folder).withColumnRenamed("energy", "setting")
    rows = keyed_embeddings(spark, folder).where("key is not null").select("row_id", "key", "u").join(t, "row_id").join(settings, "row_id", "left").withColumnRenamed("row_id", "id")
    several = rows.groupBy("group").agg(F.countDistinct("key").alias("molecules")).where("molecules >= 2")
    kept = rows.join(several.select("group"), "group", "left_semi")
    return best_relatives(kept).where("own is not null").join(rows.select("id", "group"), "id").join(several, "group")


@registry.query(f"""
WITH {_ISOMERS} SELECT 'any setting' AS own, count(*) AS n, round(avg((own > other)::INT), 6) AS closest, round(avg(n_own::DOUBLE / n), 6) AS chance FROM c
UNION ALL SELECT 'another setting', count(*), round(avg((own_setting > other)::INT), 6), round(avg(n_setting::DOUBLE / (n_setting + n - n_own)), 6) FROM c WHERE own_setting IS NOT NULL""")
def isomer_own_closest(spark: SparkSession, folder: str) -> DataFrame:
    """How often the closest relative among all spectra of the formula and mode is of the own molecule; strictly, at another energy only."""
    c = _isomers(spark, folder)
    plain = c.select(F.lit("any setting").alias("own_is"), (F.col("own") > F.col("other")).alias("hit"), (F.col("n_own") / (F.col("n") - 1)).alias("chance"))
    strict = c.where("own_setting is not null").select(F.lit("another setting").alias("own_is"), (F.col("own_setting") > F.col("other")).alias("hit"), (F.col("n_setting") / (F.col("n_setting") + F.col("n") - 1 - F.col("n_own"))).alias("chance"))
    return plain.unionByName(strict).groupBy(F.col("own_is").alias("own")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("closest"), F.round(F.avg("chance"), 6).alias("chance"))


@registry.query(f"""
WITH {_ISOMERS} SELECT CASE WHEN molecules = 2 THEN '1' WHEN molecules <= 5 THEN '2-4' WHEN molecules <= 20 THEN '5-19' ELSE '20+' END AS isomers, count(*) AS n, round(avg((own > other)::INT), 6) AS accuracy FROM c GROUP BY 1""")
def isomer_accuracy_by_size(spark: SparkSession, folder: str) -> DataFrame:
    """Top-1 accuracy among isomers by how many isomers there are."""
    m = F.col("molecules")
    size = F.when(m == 2, "1").when(m <= 5, "2-4").when(m <= 20, "5-19").otherwise("20+")
    return _isomers(spark, folder).groupBy(size.alias("isomers")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("own") > F.col("other")).cast("int")), 6).alias("accuracy"))


# --- splits, inputs, statistics --------------------------------------------------------------------------------------

#: Libraries whose spectra train, those that validate, and the one whose molecules neither may use.
TRAIN_LIBRARIES, VALIDATION_LIBRARIES, HELD_OUT_LIBRARY = ("ursa-tims", "heron-orbi", "kelp-qtof", "lumen-orbi", "quill-community"), ("ursa-tims", "heron-orbi"), "tarn-lipid"
_LIST = lambda names: ", ".join(f"'{n}'" for n in names)


@registry.query(f"""
WITH t AS (SELECT row_id, {CLEAN_KEY} AS key, replace(lower(trim(ingest_lib)), '_', '-') AS lib FROM train), h AS (SELECT DISTINCT key FROM t WHERE lib = '{HELD_OUT_LIBRARY}' AND key IS NOT NULL),
v AS (SELECT key FROM (SELECT DISTINCT key FROM t WHERE key IS NOT NULL) WHERE ('0x' || md5('0|' || key)[1:8])::BIGINT / 4294967296.0 < 0.05)
SELECT row_id, CASE WHEN key IN (SELECT key FROM v) THEN 'validation' ELSE 'train' END AS part FROM t WHERE key IS NOT NULL AND (
 (key IN (SELECT key FROM v) AND lib IN ({_LIST(VALIDATION_LIBRARIES)})) OR (key NOT IN (SELECT key FROM v) AND key NOT IN (SELECT key FROM h) AND lib IN ({_LIST(TRAIN_LIBRARIES)})))""")
def split_spectra_by_molecule(spark: SparkSession, folder: str) -> DataFrame:
    """Training and validation spectra: a held-out molecule is out of training in every library, as are those of one library."""
    t = load(spark, folder, "train").select("row_id", clean_key(F.col("inchikey14")).alias("key"), clean_name(F.col("ingest_lib")).alias("lib")).where("key is not null")
    keys = t.groupBy("key").agg(F.max(F.col("lib") == HELD_OUT_LIBRARY).alias("barred")).withColumn("held", P.hash_share(0, F.col("key")) < 0.05)
    part = F.when(F.col("held") & F.col("lib").isin(*VALIDATION_LIBRARIES), "validation").when(~F.col("held") & ~F.coalesce("barred", F.lit(False)) & F.col("lib").isin(*TRAIN_LIBRARIES), "train")
    return salted_join(t, keys, "key").select("row_id", part.alias("part")).where("part is not null")


@registry.query(f"""
WITH {EMBEDDINGS}, t AS (SELECT row_id, coalesce(adduct IN ({', '.join(f"'{a}'" for a in M.EMBEDDED_ADDUCTS)}) AND ((adduct LIKE '%+' AND ionization_mode = 'positive') OR (adduct LIKE '%-' AND ionization_mode = 'negative')), false) AS gets FROM train)
SELECT t.row_id, (gets AND e IS NOT NULL)::INT AS has_embedding, CASE WHEN gets AND e IS NOT NULL THEN round(32 * e[1] / sqrt(list_dot_product(e, e)), 5) ELSE 0.0 END AS first_column,
 CASE WHEN gets AND e IS NOT NULL THEN round(32 * list_sum(e) / sqrt(list_dot_product(e, e)), 4) ELSE 0.0 END AS column_sum, 128 + 1 AS columns FROM t LEFT JOIN emb USING (row_id)""")
def embedding_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """A combined model's embedding columns (scaled by 32) and flag; zeros and 0 for a spectrum that gets none."""
    t = load(spark, folder, "train", "row_id", M.gets_embedding(F.col("adduct"), F.col("ionization_mode")).alias("gets"))
    joined = t.join(embeddings(spark, folder).select("row_id", V.unit(F.col("e")).alias("u")), "row_id", "left")
    x = V.embedding_columns(F.when(F.col("gets"), F.col("u")), 128, 32.0)
    out = joined.select("row_id", x.alias("x"))
    return out.select("row_id", F.element_at("x", -1).cast("int").alias("has_embedding"), F.round(F.col("x")[0], 5).alias("first_column"), F.round(V.total(F.slice("x", 1, 128)), 4).alias("column_sum"), F.size("x").alias("columns"))


@registry.query(f"""
WITH {_KEYED}, mu AS (SELECT d, avg(u[d]) AS m FROM ke, range(1, 129) r(d) GROUP BY d), x AS (SELECT row_id, list_transform(list_zip(u, c), lambda z: z[1] - z[2]) AS x FROM ke, (SELECT list(m ORDER BY d) AS c FROM mu))
SELECT (i - 1)::INT AS i, (j - 1)::INT AS j, round(sum(x[i] * x[j]) / (count(*) - 1), 7) AS covariance FROM x, range(1, 129) a(i), range(1, 129) b(j) WHERE i <= j GROUP BY i, j""")
def covariance_matrix(spark: SparkSession, folder: str) -> DataFrame:
    _, cov, _ = stats.covariance(keyed_embeddings(spark, folder), "u")
    return spark.createDataFrame([(i, j, round(float(cov[i, j]), 7)) for i in range(len(cov)) for j in range(i, len(cov))], "i int, j int, covariance double")


_PEAK_RATIOS = "WITH p AS (SELECT ionization_mode, unnest(ms2_normalized_intensities) AS x FROM train WHERE ionization_mode IS NOT NULL), h AS (SELECT ionization_mode, least(floor(ln(x / 0.0001) / (ln(1.0 / 0.0001) / 20))::BIGINT, 19) AS bin, count(*) AS n FROM p WHERE x >= 0.0001 AND x < 1 GROUP BY 1, 2)"


@registry.query(_PEAK_RATIOS + " SELECT ionization_mode, bin, n, round(n / sum(n) OVER (PARTITION BY ionization_mode) / 0.05, 6) AS density FROM h")
def histogram_intensities_log(spark: SparkSession, folder: str) -> DataFrame:
    """Intensities in 20 bins of equal ratios from 0.0001 to 1, with densities over the unit length of the scale."""
    long = load(spark, folder, "train").select("ionization_mode", F.explode("ms2_normalized_intensities").alias("x")).where("ionization_mode is not null")
    counts = stats.histogram(long, F.col("x"), 0.0001, 1.0, 20, "ionization_mode", log=True)
    return stats.densities(counts, 0.0, 1.0, 20, "ionization_mode").withColumn("density", F.round("density", 6))


@registry.query("""
SELECT fp_index, exact_mass, position FROM (SELECT fp_index, exact_mass, row_number() OVER (ORDER BY exact_mass, fp_index) - 1 AS position FROM molecules WHERE exact_mass IS NOT NULL) WHERE position >= 100 AND position < 150""")
def mass_order_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Rows 100 to 149 in order of mass: a slice by position, no task sorts all rows."""
    placed = with_position(load(spark, folder, "molecules", "fp_index", "exact_mass").where("exact_mass is not null"), "exact_mass", "fp_index")
    return placed.where("position >= 100 and position < 150").select("fp_index", "exact_mass", "position")


@registry.query(f"""
SELECT row_id, mass, row_number() OVER (ORDER BY row_id) - 1 AS position FROM (SELECT row_id, {CLEAN_KEY} AS key FROM train) LEFT JOIN (SELECT inchikey14 AS key, min(exact_mass) AS mass FROM molecules WHERE inchikey14 IS NOT NULL GROUP BY 1) USING (key)""")
def left_join_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """The mass of every spectrum's molecule; the rows keep the place that they had in order of id."""
    rows = with_position(load(spark, folder, "train").select("row_id", clean_key(F.col("inchikey14")).alias("key")), "row_id")
    m = structures(spark, folder).where("key is not null").groupBy("key").agg(F.min("mass").alias("mass"))
    return salted_join(rows, m, "key", how="left").select("row_id", "mass", "position")


@registry.query("SELECT c.molecule_id, c.key, m.fp_index FROM (SELECT DISTINCT molecule_id, key FROM candidates WHERE key IS NOT NULL) c JOIN (SELECT inchikey14 AS key, min(fp_index) AS fp_index FROM molecules WHERE inchikey14 IS NOT NULL GROUP BY 1) m USING (key)")
def candidate_structures(spark: SparkSession, folder: str) -> DataFrame:
    """The structure of every candidate key; a key without one stops the query."""
    keys = load(spark, folder, "candidates", "molecule_id", "key").where("key is not null").distinct()
    m = structures(spark, folder).where("key is not null").groupBy("key").agg(F.min("fp_index").alias("fp_index"))
    return lookup_or_fail(keys, m, "key", "fp_index")


@registry.query(f"""
WITH {_KEYED}, s AS (SELECT inchikey14 AS key, min(fp_index) AS fp_index FROM molecules WHERE inchikey14 IS NOT NULL GROUP BY 1) SELECT ke.row_id, s.fp_index, {NEUTRAL.replace('precursor_mz', 'ke.precursor_mz')} AS m FROM ke JOIN s USING (key) LEFT JOIN {ADDUCT_VALUES} ON ke.adduct = name""".replace(" AS m FROM", " AS neutral_mass FROM"))
def positional_join(spark: SparkSession, folder: str) -> DataFrame:
    """Spectra with a vector and the position of their structure: an equi-join on the position's key."""
    s = keep_first(structures(spark, folder).where("key is not null"), ["key"], "fp_index").select("key", "fp_index")
    k = keyed_embeddings(spark, folder).select("row_id", "key", "precursor_mz", "adduct")
    return salted_join(k, s, "key").select("row_id", "fp_index", M.neutral_mass(F.col("precursor_mz"), F.col("adduct")).alias("neutral_mass"))


@registry.query("""
SELECT CASE WHEN normalized_smiles IS NULL OR trim(normalized_smiles) = '' THEN 'unparsable or no structure' WHEN contains(normalized_smiles, '*') THEN 'generic structure (* atoms)'
 WHEN regexp_matches(normalized_smiles, '\\[[0-9]+[A-Za-z]') THEN 'isotope-labelled' WHEN exact_mass > 2000 THEN 'exact mass above 2000' ELSE 'kept' END AS reason, count(*) AS n, round(sum(len(regexp_extract_all(normalized_smiles, '\\.')))::DOUBLE, 1) AS dots FROM molecules GROUP BY 1""")
def structure_drop_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why structures are left out of a library, as far as their text and mass tell."""
    m = load(spark, folder, "molecules", "normalized_smiles", "exact_mass")
    dots = F.sum(F.length("normalized_smiles") - F.length(F.replace(F.col("normalized_smiles"), F.lit("."), F.lit(""))))
    return m.groupBy(X.drop_reason(F.col("normalized_smiles"), F.col("exact_mass")).alias("reason")).agg(F.count("*").alias("n"), F.round(dots.cast("double"), 1).alias("dots"))


@registry.query(similarity.sql["constant_bits_baseline"].replace("SELECT k::INT AS k, round(avg(shared / (k + bits - shared)), 6) AS tanimoto FROM i GROUP BY k", "SELECT k, tanimoto FROM (SELECT k::INT AS k, round(avg(shared / (k + bits - shared)), 6) AS tanimoto FROM i GROUP BY k) ORDER BY tanimoto DESC, k LIMIT 1"))
def best_constant_bits(spark: SparkSession, folder: str) -> DataFrame:
    """The number of commonest bits that is the best constant guess."""
    return constant_bits_baseline(spark, folder).orderBy(F.desc("tanimoto"), "k").limit(1)

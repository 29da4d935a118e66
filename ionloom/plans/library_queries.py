"""Building libraries and pools, mass windows, ranking and its measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionloom.functions import metadata as M
from ionloom.functions.keys import clean_key
from ionloom.operators import ranking as R
from ionloom.operators import sampling as P
from ionloom.operators.dedupe import keep_first, mark
from ionloom.operators.ppm import adaptive_window, mass_chunks, ppm_error, ppm_join, window_sizes
from ionloom.operators.skew import salted_join
from ionloom.operators.stats import quantiles
from ionloom.plans.common import ADDUCT_VALUES, CLEAN_KEY, NEUTRAL, structures, train
from ionloom.plans.registry import Registry
from ionloom.tables import load

registry = Registry()

# --- libraries and pools -------------------------------------------------------------------------------------------


@registry.query(f"""
SELECT normalized_smiles, key, row_id FROM (SELECT normalized_smiles, {CLEAN_KEY} AS key, row_id, row_number() OVER (PARTITION BY normalized_smiles ORDER BY row_id) AS r FROM train WHERE normalized_smiles IS NOT NULL) WHERE r = 1""")
def library_distinct_molecules(spark: SparkSession, folder: str) -> DataFrame:
    rows = train(spark, folder).where("normalized_smiles is not null").select("normalized_smiles", clean_key(F.col("inchikey14")).alias("key"), "row_id")
    return keep_first(rows, ["normalized_smiles"], "row_id")



@registry.query("""
SELECT key, normalized_smiles, fp_index FROM (
  SELECT inchikey14 AS key, normalized_smiles, fp_index, row_number() OVER (PARTITION BY inchikey14 ORDER BY contains(normalized_smiles, '/') OR contains(normalized_smiles, '@'), fp_index) AS r
  FROM molecules WHERE inchikey14 IS NOT NULL AND normalized_smiles IS NOT NULL) WHERE r = 1""")
def library_prefer_unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    """One structure a key, one without bond or centre labels first, then by position."""
    m = load(spark, folder, "molecules").where("inchikey14 is not null and normalized_smiles is not null").select(F.col("inchikey14").alias("key"), "normalized_smiles", "fp_index")
    labelled = F.col("normalized_smiles").contains("/") | F.col("normalized_smiles").contains("@")
    return keep_first(m, ["key"], labelled, "fp_index")


_SOURCES = f"""
s AS (SELECT DISTINCT source, key FROM candidates WHERE key IS NOT NULL UNION SELECT DISTINCT 'molecules', inchikey14 FROM molecules WHERE inchikey14 IS NOT NULL),
t AS (SELECT DISTINCT {CLEAN_KEY} AS key FROM train)"""


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    """(source, key) of every library, with flags whether training spectra and the molecule table have the key."""
    c = load(spark, folder, "candidates").select("source", "key")
    m = load(spark, folder, "molecules").select(F.lit("molecules").alias("source"), F.col("inchikey14").alias("key"))
    rows = c.unionByName(m).where("key is not null").distinct()
    return mark(mark(rows, train(spark, folder).select(clean_key(F.col("inchikey14")).alias("key")), "key", "in_train"), m, "key", "in_molecules")


@registry.query(f"WITH {_SOURCES} SELECT source, key, key IN (SELECT key FROM t WHERE key IS NOT NULL) AS in_train, key IN (SELECT inchikey14 FROM molecules WHERE inchikey14 IS NOT NULL) AS in_molecules FROM s")
def library_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _sources(spark, folder)


@registry.query(f"""
WITH {_SOURCES} SELECT source, count(*) AS structures, sum((key IN (SELECT key FROM t WHERE key IS NOT NULL))::INT) AS in_train,
 sum((key NOT IN (SELECT key FROM t WHERE key IS NOT NULL))::INT) AS new_structures FROM s GROUP BY source""")
def library_source_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _sources(spark, folder).groupBy("source").agg(F.count("*").alias("structures"), F.sum(F.col("in_train").cast("int")).alias("in_train"), F.sum((~F.col("in_train")).cast("int")).alias("new_structures"))


@registry.query(f"SELECT DISTINCT inchikey14 AS key FROM molecules WHERE inchikey14 IS NOT NULL AND inchikey14 NOT IN (SELECT {CLEAN_KEY} FROM train WHERE {CLEAN_KEY} IS NOT NULL)")
def pool_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of structures without a training spectrum."""
    seen = train(spark, folder).select(clean_key(F.col("inchikey14")).alias("key")).distinct()
    return structures(spark, folder).select("key").where("key is not null").distinct().join(seen, "key", "left_anti")


@registry.query(f"""
WITH t AS (SELECT DISTINCT {CLEAN_KEY} AS key FROM train), c AS (SELECT molecule_id, key, source, key IN (SELECT key FROM t WHERE key IS NOT NULL) AS known FROM candidates)
SELECT pool, count(*) AS n, count(DISTINCT key) AS keys FROM (
 SELECT 'known' AS pool, key FROM c WHERE known UNION ALL SELECT 'outside' AS pool, key FROM c WHERE NOT known OR source <> 'train' UNION ALL SELECT 'all' AS pool, key FROM c) GROUP BY pool""")
def pool_three_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Three pools of the candidates in one pass: each row is told the pools it belongs to."""
    c = mark(load(spark, folder, "candidates").select("key", "source"), train(spark, folder).select(clean_key(F.col("inchikey14")).alias("key")), "key", "known")
    pools = F.array_compact(F.array(F.when(F.col("known"), "known"), F.when(~F.col("known") | (F.col("source") != "train"), "outside"), F.lit("all")))
    return c.select(F.explode(pools).alias("pool"), "key").groupBy("pool").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


@registry.query("""
WITH c AS (SELECT exact_mass AS m, count(*) AS n FROM molecules WHERE exact_mass IS NOT NULL GROUP BY 1),
b AS (SELECT m, coalesce(sum(n) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT fp_index, floor(before / 100)::BIGINT AS chunk FROM molecules JOIN b ON exact_mass = m""")
def pool_mass_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of about 100 structures in order of mass; a mass is never parted."""
    return mass_chunks(load(spark, folder, "molecules", "fp_index", "exact_mass"), "exact_mass", 100).select("fp_index", "chunk")


@registry.query(f"""
WITH a AS (SELECT DISTINCT {CLEAN_KEY} AS k FROM train WHERE {CLEAN_KEY} IS NOT NULL), b AS (SELECT DISTINCT inchikey14 AS k FROM molecules WHERE inchikey14 IS NOT NULL)
SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'union_all', (SELECT count(*) FROM a) + (SELECT count(*) FROM b)
UNION ALL SELECT 'equal', ((SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) = 0 AND (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) = 0)::INT""")
def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    a = train(spark, folder).select(clean_key(F.col("inchikey14")).alias("k")).where("k is not null").distinct()
    b = structures(spark, folder).select(F.col("key").alias("k")).where("k is not null").distinct()
    sides = a.select("k", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select("k", F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n = sides.agg(F.count("*").alias("union"), F.count_if(F.col("a") + F.col("b") == 2).alias("intersect"), F.count_if(F.col("a") > F.col("b")).alias("except"), F.sum(F.col("a") + F.col("b")).alias("union_all"), F.min((F.col("a") == F.col("b")).cast("bigint")).alias("equal"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("op"), F.col(f"`{c}`").cast("bigint").alias("n")) for c in ("union", "intersect", "except", "union_all", "equal")])).alias("r")).select("r.*")


@registry.query("""
SELECT t.row_id, m.fp_index FROM train t JOIN (SELECT normalized_smiles, min(fp_index) AS fp_index FROM molecules GROUP BY 1) m ON t.normalized_smiles = m.normalized_smiles""")
def structure_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The structure of every spectrum whose SMILES is known; a hot SMILES is spread over salts."""
    dim = load(spark, folder, "molecules").where("normalized_smiles is not null").groupBy("normalized_smiles").agg(F.min("fp_index").alias("fp_index"))
    return salted_join(load(spark, folder, "train", "row_id", "normalized_smiles"), dim, "normalized_smiles").select("row_id", "fp_index")


@registry.query("""
WITH e AS (SELECT DISTINCT row_id, embedding FROM spectrum_embeddings WHERE embedding IS NOT NULL)
SELECT t.row_id, e.row_id IS NOT NULL AS has_embedding, coalesce(round(e.embedding[1]::DOUBLE, 6), 0.0) AS first_value, coalesce(len(e.embedding), 128) AS width FROM train t LEFT JOIN e ON t.row_id = e.row_id""")
def embeddings_of_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every spectrum's vector; those without one get zeros and a flag."""
    e = keep_first(load(spark, folder, "spectrum_embeddings").where("embedding is not null"), ["row_id"], "embedding")
    joined = load(spark, folder, "train", "row_id").join(e, "row_id", "left")
    full = F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), 128))
    return joined.select("row_id", F.col("embedding").isNotNull().alias("has_embedding"), F.round(full[0].cast("double"), 6).alias("first_value"), F.size(full).alias("width"))


# --- mass windows --------------------------------------------------------------------------------------------------

_QUERIES = f"q AS (SELECT spectrum_id, molecule_id, {NEUTRAL} AS m FROM test JOIN {ADDUCT_VALUES} ON adduct = name)"
_WINDOW = "exact_mass >= m - m * {w} AND exact_mass <= m + m * {w}"


def query_spectra(spark: SparkSession, folder: str) -> DataFrame:
    t = load(spark, folder, "test").where(F.col("adduct").isin(*M.ADDUCTS))
    return t.select("spectrum_id", "molecule_id", M.neutral_mass(F.col("precursor_mz"), F.col("adduct")).alias("m"))


@registry.query(f"WITH {_QUERIES} SELECT spectrum_id, fp_index, round(abs(exact_mass - m) / m * 1e6, 4) AS ppm_error FROM q JOIN molecules ON {_WINDOW.format(w='(10.0 * 1e-6)')}")
def ppm_candidates(spark: SparkSession, folder: str) -> DataFrame:
    joined = ppm_join(query_spectra(spark, folder), structures(spark, folder), "m", "mass", 10.0)
    return joined.select("spectrum_id", "fp_index", F.round(ppm_error(F.col("mass"), F.col("m")), 4).alias("ppm_error"))


@registry.query(f"WITH {_QUERIES} SELECT spectrum_id, count(fp_index) AS window_size FROM q LEFT JOIN molecules ON {_WINDOW.format(w='(10.0 * 1e-6)')} GROUP BY spectrum_id")
def ppm_window_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return window_sizes(query_spectra(spark, folder), structures(spark, folder), "spectrum_id", "m", "mass", 10.0)


@registry.query(f"""
WITH {_QUERIES}, w AS (SELECT spectrum_id, fp_index, m, exact_mass FROM q JOIN molecules ON {_WINDOW.format(w='(80.0 * 1e-6)')}),
n AS (SELECT spectrum_id, CASE WHEN count(*) FILTER ({_WINDOW.format(w='(10.0 * 1e-6)')}) >= 25 THEN 10.0 WHEN count(*) FILTER ({_WINDOW.format(w='(20.0 * 1e-6)')}) >= 25 THEN 20.0
  WHEN count(*) FILTER ({_WINDOW.format(w='(40.0 * 1e-6)')}) >= 25 THEN 40.0 ELSE 80.0 END::DOUBLE AS ppm FROM w GROUP BY spectrum_id)
SELECT w.spectrum_id, fp_index, ppm FROM w JOIN n USING (spectrum_id) WHERE {_WINDOW.format(w='(ppm * 1e-6)')}""")
def ppm_adaptive_window(spark: SparkSession, folder: str) -> DataFrame:
    """Windows that widen from 10 to 80 ppm until they hold 25 structures."""
    return adaptive_window(query_spectra(spark, folder), structures(spark, folder), "spectrum_id", "m", "mass").select("spectrum_id", "fp_index", "ppm")


@registry.query(f"""
WITH t AS (SELECT row_id, {CLEAN_KEY} AS key, {NEUTRAL} AS m FROM train JOIN {ADDUCT_VALUES} ON adduct = name)
SELECT row_id, fp_index FROM t JOIN molecules ON key = inchikey14 AND {_WINDOW.format(w='(2.0 * 1e-6)')}""")
def exact_mass_probe(spark: SparkSession, folder: str) -> DataFrame:
    """Structures within 2 ppm that have the spectrum's own key: the key decides, so it leads the join and the mass checks."""
    t = train(spark, folder).where(F.col("adduct").isin(*M.ADDUCTS)).select("row_id", clean_key(F.col("inchikey14")).alias("key"), M.neutral_mass(F.col("precursor_mz"), F.col("adduct")).alias("m"))
    w = 2.0 * 1e-6
    joined = salted_join(t, structures(spark, folder), "key")
    return joined.where((F.col("mass") >= F.col("m") - F.col("m") * w) & (F.col("mass") <= F.col("m") + F.col("m") * w)).select("row_id", "fp_index")


# --- ranking -------------------------------------------------------------------------------------------------------

_BEST = """
s AS (SELECT molecule_id, key, smiles, score, mass_error_ppm, source FROM candidates WHERE score IS NOT NULL AND NOT isnan(score)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY molecule_id, key ORDER BY score DESC, mass_error_ppm, smiles, source) AS r1 FROM s) WHERE r1 = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY molecule_id ORDER BY score DESC, mass_error_ppm, key) AS rank, md5(molecule_id || '|' || key) AS h FROM b)"""
#: Which candidate counts as the truth: the first of a molecule's keys in hash order (no table names it).
_TRUTH = "truth AS (SELECT molecule_id, key AS true_key FROM (SELECT molecule_id, key, row_number() OVER (PARTITION BY molecule_id ORDER BY md5(molecule_id || '|' || key)) AS r FROM (SELECT DISTINCT molecule_id, key FROM candidates WHERE key IS NOT NULL)) WHERE r = 1)"


def ranked_candidates(spark: SparkSession, folder: str, *by: str) -> DataFrame:
    scored = load(spark, folder, "candidates").where("score is not null and not isnan(score)")
    best = keep_first(scored, [*by, "molecule_id", "key"], F.desc("score"), "mass_error_ppm", "smiles", "source")
    order = Window.partitionBy(*by, "molecule_id").orderBy(F.desc("score"), "mass_error_ppm", "key")
    return best.withColumn("rank", F.row_number().over(order).cast("bigint"))


def true_keys(spark: SparkSession, folder: str) -> DataFrame:
    keys = load(spark, folder, "candidates", "molecule_id", "key").where("key is not null").distinct()
    return keep_first(keys, ["molecule_id"], F.md5(F.concat_ws("|", "molecule_id", "key"))).withColumnRenamed("key", "true_key")


@registry.query(f"WITH {_BEST} SELECT molecule_id, key, rank FROM ranked WHERE rank <= 25")
def candidates_top25(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_candidates(spark, folder).where("rank <= 25").select("molecule_id", "key", "rank")


@registry.query(f"WITH {_BEST} SELECT molecule_id, string_agg(smiles, ';' ORDER BY rank) AS smiles FROM ranked WHERE rank <= 25 GROUP BY molecule_id")
def submission_top25(spark: SparkSession, folder: str) -> DataFrame:
    return R.submission(ranked_candidates(spark, folder), "molecule_id", "smiles")


_RANKS = f"""{_BEST}, {_TRUTH},
ranks AS (SELECT molecule_id, min(CASE WHEN key = true_key THEN rank END) AS rank, count(*) AS n FROM ranked JOIN truth USING (molecule_id) GROUP BY molecule_id)"""
_METRICS = """round(avg(CASE WHEN rank <= 25 THEN 1.0 / rank ELSE 0 END), 6) AS mrr, round(avg((coalesce(rank, 999) <= 1)::INT), 6) AS top1, round(avg((coalesce(rank, 999) <= 5)::INT), 6) AS top5,
 round(avg((coalesce(rank, 999) <= 25)::INT), 6) AS top25, round(avg(CASE WHEN rank IS NOT NULL THEN list_sum(list_transform(range(1, least(25, n) + 1), lambda x: 1.0 / x)) / n ELSE 0 END), 6) AS random_mrr, count(*) AS n_queries"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


@registry.query(f"WITH {_RANKS} SELECT molecule_id, rank, n AS n_candidates FROM ranks")
def truth_ranks(spark: SparkSession, folder: str) -> DataFrame:
    ranked = ranked_candidates(spark, folder).join(true_keys(spark, folder), "molecule_id")
    return R.truth_ranks(ranked, "molecule_id", F.col("key") == F.col("true_key"))


@registry.query(f"WITH {_RANKS} SELECT {_METRICS} FROM ranks")
def mrr_known(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(R.rank_metrics(truth_ranks(spark, folder)))


_BY_POOL = _BEST.replace("PARTITION BY molecule_id", "PARTITION BY source, molecule_id")


@registry.query(f"""
WITH {_BY_POOL}, {_TRUTH}, ranks AS (SELECT source, molecule_id, min(CASE WHEN key = true_key THEN rank END) AS rank, count(*) AS n FROM ranked JOIN truth USING (molecule_id) GROUP BY source, molecule_id)
SELECT source, round(avg((rank IS NOT NULL)::INT), 6) AS recall, median(n)::DOUBLE AS median_candidates, round(quantile_cont(n, 0.9), 6) AS p90_candidates, max(n) AS max_candidates, {_METRICS} FROM ranks GROUP BY source""")
def mrr_by_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Recall, window sizes and ranking measures per source of candidates."""
    ranked = ranked_candidates(spark, folder, "source").join(true_keys(spark, folder), "molecule_id")
    ranks = ranked.groupBy("source", "molecule_id").agg(F.min(F.when(F.col("key") == F.col("true_key"), F.col("rank"))).alias("rank"), F.count("*").alias("n_candidates"))
    sizes = ranks.groupBy("source").agg(F.avg(F.col("rank").isNotNull().cast("double")).alias("recall"), F.max("n_candidates").alias("max_candidates"))
    sizes = sizes.join(quantiles(ranks, "n_candidates", {"median_candidates": 0.5, "p90_candidates": 0.9}, "source").drop("n"), "source")
    return _rounded(sizes.join(R.rank_metrics(ranks, "source"), "source"))


_NOVEL = _BEST.replace("FROM candidates WHERE", "FROM candidates WHERE key NOT IN (SELECT true_key FROM truth) AND")


@registry.query(f"WITH {_TRUTH}, {_NOVEL} SELECT molecule_id, count(*) AS n_candidates, round(max(score), 6) AS best FROM ranked GROUP BY molecule_id")
def novel_scenario(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates once every true key is taken out of the library."""
    scored = load(spark, folder, "candidates").where("score is not null and not isnan(score)").join(true_keys(spark, folder).select(F.col("true_key").alias("key")), "key", "left_anti")
    return keep_first(scored, ["molecule_id", "key"], F.desc("score"), "mass_error_ppm", "smiles", "source").groupBy("molecule_id").agg(F.count("*").alias("n_candidates"), F.round(F.max("score"), 6).alias("best"))


@registry.query(f"""
WITH {_BEST}, {_TRUTH}, t AS (SELECT molecule_id, score AS true_score FROM b JOIN truth USING (molecule_id) WHERE key = true_key)
SELECT molecule_id, 1 + count(*) FILTER (score > true_score) AS rank FROM b JOIN t USING (molecule_id) GROUP BY molecule_id""")
def optimistic_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """One more than the number of strictly better candidates."""
    ranked = ranked_candidates(spark, folder)
    truth = ranked.join(true_keys(spark, folder), "molecule_id").where("key = true_key").select("molecule_id", F.col("score").alias("t"))
    return ranked.join(truth, "molecule_id").groupBy("molecule_id").agg((F.count_if(F.col("score") > F.col("t")) + 1).alias("rank"))


_SEEDED = "seeded AS (SELECT source, (('0x' || md5(molecule_id)[1:1])::INT) % 3 AS seed, rank FROM ranks)"


@registry.query(f"""
WITH {_BY_POOL}, {_TRUTH}, ranks AS (SELECT source, molecule_id, min(CASE WHEN key = true_key THEN rank END) AS rank FROM ranked JOIN truth USING (molecule_id) GROUP BY source, molecule_id),
{_SEEDED}, m AS (SELECT source, seed, avg(CASE WHEN rank <= 25 THEN 1.0 / rank ELSE 0 END) AS mrr FROM seeded GROUP BY source, seed)
SELECT source, round(avg(mrr), 6) AS mean, round(stddev_samp(mrr), 6) AS sd, count(*) AS seeds FROM m GROUP BY source""")
def seed_mean_sd(spark: SparkSession, folder: str) -> DataFrame:
    """MRR per seed, then mean and standard deviation over seeds; a seed is a third of the molecules by hash."""
    ranked = ranked_candidates(spark, folder, "source").join(true_keys(spark, folder), "molecule_id")
    ranks = ranked.groupBy("source", "molecule_id").agg(F.min(F.when(F.col("key") == F.col("true_key"), F.col("rank"))).alias("rank"))
    seed = F.conv(F.substring(F.md5("molecule_id"), 1, 1), 16, 10).cast("int") % 3
    mrr = ranks.groupBy("source", seed.alias("seed")).agg(F.avg(F.coalesce(F.when(F.col("rank") <= 25, 1 / F.col("rank")), F.lit(0.0))).alias("mrr"))
    return mrr.groupBy("source").agg(F.round(F.avg("mrr"), 6).alias("mean"), F.round(F.stddev_samp("mrr"), 6).alias("sd"), F.count("*").alias("seeds"))


@registry.query(f"""
WITH {_BEST}, {_TRUTH}, r1 AS (SELECT molecule_id, min(CASE WHEN key = true_key THEN rank END) AS a FROM ranked JOIN truth USING (molecule_id) GROUP BY 1),
r2 AS (SELECT molecule_id, min(CASE WHEN key = true_key THEN k END) AS z FROM (SELECT *, row_number() OVER (PARTITION BY molecule_id ORDER BY mass_error_ppm, score DESC, key) AS k FROM b) JOIN truth USING (molecule_id) GROUP BY 1),
d AS (SELECT coalesce(CASE WHEN z <= 25 THEN 1.0 / z END, 0) - coalesce(CASE WHEN a <= 25 THEN 1.0 / a END, 0) AS d FROM r1 JOIN r2 USING (molecule_id))
SELECT round(avg(d), 6) AS mean_difference, round(stddev_samp(d) / sqrt(count(*)), 6) AS standard_error, count(*) FILTER (d > 0) AS better, count(*) FILTER (d < 0) AS worse FROM d""")
def paired_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Reciprocal ranks by mass error against those by score."""
    from ionloom.operators.stats import paired_difference as paired

    ranked = ranked_candidates(spark, folder)
    other = ranked.withColumn("k", F.row_number().over(Window.partitionBy("molecule_id").orderBy("mass_error_ppm", F.desc("score"), "key")))
    place = lambda c: F.min(F.when(F.col("key") == F.col("true_key"), F.col(c)))
    both = other.join(true_keys(spark, folder), "molecule_id").groupBy("molecule_id").agg(place("rank").alias("a"), place("k").alias("z"))
    rr = lambda c: F.coalesce(F.when(F.col(c) <= 25, 1 / F.col(c)), F.lit(0.0))
    return _rounded(paired(both, rr("a"), rr("z")))


# --- samples and decoys --------------------------------------------------------------------------------------------

_SHARE = "(('0x' || md5({seed} || '|' || {c})[1:8])::BIGINT / 4294967296.0)"


@registry.query(f"SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY key, adduct ORDER BY md5('0|' || row_id), row_id) AS r FROM (SELECT row_id, {CLEAN_KEY} AS key, adduct FROM train)) WHERE r <= 3")
def n_per_group(spark: SparkSession, folder: str) -> DataFrame:
    t = train(spark, folder).select("row_id", clean_key(F.col("inchikey14")).alias("key"), "adduct")
    return P.n_per_group(t, ["key", "adduct"], "row_id", 3).select("row_id")


@registry.query(f"SELECT key, {_SHARE.format(seed=chr(39) + '0' + chr(39), c='key')} < 0.05 AS held_out FROM (SELECT DISTINCT {CLEAN_KEY} AS key FROM train) WHERE key IS NOT NULL")
def split_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return P.split_keys(train(spark, folder).select(clean_key(F.col("inchikey14")).alias("key")), "key", 0.05)


@registry.query(f"""
SELECT key, CASE WHEN {_SHARE.format(seed="'1'", c='key')} < 0.5 THEN 'selection' ELSE 'test' END AS half FROM (SELECT DISTINCT {CLEAN_KEY} AS key FROM train) WHERE key IS NOT NULL AND {_SHARE.format(seed="'0'", c='key')} < 0.05""")
def selection_test_halves(spark: SparkSession, folder: str) -> DataFrame:
    held = split_by_key(spark, folder).where("held_out")
    return held.select("key", F.when(P.hash_share(1, F.col("key")) < 0.5, "selection").otherwise("test").alias("half"))


@registry.query(f"""
WITH t AS (SELECT row_id, {CLEAN_KEY} AS key, adduct FROM train WHERE adduct IS NOT NULL), c AS (SELECT key, adduct, row_number() OVER (PARTITION BY key ORDER BY md5('0|' || adduct), adduct) AS r FROM (SELECT DISTINCT key, adduct FROM t WHERE key IS NOT NULL))
SELECT row_id, t.key, t.adduct FROM t JOIN c ON t.key = c.key AND t.adduct = c.adduct WHERE r = 1""")
def one_adduct_per_key(spark: SparkSession, folder: str) -> DataFrame:
    """The spectra of one adduct, picked by hash, of every molecule."""
    t = train(spark, folder).where("adduct is not null").select("row_id", clean_key(F.col("inchikey14")).alias("key"), "adduct").where("key is not null")
    chosen = P.n_per_group(t.select("key", "adduct").distinct(), ["key"], "adduct", 1)
    return t.join(chosen, ["key", "adduct"]).select("row_id", "key", "adduct")


@registry.query(f"SELECT fp_index, exact_mass FROM molecules WHERE exact_mass IS NOT NULL AND {_SHARE.format(seed=chr(39) + '0' + chr(39), c='fp_index')} < 0.045")
def bernoulli_bank(spark: SparkSession, folder: str) -> DataFrame:
    """A 4.5 % sample of the structures, in order of mass within range partitions."""
    bank = P.bernoulli(load(spark, folder, "molecules", "fp_index", "exact_mass").where("exact_mass is not null"), "fp_index", 0.045)
    return bank.repartitionByRange("exact_mass").sortWithinPartitions("exact_mass")


@registry.query(f"""
WITH t AS (SELECT row_id, {CLEAN_KEY} AS key, adduct FROM train WHERE ((adduct LIKE '%+' AND ionization_mode = 'positive') OR (adduct LIKE '%-' AND ionization_mode = 'negative'))),
a AS (SELECT adduct FROM t GROUP BY adduct HAVING count(*) >= 40), u AS (SELECT t.* FROM t JOIN a USING (adduct) WHERE key IS NOT NULL), m AS (SELECT key FROM u GROUP BY key HAVING count(DISTINCT adduct) >= 2),
v AS (SELECT u.* FROM u JOIN m USING (key)), k AS (SELECT adduct, key FROM (SELECT adduct, key, row_number() OVER (PARTITION BY adduct ORDER BY md5('0|' || key), key) AS r FROM (SELECT DISTINCT adduct, key FROM v)) WHERE r <= 200)
SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY adduct, key ORDER BY md5('0|' || row_id), row_id) AS r FROM v JOIN k USING (adduct, key)) WHERE r <= 3""")
def multi_adduct_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Up to 3 spectra of up to 200 molecules of each common adduct, molecules seen with two adducts or more."""
    t = train(spark, folder).where(M.sign_matches(F.col("adduct"), F.col("ionization_mode"))).select("row_id", clean_key(F.col("inchikey14")).alias("key"), "adduct")
    common = t.groupBy("adduct").agg(F.count("*").alias("n")).where("n >= 40").select("adduct")
    u = t.where("key is not null").join(common, "adduct", "left_semi")
    several = u.groupBy("key").agg(F.countDistinct("adduct").alias("n")).where("n >= 2").select("key")
    v = u.join(several, "key", "left_semi")
    chosen = P.n_per_group(v.select("adduct", "key").distinct(), ["adduct"], "key", 200)
    return P.n_per_group(v.join(chosen, ["adduct", "key"]), ["adduct", "key"], "row_id", 3).select("row_id")


@registry.query(f"""
WITH s AS (SELECT key, least(count(*), 20) AS taken, md5('0|' || key) AS h FROM (SELECT {CLEAN_KEY} AS key FROM train) WHERE key IS NOT NULL GROUP BY key)
SELECT key, taken FROM (SELECT key, taken, coalesce(sum(taken) OVER (ORDER BY h, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) WHERE before < 1000""")
def whole_group_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Whole molecules in hash order until 1,000 spectra are reached, at most 20 of each."""
    return P.whole_groups(train(spark, folder).select(clean_key(F.col("inchikey14")).alias("key")), "key", 1000, 20)


@registry.query("SELECT row_id FROM train ORDER BY md5('0|' || row_id), row_id LIMIT 200")
def row_sample(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "train", "row_id").orderBy(P.hash_order(0, F.col("row_id")), "row_id").limit(200)


_DECOY = """
k AS (SELECT DISTINCT inchikey14 AS k, exact_mass AS s FROM (SELECT inchikey14, exact_mass, row_number() OVER (PARTITION BY inchikey14 ORDER BY fp_index) AS r FROM molecules WHERE inchikey14 IS NOT NULL AND exact_mass IS NOT NULL) WHERE r = 1),
w AS (SELECT a.k AS q, b.k AS k, b.s AS s FROM k a JOIN k b ON b.s >= a.s - a.s * (10.0 * 1e-6) AND b.s <= a.s + a.s * (10.0 * 1e-6)), n AS (SELECT q, count(*) AS n FROM w GROUP BY q)"""


def _bank(spark: SparkSession, folder: str) -> DataFrame:
    return keep_first(structures(spark, folder).where("key is not null and mass is not null"), ["key"], "fp_index").select("key", "mass")


@registry.query(f"""
WITH {_DECOY}, p AS (SELECT q, k, row_number() OVER (PARTITION BY q ORDER BY s, k) - 1 AS at FROM w),
d AS (SELECT q, n, unnest(range(0, least(48, n))) AS j FROM n), e AS (SELECT q, n, j, (floor({_SHARE.format(seed="'0'", c="q")} * n)::BIGINT + j * 1000003) % n AS at FROM d),
o AS (SELECT e.q, k, n, row_number() OVER (PARTITION BY e.q ORDER BY j) AS slot FROM e JOIN p ON e.q = p.q AND e.at = p.at WHERE e.q <> k)
SELECT q AS query_key, k AS decoy, slot, n AS window_size FROM o WHERE slot <= 32""")
def fixed_decoys(spark: SparkSession, folder: str) -> DataFrame:
    bank = _bank(spark, folder)
    queries = bank.select(F.col("key").alias("query_key"), F.col("mass").alias("query_mass"))
    return P.fixed_decoys(queries, bank, query_key="query_key", query_mass="query_mass", key="key", mass="mass").select("query_key", F.col("key").alias("decoy"), "slot", "window_size")


@registry.query(f"""
WITH {_DECOY}, p AS (SELECT q, k, row_number() OVER (PARTITION BY q ORDER BY s, k) - 1 AS at FROM w),
d AS (SELECT q, n, unnest(range(0, least(32, n))) AS slot FROM n), e AS (SELECT q, slot, CASE WHEN n < 32 THEN slot ELSE floor({_SHARE.format(seed="'0'", c="(q || '#' || slot)")} * n)::BIGINT END AS at FROM d)
SELECT e.q AS query_key, slot, k AS decoy FROM e JOIN p ON e.q = p.q AND e.at = p.at WHERE e.q <> k""")
def fresh_decoys(spark: SparkSession, folder: str) -> DataFrame:
    bank = _bank(spark, folder)
    queries = bank.select(F.col("key").alias("query_key"), F.col("mass").alias("query_mass"))
    return P.fresh_decoys(queries, bank, query_key="query_key", query_mass="query_mass", key="key", mass="mass").select("query_key", "slot", F.col("key").alias("decoy"))

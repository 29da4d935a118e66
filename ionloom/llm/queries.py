"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions.keys import clean_name
from ionloom.llm.clusters import clusters, describe_clusters
from ionloom.llm.components import split_rows, unclear_entities
from ionloom.llm.neighbours import most_similar, similar_pairs
from ionloom.llm.overlap import cross_split_overlaps
from ionloom.llm.quotes import quoted_items
from ionloom.llm.tokenizer import bpe_ids
from ionloom.llm.topn import top_n_per_group
from ionloom.llm.truncation import truncated, truncation_by_source
from ionloom.plans.registry import Registry
from ionloom.tables import load

registry = Registry()

SPLIT_SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}

_CLEAN_KEY = r"""(CASE WHEN regexp_matches(regexp_replace(upper(regexp_replace(inchikey14, '\s', '', 'g')), '^INCHIKEY[=:]', ''), '^[A-Z]{14}(-.*)?$')
 THEN substr(regexp_replace(upper(regexp_replace(inchikey14, '\s', '', 'g')), '^INCHIKEY[=:]', ''), 1, 14) END)"""




def _overlaps(spark: SparkSession, folder: str) -> DataFrame:
    peaks = ("ms2_mzs", "ms2_normalized_intensities")
    return cross_split_overlaps(load(spark, folder, "train", "row_id", *peaks), load(spark, folder, "test", "spectrum_id", *peaks))


@registry.query()
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _overlaps(spark, folder).select("row_id", "spectrum_id")


@registry.query()
def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps per evaluation split and source, with the spectra of either side that they touch."""
    pairs = _overlaps(spark, folder)
    libraries = load(spark, folder, "train", "row_id", clean_name(F.col("ingest_lib")).alias("ingest_lib"))
    splits = load(spark, folder, "test", "spectrum_id", "split")
    return (
        pairs.join(libraries, "row_id").join(splits, "spectrum_id").groupBy("split", "ingest_lib")
        .agg(F.count("*").alias("pairs"), F.countDistinct("spectrum_id").alias("spectra"), F.countDistinct("row_id").alias("train_rows"), F.round(F.avg("share"), 4).alias("mean_share"))
    )


@registry.query("""
WITH v AS (
  SELECT row_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM (SELECT DISTINCT row_id, embedding FROM spectrum_embeddings WHERE embedding IS NOT NULL)
), u AS (SELECT row_id, e, sqrt(list_dot_product(e, e)) AS n FROM v), w AS (
  SELECT a.row_id AS a, b.row_id AS b, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS s FROM u a JOIN u b ON a.row_id <> b.row_id AND a.n > 0 AND b.n > 0
), r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM w WHERE s >= 0.8)
SELECT DISTINCT least(a, b) AS row_id_a, greatest(a, b) AS row_id_b FROM r WHERE k <= 5 AND s >= 0.9""")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(load(spark, folder, "spectrum_embeddings"), "row_id", "embedding")


@registry.query()
def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar of every row whose id is divisible by 100, against all rows: the graph of every shard is asked."""
    near = most_similar(load(spark, folder, "spectrum_embeddings"), "row_id", "embedding", asked=F.col("id") % 100 == 0, every_shard=True, beam=96)
    return near.where("id % 100 = 0").select(F.col("id").alias("row_id"), "neighbour", F.round("sim", 4).alias("cosine"))


@registry.query()
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return clusters(load(spark, folder, "spectrum_embeddings"), "row_id", "embedding").select(F.col("id").alias("row_id"), "cluster_key")


@registry.query()
def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every cluster with its size and its three most typical rows."""
    return describe_clusters(clusters(load(spark, folder, "spectrum_embeddings"), "row_id", "embedding"))


@registry.query(f"""
WITH told AS (
  SELECT trim(normalized_smiles) AS s, min({_CLEAN_KEY}) AS k
  FROM (SELECT normalized_smiles, inchikey14 FROM train UNION ALL SELECT normalized_smiles, inchikey14 FROM molecules)
  WHERE trim(normalized_smiles) <> '' GROUP BY 1
)
SELECT row_id, coalesce({_CLEAN_KEY}, k) AS entity_key FROM train LEFT JOIN told ON trim(normalized_smiles) = s
WHERE NOT coalesce(regexp_full_match(inchikey14, '[A-Z]{{14}}'), false) AND coalesce({_CLEAN_KEY}, k) IS NOT NULL""")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("normalized_smiles", "inchikey14")
    return unclear_entities(load(spark, folder, "train", "row_id", "ingest_lib", *columns), load(spark, folder, "molecules", *columns))


def _splits(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("normalized_smiles", "inchikey14")
    return split_rows(load(spark, folder, "train", "row_id", "ingest_lib", *columns), load(spark, folder, "molecules", *columns), SPLIT_SHARES)


@registry.query()
def p5_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The split and the component of every row."""
    return _splits(spark, folder).select("row_id", "component", "split")


@registry.query()
def p5_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each split per library."""
    per = _splits(spark, folder).groupBy(clean_name(F.col("ingest_lib")).alias("ingest_lib")).pivot("split", list(SPLIT_SHARES)).count().fillna(0, list(SPLIT_SHARES))
    total = sum(F.col(k) for k in SPLIT_SHARES)
    return per.select("ingest_lib", total.alias("spectra"), *[F.round(F.col(k) / total, 6).alias(f"share_{k}") for k in SPLIT_SHARES])


@registry.query("""
WITH best AS (
  SELECT molecule_id, key, score, mass_error_ppm, row_number() OVER (PARTITION BY molecule_id, key ORDER BY score DESC, mass_error_ppm) AS r
  FROM candidates WHERE score IS NOT NULL AND NOT isnan(score)
), placed AS (
  SELECT molecule_id, key, row_number() OVER (PARTITION BY molecule_id ORDER BY score DESC, mass_error_ppm, key) AS place FROM best WHERE r = 1
)
SELECT molecule_id, key, place FROM placed WHERE place <= 10""")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    candidates = load(spark, folder, "candidates", "molecule_id", "key", "score", "mass_error_ppm")
    return top_n_per_group(candidates, "molecule_id", "key", "score", "mass_error_ppm", 10).select("molecule_id", "key", "place")


@registry.query()
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    documents = load(spark, folder, "documents", "doc_id", "text")
    return documents.select("doc_id", bpe_ids(spark, F.col("text")).alias("ids"))


@registry.query()
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return quoted_items(load(spark, folder, "documents", "doc_id", "text"), load(spark, folder, "eval_items", "item_id", "text"))


@registry.query()
def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which items leaked, and into how many documents."""
    found = quoted_items(load(spark, folder, "documents", "doc_id", "text"), load(spark, folder, "eval_items", "item_id", "text"))
    return load(spark, folder, "eval_items", "item_id", "split").join(found, "item_id").groupBy("item_id", "split").agg(F.count("*").alias("documents"))


@registry.query()
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(load(spark, folder, "documents", "doc_id", "source", "text")).select("doc_id")


@registry.query()
def p10_sources(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source truncates."""
    return truncation_by_source(load(spark, folder, "documents", "doc_id", "source", "text"))

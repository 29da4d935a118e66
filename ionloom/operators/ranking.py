"""Ranking candidates and measuring the ranks of the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.operators.dedupe import keep_first
from ionloom.operators.ppm import ppm_join
from ionloom.operators.skew import salted_join

TOP = 25


def rank_per_query(scored: DataFrame, query: str, key: str, *order: Column) -> DataFrame:
    """``scored`` with the best row of each key, and its place among the query's keys; all candidates are kept."""
    best = keep_first(scored, [query, key], *order)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)).cast("bigint"))


def truth_ranks(ranked: DataFrame, query: str, is_truth: Column) -> DataFrame:
    """(query, rank, n_candidates): the first place of the truth, NULL if it isn't there."""
    return ranked.groupBy(query).agg(F.min(F.when(is_truth, F.col("rank"))).alias("rank"), F.count("*").alias("n_candidates"))


def rank_metrics(ranks: DataFrame, *by: str, top: int = TOP) -> DataFrame:
    """MRR@top, top-1, top-5, top-``top`` rates, and the MRR of a random order, per group ``by``."""
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return ranks.groupBy(*by).agg(
        F.avg(F.coalesce(F.when(F.col("rank") <= top, 1 / F.col("rank")), F.lit(0.0))).alias("mrr"),
        rate(F.col("rank") <= 1).alias("top1"),
        rate(F.col("rank") <= 5).alias("top5"),
        rate(F.col("rank") <= top).alias(f"top{top}"),
        F.avg(random_mrr(F.col("n_candidates"), F.col("rank").isNotNull(), top)).alias("random_mrr"),
        F.count("*").alias("n_queries"),
    )


def random_mrr(n: Column, present: Column, top: int = TOP) -> Column:
    """Expected reciprocal rank of a truth at a random place among ``n``: the harmonic number of min(top, n), over n."""
    harmonic = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.lit(top), n), F.lit(1)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / r)
    return F.when(present & (n > 0), harmonic / n).otherwise(0.0)


def submission(ranked: DataFrame, query: str, value: str, top: int = TOP) -> DataFrame:
    """(query, value): the values of the first ``top`` places joined by semicolons, best first."""
    first = ranked.where(F.col("rank") <= top)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda s: s[value]), ";")
    return first.groupBy(query).agg(joined.alias(value))


def mean_of_max(scores: DataFrame, spectra: DataFrame, query: str, spectrum: str, candidate: str, score: str) -> DataFrame:
    """(query, candidate, score): the best score of each query spectrum, averaged over all spectra of the query.

    A spectrum without a score counts 0, and no best is below 0.
    """
    best = scores.groupBy(query, spectrum, candidate).agg(F.greatest(F.max(score), F.lit(0.0)).alias("b")).groupBy(query, candidate).agg(F.sum("b").alias("s"))
    counts = spectra.groupBy(query).agg(F.count("*").alias("n"))
    return best.join(counts, query).select(query, candidate, (F.col("s") / F.col("n")).alias(score))


def comparable(pairs: DataFrame, keys: list[str], exact: Column, fallback: Column) -> DataFrame:
    """Rows that meet ``exact``; for keys without any such row, those that meet ``fallback``."""
    flagged = pairs.withColumn("__exact", F.coalesce(exact, F.lit(False))).where(F.col("__exact") | F.coalesce(fallback, F.lit(False)))
    any_exact = F.max("__exact").over(Window.partitionBy(*keys))
    return flagged.withColumn("__any", any_exact).where(F.col("__exact") == F.col("__any")).drop("__exact", "__any")


def comparable_setups(asked: DataFrame, spectra: DataFrame, same: str) -> DataFrame:
    """``asked`` (q, key, adduct, mode, energy, ...) with the ``setup`` of the library spectra that each is compared with.

    Those of the same adduct and energy if the key has any, else those of the same ``same`` ('mode' or 'adduct'). The
    choice is made on the distinct setups of a key, a few rows, never on its spectra. Library rows are marked by
    :func:`setup_of`.
    """
    setups = spectra.select("key", "o_adduct", "o_mode", "o_energy", setup_of().alias("setup")).distinct()
    pairs = salted_join(asked, setups, "key")
    exact = (F.col("adduct") == F.col("o_adduct")) & (F.col("energy") == F.col("o_energy"))
    return comparable(pairs, ["q", "key"], exact, F.col(same) == F.col("o_" + same)).drop("o_adduct", "o_mode", "o_energy")


def setup_of() -> Column:
    """The key, adduct, mode and energy of a library spectrum as one join key."""
    return F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("?")) for c in ("key", "o_adduct", "o_mode", "o_energy")])


def rank_library(queries: DataFrame, library: DataFrame, scorers: dict, *, ppm: float = 10.0) -> DataFrame:
    """(query, key, scorer, score, rank): the library's structures (key, mass, bits) in the mass window of each query (query, mass_q, p), best first.

    Every scorer (p, bits) -> score ranks for itself; of several structures of a key the best counts, ties go to the
    smaller key. A query without structures in its window has no row. Vectors are dropped once the scores are there.
    """
    pairs = ppm_join(queries.select("query", "mass_q", "p"), library.select("key", "mass", "bits"), "mass_q", "mass", ppm)
    scored = pairs.select("query", "key", F.explode(F.array(*[F.struct(F.lit(n).alias("scorer"), F.round(f(F.col("p"), F.col("bits")), 9).alias("score")) for n, f in scorers.items()])).alias("s")).select("query", "key", "s.*")
    best = scored.groupBy("query", "key", "scorer").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query", "scorer").orderBy(F.desc("score"), "key")).cast("bigint"))


def rank_queries(queries: DataFrame, library: DataFrame, scorers: dict, *, ppm: float = 10.0) -> DataFrame:
    """``queries`` (query, true_key, mass_q, p, ...) with rank_<scorer> of the true key, NULL if it isn't a candidate, and n_candidates."""
    ranked = rank_library(queries, library, scorers, ppm=ppm).join(queries.select("query", "true_key"), "query")
    place = lambda s: F.min(F.when((F.col("scorer") == s) & (F.col("key") == F.col("true_key")), F.col("rank"))).alias(f"rank_{s}")
    first = next(iter(scorers))
    found = ranked.groupBy("query").agg(*[place(s) for s in scorers], F.count_if(F.col("scorer") == first).alias("n_candidates"))
    return queries.drop("p").join(found, "query", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))


def in_batch_metrics(slots: DataFrame, query: str, score: str, is_truth: Column) -> DataFrame:
    """(queries, ranking_loss, top1, mrr) over the slots of each query: its truth and its decoys; padded slots have no score.

    The rank is one more than the number of decoys that score strictly higher; the loss is that of choosing the truth by
    softmax, averaged over the queries with a decoy.
    """
    truth = F.max(F.when(is_truth, F.col(score)))
    top = slots.groupBy(query).agg(truth.alias("__t"), F.max(score).alias("__m"), F.count_if(~is_truth & F.col(score).isNotNull()).alias("__d"))
    per = slots.join(top, query).where("__t is not null").groupBy(query, "__t", "__m", "__d").agg((F.count_if(~is_truth & (F.col(score) > F.col("__t"))) + 1).alias("r"), F.sum(F.exp(F.col(score) - F.col("__m"))).alias("e"))
    loss = F.when(F.col("__d") > 0, F.col("__m") + F.ln("e") - F.col("__t"))
    return per.agg(F.count("*").alias("queries"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("ranking_loss"), F.avg((F.col("r") == 1).cast("double")).alias("top1"), F.avg(1 / F.col("r")).alias("mrr"))

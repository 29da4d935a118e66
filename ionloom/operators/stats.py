"""Statistics of similarities: separation, correlation, histograms, principal components, paired differences."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.session import cut


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the average rank of ``value`` (equal values share it), by way of counts per distinct value.

    Counts are summed up over ranges of values first, so no task sorts them all.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("__n"))
    low, high = counts.agg(F.min(value), F.max(value)).first()
    width = ((high or 0) - (low or 0)) / 1024 or 1.0
    celled = counts.withColumn("__cell", F.floor((F.col(value) - F.lit(low or 0.0)) / F.lit(width)))
    cells = celled.groupBy("__cell").agg(F.sum("__n").alias("__c"))  # at most 1,025 rows
    before = cells.select("__cell", (F.sum("__c").over(Window.orderBy("__cell")) - F.col("__c")).alias("__before"))
    upto = F.sum("__n").over(Window.partitionBy("__cell").orderBy(value))
    ranks = celled.join(F.broadcast(before), "__cell").select(F.col(value).alias("__v"), (F.col("__before") + upto - (F.col("__n") - 1) / 2).alias(name))
    return df.join(ranks, F.col(value) == F.col("__v")).drop("__v")


def roc_auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """(auc, n_positive, n_negative): the share of (positive, negative) pairs in the right order, ties a half."""
    flagged = cut(df.where(F.col(score).isNotNull() & positive.isNotNull()).select(score, positive.cast("int").alias("__p")))
    ranked = average_ranks(flagged, score, "__rank")
    sums = ranked.agg(F.sum("__p").alias("n1"), F.sum(1 - F.col("__p")).alias("n0"), F.sum(F.col("__rank") * F.col("__p")).alias("r1"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    return sums.select(F.try_divide(F.col("r1") - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"), F.col("n1").alias("n_positive"), F.col("n0").alias("n_negative"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = cut(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b))
    return average_ranks(cut(average_ranks(both, a, "__ra")), b, "__rb").agg(F.corr("__ra", "__rb").alias("spearman"), F.count("*").alias("n"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, *by: str, log: bool = False) -> DataFrame:
    """(by, bin, n): values in [low, high) by equal widths (``log``: equal ratios; ``low`` above 0); others are left out."""
    kept = df.withColumn("__x", value).where((F.col("__x") >= low) & (F.col("__x") < high))
    place = F.ln(F.col("__x") / low) / (math.log(high / low) / bins) if log else (F.col("__x") - low) / ((high - low) / bins)
    return kept.withColumn("bin", F.least(F.floor(place), F.lit(bins - 1)).cast("bigint")).groupBy(*by, "bin").agg(F.count("*").alias("n"))


def densities(counts: DataFrame, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """Counts of :func:`histogram` with ``density``: the share of a group's values over the width of the bin."""
    total = counts.groupBy(*by).agg(F.sum("n").alias("__t")) if by else counts.agg(F.sum("n").alias("__t"))
    joined = counts.join(total, list(by)) if by else counts.join(F.broadcast(total))
    return joined.withColumn("density", F.col("n") / F.col("__t") / ((high - low) / bins)).drop("__t")


def pairs_within(df: DataFrame, group: str, ident: str, cap: int, order: Column) -> DataFrame:
    """(group, a, b): pairs a < b of the first ``cap`` members of every group by ``order``: at most cap^2/2 a group."""
    members = df.where(F.col(group).isNotNull()).select(group, ident, order.alias("__o"))
    kept = members.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy("__o", ident))).where(F.col("__r") <= cap).select(group, ident)
    return kept.select(group, F.col(ident).alias("a")).join(kept.select(group, F.col(ident).alias("b")), group).where("a < b")


def mean_vector(df: DataFrame, vector: str, *by: str) -> DataFrame:
    """(by, dim, mean): the element-wise mean of vectors; null vectors count nowhere.

    Vectors are added up in Arrow batches (without ``by``, in whole tasks) before one row a number is made of the sums.
    """
    rows = df.where(F.col(vector).isNotNull()).select(*by, F.col(vector).cast("array<double>").alias("__v"))
    kinds = dict(rows.dtypes)

    def partial(batches):
        n, s = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            flat = np.asarray(b.column(len(by)).flatten().to_numpy(zero_copy_only=False), dtype=float)
            x = flat.reshape(b.num_rows, -1)
            if not by:
                n, s = n + len(x), x.sum(axis=0) + (0 if s is None else s)
                continue
            code = pa.Table.from_batches([b]).select(list(by)).to_pandas().groupby(list(by), sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            _, start, count = np.unique(code[order], return_index=True, return_counts=True)
            sums = np.add.reduceat(x[order], start, axis=0)
            first = pa.array(order[start])
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(first) for i in range(len(by))], pa.array(count.astype(np.int64)), _lists(sums)], names=[*by, "__n", "__s"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], type=pa.int64()), _lists(s[None])], names=["__n", "__s"])

    parts = rows.mapInArrow(partial, "".join(f"`{c}` {kinds[c]}, " for c in by) + "__n bigint, __s array<double>")
    long = parts.select(*by, "__n", F.posexplode("__s").alias("dim", "__x"))
    return long.groupBy(*by, "dim").agg((F.sum("__x") / F.sum("__n")).alias("mean"))


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def quantiles(df: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """(by, n, <names of shares>): exact quantiles with linear interpolation between neighbours; null and NaN values count nowhere.

    Counts per distinct value are summed up over 1,024 ranges of values a group first, so no task sorts or holds a group.
    """
    keys = list(by) or ["__all"]
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("__v", F.col(value).cast("double"))
    rows = rows if by else rows.withColumn("__all", F.lit(0))
    safe = [F.col(k).eqNullSafe(F.col("__s." + k)) for k in keys]
    counts = rows.groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    spans = counts.groupBy(*keys).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.sum("__n").alias("n")).select(F.struct(*keys).alias("__s"), "__low", "__high", "n")
    width = (F.col("__high") - F.col("__low")) / 1024
    celled = counts.join(spans, _all(safe)).drop("__s").withColumn("__cell", F.when(width > 0, F.floor((F.col("__v") - F.col("__low")) / width)).otherwise(F.lit(0)))
    cells = celled.groupBy(*keys, "__cell").agg(F.sum("__n").alias("__c"))
    before = cells.select(F.struct(*keys).alias("__s"), F.col("__cell").alias("__k"), (F.sum("__c").over(Window.partitionBy(*keys).orderBy("__cell")) - F.col("__c")).alias("__before"))
    upto = F.col("__before") + F.sum("__n").over(Window.partitionBy(*keys, "__cell").orderBy("__v"))
    ranked = celled.join(before, _all([*safe, F.col("__cell") == F.col("__k")])).drop("__s", "__k").withColumn("__upto", upto)
    at = lambda rank: F.max(F.when((F.col("__upto") - F.col("__n") <= rank) & (rank < F.col("__upto")), F.col("__v")))
    found = []
    for name, q in shares.items():
        place = (F.col("n") - 1) * F.lit(float(q))
        found += [at(F.floor(place)).alias("__lo_" + name), at(F.ceil(place)).alias("__hi_" + name)]
    out = ranked.groupBy(*keys, "n").agg(*found)
    linear = lambda name, q: (F.col("__lo_" + name) + (F.col("__hi_" + name) - F.col("__lo_" + name)) * ((F.col("n") - 1) * F.lit(float(q)) - F.floor((F.col("n") - 1) * F.lit(float(q))))).alias(name)
    return out.select(*by, "n", *[linear(name, q) for name, q in shares.items()])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def covariance(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance, rows): from partial Gram matrices, one a task; only those are sent to the driver (width^2 each, merged in a tree)."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))

    def partial(frames):
        n, s, g = 0, None, None
        for frame in frames:
            x = np.stack(frame["v"].to_numpy()) if len(frame) else None
            if x is None:
                continue
            n, s, g = n + len(x), x.sum(axis=0) + (0 if s is None else s), x.T @ x + (0 if g is None else g)
        if n:
            import pandas as pd

            yield pd.DataFrame({"n": [n], "s": [s.tobytes()], "g": [g.tobytes()]})

    def merge(frame):
        import pandas as pd

        add = lambda c: np.sum([np.frombuffer(x) for x in frame[c]], axis=0).tobytes()
        return pd.DataFrame({"n": [int(frame["n"].sum())], "s": [add("s")], "g": [add("g")]})

    parts = rows.mapInPandas(partial, "n bigint, s binary, g binary")
    tree = parts.withColumn("k", F.spark_partition_id() % 16).groupBy("k").applyInPandas(merge, "n bigint, s binary, g binary").toPandas()
    if not len(tree):
        return np.zeros(0), np.zeros((0, 0)), 0
    n = int(tree["n"].sum())
    s = np.sum([np.frombuffer(x) for x in tree["s"]], axis=0)
    g = np.sum([np.frombuffer(x) for x in tree["g"]], axis=0).reshape(len(s), len(s))
    mean = s / n
    return mean, (g - n * np.outer(mean, mean)) / max(1, n - 1), n


def principal_components(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, components, explained variance, total variance) of the first ``k`` components."""
    mean, cov, _ = covariance(df, vector)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    return mean, vectors[:, order].T, values[order], float(np.trace(cov))


def project(df: DataFrame, vector: str, mean: np.ndarray, components: np.ndarray, name: str, scale: float = 1.0) -> DataFrame:
    """``df`` with the centred projection of ``vector``; a missing vector gives zeros after the projection."""

    @F.pandas_udf("array<double>")
    def go(column):
        import pandas as pd

        known = column.notna().to_numpy()
        out = np.zeros((len(column), len(components)))
        if known.any():
            out[known] = (np.stack(column[known].to_numpy()).astype(float) - mean) @ components.T * scale
        return pd.Series(list(out))

    return df.withColumn(name, go(F.col(vector)))


def paired_difference(df: DataFrame, old: Column, new: Column, *by: str) -> DataFrame:
    """Mean difference, its standard error, and how many got better or worse."""
    d = df.withColumn("__d", new - old)
    return d.groupBy(*by).agg(F.avg("__d").alias("mean_difference"), (F.stddev_samp("__d") / F.sqrt(F.count("__d"))).alias("standard_error"), F.count_if(F.col("__d") > 0).alias("better"), F.count_if(F.col("__d") < 0).alias("worse"))


def mean_vectors(df: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, n, v): the element-wise mean of each key's vectors as one array, and their number; null keys and vectors count nowhere.

    Vectors are added up in Arrow batches before the shuffle and, in order of the key, after it.
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, F.lit(1).cast("bigint").alias("__n"), F.col(vector).cast("array<double>").alias("__s"))
    schema = f"`{key}` {dict(rows.dtypes)[key]}, __n bigint, __s array<double>"

    def added(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        codes = b.column(0).dictionary_encode()
        order = np.argsort(codes.indices.to_numpy(), kind="stable")
        _, start = np.unique(codes.indices.to_numpy()[order], return_index=True)
        x = np.asarray(b.column(2).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(b.num_rows, -1)
        return codes.dictionary, np.add.reduceat(b.column(1).to_numpy()[order], start), np.add.reduceat(x[order], start, axis=0)

    def partial(batches):
        for b in batches:
            if b.num_rows:
                k, n, s = added(b)
                yield pa.RecordBatch.from_arrays([k, pa.array(n), _lists(s)], names=[key, "__n", "__s"])

    def merged(batches):
        held = None
        out = lambda k, n, s: pa.RecordBatch.from_arrays([k, pa.array(n), _lists(s / n[:, None])], names=[key, "n", "v"])
        for b in batches:
            if not b.num_rows:
                continue
            k, n, s = added(b)  # in order of the key
            if held is not None and held[0][0] == k[0]:
                n[0], s[0] = n[0] + held[1][0], s[0] + held[2][0]
            elif held is not None:
                yield out(*held)
            if len(k) > 1:
                yield out(k[:-1], n[:-1], s[:-1])
            held = k[-1:], n[-1:], s[-1:]
        if held is not None:
            yield out(*held)

    parts = rows.mapInArrow(partial, schema).repartition(key).sortWithinPartitions(key)
    return parts.mapInArrow(merged, schema.replace("__n", "n").replace("__s", "v"))


def _summed(rows: dict) -> dict:
    """One row for each key and half, in order of the keys' first rows."""
    keys = rows["key"].dictionary_encode()
    code = keys.indices.to_numpy().astype(np.int64) * 2 + rows["h"]
    order = np.argsort(code, kind="stable")
    found, start = np.unique(code[order], return_index=True)
    sums = {c: np.add.reduceat(rows[c][order], start, axis=0) for c in ("n", "m", "known", "s")}
    return {"key": keys.dictionary.take(pa.array(found // 2)), "h": found % 2, **sums}


def _some_lists(x: np.ndarray, at: np.ndarray, n: int) -> pa.ListArray:
    """``n`` lists: row i of ``x`` at place at[i], NULL elsewhere."""
    size = np.zeros(n, dtype=np.int32)
    size[at] = x.shape[1]
    missing = np.ones(n, dtype=bool)
    missing[at] = False
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(x.ravel()), mask=pa.array(missing))


def bits_and_means(df: DataFrame, value) -> DataFrame:
    """(key, bits, n, m, p), a row a key: the signs of the mean unit vector of its rows of half 0 (1 above 0), and of those of half 1 their number, the mean of ``m`` and of ``value`` of the unit vectors.

    ``df`` (key, h, m, e): key, half (0 or 1), number and vector; rows without key, half or length count nowhere, nor does a vector that lacks an entry.
    ``value`` maps an array of unit vectors to one of that shape. Both halves take one pass: rows are added up in Arrow batches before the shuffle and, in order of the key, after it.
    """
    rows = df.where(F.size("e") > 0).select("key", F.col("h").cast("int").alias("h"), F.col("m").cast("double").alias("m"), "e")
    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, h int, n bigint, m double, known bigint, s array<double>"
    columns = ("key", "h", "n", "m", "known")

    def partial(batches):
        for b in batches:
            # here and not in a filter, which Spark would push below a join and evaluate on more rows
            b = b.filter(pc.and_(b.column(0).is_valid(), b.column(1).is_valid()))
            e = b.column(3).flatten()
            x = np.asarray(e.to_numpy(zero_copy_only=False), dtype=float)
            if not len(x):
                continue
            x = x.reshape(b.num_rows, -1)
            length = np.sqrt(np.cumsum(x * x, axis=1)[:, -1])
            live = ~(length <= 0)
            if e.null_count:
                live &= ~np.asarray(e.is_null().to_numpy(zero_copy_only=False)).reshape(x.shape).any(axis=1)
            x, b = x[live] / length[live, None], b.filter(pa.array(live))
            if not len(x):
                continue
            h, m = b.column(1).to_numpy(), b.column(2)
            x[h == 1] = value(x[h == 1])
            got = _summed({"key": b.column(0), "h": h, "n": np.ones(len(x), dtype=np.int64), "m": m.fill_null(0.0).to_numpy(), "known": np.asarray(m.is_valid().to_numpy(zero_copy_only=False), dtype=np.int64), "s": x})
            yield pa.RecordBatch.from_arrays([got["key"], pa.array(got["h"], pa.int32()), *[pa.array(got[c]) for c in columns[2:]], _lists(got["s"])], names=[*columns, "s"])

    def out(rows: dict) -> pa.RecordBatch:
        keys = rows["key"].dictionary_encode()
        at, n = keys.indices.to_numpy(), len(keys.dictionary)
        mean = rows["s"] / rows["n"][:, None]
        zero, one = rows["h"] == 0, rows["h"] == 1
        count, m = np.zeros(n, dtype=np.int64), np.full(n, np.nan)
        count[at[one]] = rows["n"][one]
        known = one & (rows["known"] > 0)
        m[at[known]] = rows["m"][known] / rows["known"][known]
        unknown = np.ones(n, dtype=bool)
        unknown[at[known]] = False
        bits = (~(mean[zero] <= 0)).astype(np.int8)
        return pa.RecordBatch.from_arrays([keys.dictionary, _some_lists(bits, at[zero], n), pa.array(count, mask=count == 0), pa.array(m, mask=unknown), _some_lists(mean[one], at[one], n)], names=["key", "bits", "n", "m", "p"])

    def merged(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            s = b.column(5).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            rows = {"key": b.column(0), **{c: b.column(i).to_numpy() for i, c in enumerate(columns) if i}, "s": s}
            if held is not None:
                rows = {c: pa.concat_arrays([held[c], rows[c]]) if c == "key" else np.concatenate([held[c], rows[c]]) for c in rows}
            rows = _summed(rows)
            done = len(rows["h"]) - (2 if len(rows["h"]) > 1 and rows["key"][-2] == rows["key"][-1] else 1)  # the last key may go on
            if done:
                yield out({c: v[:done] for c, v in rows.items()})
            held = {c: v[done:] for c, v in rows.items()}
        if held is not None:
            yield out(held)

    parts = rows.mapInArrow(partial, schema).repartition("key").sortWithinPartitions("key")
    return parts.mapInArrow(merged, f"key {kind}, bits array<tinyint>, n bigint, m double, p array<double>")

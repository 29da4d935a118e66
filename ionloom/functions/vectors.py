"""Vectors and bit words as array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionloom.functions.binding import let

EPSILON = 1e-6


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """``v`` over its length; NULL for a zero vector."""
    return let(lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])), v=v, n=norm(v))


def cosine_of_units(a: Column, b: Column) -> Column:
    """Dot product, 0 where it is negative or a vector is missing."""
    return F.greatest(F.coalesce(dot(a, b), F.lit(0.0)), F.lit(0.0))


def euclidean(similarity: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(2.0) - 2 * similarity, F.lit(0.0)))


def angular(similarity: Column) -> Column:
    """Angle over pi."""
    return F.acos(F.least(F.greatest(similarity, F.lit(-1.0)), F.lit(1.0))) / F.lit(math.pi)


def embedding_columns(unit_vector: Column, width: int, scale: float) -> Column:
    """``width`` numbers times ``scale`` and a flag behind them; a missing vector gives zeros and 0."""
    known = F.concat(F.transform(unit_vector, lambda x: x * scale), F.array(F.lit(1.0)))
    return F.coalesce(known, F.array_repeat(F.lit(0.0), width + 1))


def sigmoid(v: Column, scale: float = 1.0) -> Column:
    return F.transform(v, lambda x: 1.0 / (1.0 + F.exp(-scale * x)))


def likelihood(p: Column, bits: Column) -> Column:
    """Sum over set bits of the log odds, probabilities clipped to EPSILON."""
    return total(F.zip_with(p, bits, lambda x, b: b * (F.ln(F.greatest(F.least(x, F.lit(1 - EPSILON)), F.lit(EPSILON))) - F.ln(1 - F.greatest(F.least(x, F.lit(1 - EPSILON)), F.lit(EPSILON))))))


def soft_tanimoto(p: Column, bits: Column) -> Column:
    common = dot(p, bits)
    return F.try_divide(common, total(p) + total(bits) - common)


def dot_over_root(p: Column, bits: Column) -> Column:
    return dot(p, bits) / F.sqrt(F.greatest(total(bits), F.lit(1.0)))


def mean_entropy(p: Column) -> Column:
    """Mean over entries of the binary entropy in bits."""
    tiny = 1e-10
    return total(F.transform(p, lambda x: -x * F.log2(x + tiny) - (1 - x) * F.log2(1 - x + tiny))) / F.size(p)


def sign_words(v: Column, bits: int = 32) -> Column:
    """array<bigint>: the signs of ``v``, ``bits`` of them a word, the first entry the highest bit."""
    words = F.sequence(F.lit(0), F.ceil(F.size(v) / bits).cast("int") - 1)
    return F.transform(words, lambda w: F.aggregate(F.slice(v, w * bits + 1, bits), F.lit(0).cast("bigint"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0)))


def bit_tanimoto(a: Column, b: Column) -> Column:
    """Common bits over all bits of two word arrays; 0 if no bit is set."""
    count = lambda ws: F.aggregate(ws, F.lit(0), lambda s, w: s + F.bit_count(w))
    common = count(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    either = count(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    return common / F.greatest(either, F.lit(1))


#: Scorers by name: (predicted probabilities, bits) -> score.
SCORERS = {"likelihood": likelihood, "tanimoto": soft_tanimoto, "dot": dot, "dot_over_root": dot_over_root}

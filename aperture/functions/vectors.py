"""Expressions and grouped means over ARRAY columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def bound(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body uses it: an expression within a lambda is else computed for each element."""
    return F.transform(F.array(value), body)[0]


def _by_norm(a: Column, guard) -> Column:
    return bound(a, lambda v: bound(guard(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def unit(a: Column) -> Column:
    """Rows of an embedding table: x / max(|x|, 1e-12)."""
    return _by_norm(a, lambda n: F.greatest(n, F.lit(1e-12)))


def unit_class(a: Column) -> Column:
    """Class vectors: x / (|x| + 1e-8), another form of guard than that of rows."""
    return _by_norm(a, lambda n: n + F.lit(1e-8))


def mean_by(df: DataFrame, keys: list[str], vector: str, into: str) -> DataFrame:
    """The mean vector of each group, one buffer of running means a group in each task (Spark ML's summarizer); null vectors are left out.

    Vectors of a group must be of one length, or the query fails.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    some = df.where(F.col(vector).isNotNull()).select(*keys, array_to_vector(F.col(vector)).alias("__v"))
    return some.groupBy(*keys).agg(Summarizer.mean(F.col("__v")).alias("__m")).select(*keys, vector_to_array("__m").alias(into))


def shift(a: Column, b: Column) -> dict[str, Column]:
    """How far a second vector is from a first: cosine, relative distance, ratio of norms, mean absolute difference."""
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return {"cosine": dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12)), "relative_l2": norm(gap) / F.greatest(norm(a), F.lit(1e-12)), "norm_ratio": norm(b) / F.greatest(norm(a), F.lit(1e-12)), "mean_abs": F.aggregate(gap, F.lit(0.0), lambda s, x: s + F.abs(x)) / F.size(a)}

"""Sums over the rows before each row, in two levels, so that no key's rows meet in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, into: str) -> DataFrame:
    """Sum of `value` over the rows before each row of its key, ordered by bucket then `order`.

    Sums of buckets (few rows) are accumulated first, then rows within a bucket, so that a key that
    holds most rows is still spread over its buckets. Without keys all rows are one key.
    """
    parts = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__part"))
    key = [F.col(k) for k in keys] or [F.lit(0)]
    before = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(bucket).alias("__b"), F.coalesce(F.sum("__part").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = reduce(lambda a, b: a & b, [*[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col(bucket).eqNullSafe(F.col("__b"))])
    out = df.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(parts, on, "left")
    return out.withColumn(into, F.col("__own") + F.col("__base")).drop("__own", "__base", "__b", *[f"__{k}" for k in keys])

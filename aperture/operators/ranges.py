"""Sums, ranks and quantiles in a sorted order, whatever the values and however uneven the keys.

Rows are dealt to ranges of (keys, value) whose borders Spark samples, so ranges hold about as many rows each: an outlier changes
nothing, a key of most rows covers many ranges and small keys share one. The dealt rows are written once, for a
second pass must meet the same ranges. Sums of ranges (a row for each range and key in it) carry over from one to the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aperture.sources.shared import Scratch

PART = "__part"


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`df` with the number of its range; in the order of the keys, then of `order`."""
    return Scratch(df.sparkSession, "ranges").table(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), "rows")


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(PART) == F.col("__p2"), *[F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]])


def _by(keys: list[str]):
    return Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])


def _renamed(parts: DataFrame, keys: list[str], more: list[Column]) -> DataFrame:
    return parts.select(F.col(PART).alias("__p2"), *[F.col(k).alias(f"__k_{k}") for k in keys], *more)


def before(t: DataFrame, keys: list[str], order: list[str], into: dict[str, str], desc: bool = False) -> DataFrame:
    """`t` of dealt() with sums of columns (result: column) over the rows of its key that come before each, in the order or against it."""
    sums = t.groupBy(PART, *keys).agg(*[F.sum(c).alias(f"__s_{n}") for n, c in into.items()])
    w = _by(keys).orderBy(F.desc(PART) if desc else F.asc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    base = _renamed(sums, keys, [F.coalesce(F.sum(f"__s_{n}").over(w), F.lit(0)).alias(f"__b_{n}") for n in into])
    inside = Window.partitionBy(PART, *keys).orderBy(*[F.desc(o) if desc else F.asc(o) for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    own = t.withColumns({f"__o_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in into.items()})
    out = own.join(base, _same(keys)).withColumns({n: F.col(f"__o_{n}") + F.col(f"__b_{n}") for n in into})
    return out.drop("__p2", *[f"__k_{k}" for k in keys], *[f"__{x}_{n}" for n in into for x in "ob"])


def numbered(df: DataFrame, keys: list[str], order: list[str], into: str) -> DataFrame:
    """`df` with its place (0, 1, ...) among the rows of its key in the order; equal rows of the order are told apart by chance."""
    t = dealt(df.withColumn("__one", F.lit(1).cast("bigint")), keys, order)
    return before(t, keys, order, {into: "__one"}).drop("__one", PART)


def neighbours(t: DataFrame, keys: list[str], order: str, columns: list[str], desc: bool = False) -> DataFrame:
    """`t` of dealt() with {column}_lag and {column}_lead: the column in the row of its key before and after, also over the borders of ranges; orders differ."""
    sort = F.desc if desc else F.asc
    row = F.struct(*columns)
    ends = t.groupBy(PART, *keys).agg(*[(f(row, order)).alias(n) for n, f in (("__first", F.max_by if desc else F.min_by), ("__last", F.min_by if desc else F.max_by))])
    w = _by(keys).orderBy(sort(PART))
    ends = _renamed(ends, keys, [F.lag("__last").over(w).alias("__prev"), F.lead("__first").over(w).alias("__next")])
    inside = Window.partitionBy(PART, *keys).orderBy(sort(order))
    out = t.withColumns({f"{c}_{n}": f(c).over(inside) for c in columns for n, f in (("lag", F.lag), ("lead", F.lead))}).join(ends, _same(keys))
    out = out.withColumns({f"{c}_{n}": F.coalesce(F.col(f"{c}_{n}"), F.col(f"{e}.{c}")) for c in columns for n, e in (("lag", "__prev"), ("lead", "__next"))})
    return out.drop("__p2", "__prev", "__next", *[f"__k_{k}" for k in keys])


def quantiles(df: DataFrame, value: str, of: dict[str, float], keys: list[str] = ()) -> DataFrame:
    """(keys, names) of exact quantiles (name: share) of a number by key, interpolated between neighbours; null values are left out, as is a key that has no others.

    Values are counted first, so that what is dealt are different values; each range then knows which of the wanted ranks it holds.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    t = before(dealt(counts, keys, ["__v"]), keys, ["__v"], {"__lo": "__c"})
    totals = t.groupBy(*keys).agg(F.sum("__c").alias("__n")).select(*[F.col(k).alias(f"__t_{k}") for k in keys], "__n").where("__n > 0")
    t = t.join(totals, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__t_{k}")) for k in keys])) if keys else t.join(F.broadcast(totals))
    place = lambda q: F.lit(q) * (F.col("__n") - 1)
    at = lambda rank: F.max(F.when((F.col("__lo") <= rank) & (rank < F.col("__lo") + F.col("__c")), F.col("__v")))
    found = t.groupBy(*keys).agg(F.max("__n").alias("__n"), *[at(f(place(q))).alias(f"__{n}_{x}") for n, q in of.items() for x, f in (("a", F.floor), ("b", F.ceil))]).where("__n is not null")
    part = lambda q: place(q) - F.floor(place(q))
    between = lambda n, q: F.when(part(q) == 0, F.col(f"__{n}_a")).otherwise(F.col(f"__{n}_a") * (1 - part(q)) + F.col(f"__{n}_b") * part(q))
    return found.select(*keys, *[between(n, q).alias(n) for n, q in of.items()])

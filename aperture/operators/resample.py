"""Cluster bootstraps, paired comparisons, Holm's correction, Wilcoxon's test, splits.

A replicate is a table of (rep, cluster, weight): how often each cluster was drawn. Rows carry weights
instead of being copied, and draws are digests of their numbers, so any task can make them.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from aperture.operators import ranges as R
from aperture.operators.prefix import running_sum


def digest(c: Column) -> Column:
    """A 60-bit number of a text, the same in other engines."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint")


def cluster_draws(df: DataFrame, cluster_col: str, reps: int, seed: str = "b") -> DataFrame:
    """(rep, cluster, weight): n clusters drawn with replacement from the n sorted ones. The unit of resampling has no default.

    Clusters are numbered over sampled ranges of their ids, so that rows can be the units too.
    """
    ids = R.numbered(df.select(F.col(cluster_col).cast("string").alias("cluster")).distinct(), [], ["cluster"], "ix")
    n = ids.count()
    spark = df.sparkSession
    draws = spark.range(reps * n).select(F.floor(F.col("id") / n).cast("int").alias("rep"), F.pmod(digest(F.concat(F.lit(seed), F.col("id").cast("string"))), F.lit(n)).alias("d"))
    draws = draws.groupBy("rep", "d").agg(F.count("*").alias("weight"))
    return draws.join(ids, F.col("d") == F.col("ix")).select("rep", "cluster", "weight")


def interval(df: DataFrame, stat: str, *keys: str, alpha: float = 0.05) -> DataFrame:
    """The percentile interval over replicates; undefined ones are left out."""
    x = F.when(F.abs(stat) < float("inf"), F.col(stat))
    q = F.percentile(x, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return df.groupBy(*keys).agg(q.alias("q"), F.count(x).alias("n_valid")).select(*keys, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "n_valid")


def intervals(df: DataFrame, stats: list[str], *keys: str, require: str | None = None, alpha: float = 0.05) -> DataFrame:
    """{stat}_lo and {stat}_hi of several statistics over the same replicates, and n_valid; with `require` only those in which that statistic is defined."""
    fine = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))
    if require:
        df = df.where(F.abs(require) < float("inf"))
    q = F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))
    t = df.groupBy(*keys).agg(*[F.percentile(fine(c), q).alias(c) for c in stats], F.count("*").alias("n_valid"))
    return t.select(*keys, *[F.col(c)[k].alias(f"{c}_{n}") for c in stats for k, n in ((0, "lo"), (1, "hi"))], "n_valid")


def row_draws(df: DataFrame, id_col: str, reps: int, seed: str = "b") -> DataFrame:
    """Draws in which rows themselves are the units (id_col must be unique)."""
    return cluster_draws(df, id_col, reps, seed)


def paired_p(df: DataFrame, delta: str, *keys: str) -> DataFrame:
    """Interval of a difference over replicates and its two-sided p with one added; replicates without a finite difference are left out, and a group without any has no p."""
    d = F.when(F.abs(delta) < float("inf"), F.col(delta))
    n = F.count(d)
    p = F.when(n > 0, F.least(F.lit(1.0), 2 * F.least((F.count_if(d <= 0) + 1) / (n + 1), (F.count_if(d >= 0) + 1) / (n + 1))))
    return df.groupBy(*keys).agg(p.alias("p_value"), n.alias("n_valid"), F.percentile(d, F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(*keys, "p_value", "n_valid", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def holm(df: DataFrame, p: str, *keys: str, order: str) -> DataFrame:
    """Holm-Bonferroni within keys: the running maximum of (m - i) p, at most 1; rows without p are not tests and have none.

    Ranks and maxima are made in two levels over ranges of p, so that a key of very many tests is spread.
    """
    spread = df.withColumns({"__range": F.floor(F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)) * 1024), "__one": F.lit(1)})
    t = running_sum(spread.where(F.col(p).isNotNull()), list(keys), "__range", [F.col(p), F.col(order)], "__one", "__rank")
    per = [F.col(k) for k in keys] or [F.lit(0)]
    sizes = t.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    sizes = sizes.withColumn("__m", F.sum("__n").over(Window.partitionBy(*per))).drop("__n")
    both = [*keys, "__range"]
    t = t.join(sizes.withColumnsRenamed({k: f"__k_{k}" for k in both}), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in both])).drop(*[f"__k_{k}" for k in both])
    t = t.withColumn("__s", (F.col("__m") - F.col("__rank")) * F.col(p))
    tops = t.groupBy(*keys, "__range").agg(F.max("__s").alias("__t"))
    tops = tops.withColumn("__top", F.max("__t").over(Window.partitionBy(*per).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))).drop("__t")
    own = F.max("__s").over(Window.partitionBy(*keys, "__range").orderBy(p, order).rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("__own", own).join(tops.withColumnsRenamed({k: f"__k_{k}" for k in both}), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in both])).drop(*[f"__k_{k}" for k in both])
    t = t.withColumn("p_holm", F.least(F.lit(1.0), F.greatest("__own", "__top"))).select(*df.columns, "p_holm")
    return t.unionByName(df.where(F.col(p).isNull()).withColumn("p_holm", F.lit(None).cast("double")))


def stratified(df: DataFrame, id_col: str, strata: list[str], fraction: float, seed: str = "42", least: int = 2) -> DataFrame:
    """split = calibration for `fraction` of all rows, dealt to strata by largest remainders, each stratum in hash order; else holdout.

    ceil(n fraction) rows in all: a stratum has the whole part of its share, and the strata with the largest
    remainders (then the larger, then the first by name) one more. A stratum of fewer than `least` rows fails the query.
    """
    key = F.concat_ws("::", *[F.col(c).cast("string") for c in strata])
    sizes = df.groupBy(key.alias("__s")).agg(F.count("*").alias("__n"))
    sizes = sizes.withColumn("__n", F.when(F.col("__n") < least, F.raise_error(F.lit("a stratum is too small"))).otherwise(F.col("__n")))
    all_ = Window.partitionBy(F.lit(0))  # over the strata, not over rows
    total = F.sum("__n").over(all_)
    sizes = sizes.withColumn("__whole", total).withColumn("__share", F.col("__n") * F.ceil(F.col("__whole") * fraction - 1e-9) / F.col("__whole"))
    sizes = sizes.withColumn("__k", F.floor(F.col("__share") + 1e-9))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("__share") - F.col("__k"), 9)), F.desc("__n"), "__s")
    more = F.ceil(F.col("__whole") * fraction - 1e-9) - F.sum("__k").over(all_)
    sizes = sizes.withColumn("__k", F.col("__k") + (F.row_number().over(order) <= more).cast("int")).select("__s", "__k")
    t = df.withColumns({"__t": key, "__d": digest(F.concat(F.lit(seed), F.col(id_col).cast("string"))), "__one": F.lit(1)}).withColumn("__range", F.shiftright("__d", 50))
    t = running_sum(t, ["__t"], "__range", [F.col("__d"), F.col(id_col)], "__one", "__r")  # digests are even, so are their 1,024 ranges, of a large stratum too
    t = t.join(F.broadcast(sizes), F.col("__t") == F.col("__s"))
    return t.withColumn("split", F.when(F.col("__r") < F.col("__k"), "calibration").otherwise("holdout")).drop("__t", "__d", "__one", "__range", "__r", "__s", "__k")


def grouped_split(df: DataFrame, group: str, fraction: float, seed: str = "42") -> DataFrame:
    """(group, n, split): whole groups, in hash order, go to val until it has `fraction` of the rows."""
    g = df.groupBy(group).agg(F.count("*").alias("n")).withColumn("__d", digest(F.concat(F.lit(seed), F.col(group).cast("string"))))
    order = ["__d", group]
    t = R.before(R.dealt(g, [], order), [], order, {"__before": "n"})
    t = t.join(F.broadcast(t.agg(F.sum("n").alias("__all"))))
    return t.withColumn("split", F.when(F.col("__before") < fraction * F.col("__all"), "val").otherwise("train")).select(group, "n", "split")


def flat_split(df: DataFrame, id_col: str, fraction: float, seed: str = "42") -> DataFrame:
    """The first round(n f) rows in the order of digest, then id, are val.

    Rows are counted by the first 16 bits of their digests; only the rows of the one range that the cut
    falls in are ordered, so no task gathers a share of all rows.
    """
    d = digest(F.concat(F.lit(seed), F.col(id_col).cast("string")))
    t = df.withColumns({"__d": d, "__p": F.floor(d / 2**44)})
    sizes = sorted((r["__p"], r["count"]) for r in t.groupBy("__p").count().collect())  # 65,536 at most
    k, cut, left = round(sum(n for _, n in sizes) * fraction), -1, 0
    for cut, n in sizes:
        if k <= n:
            left = k
            break
        k -= n
    inside = F.row_number().over(Window.partitionBy("__p").orderBy("__d", id_col))
    edge = t.where(F.col("__p") == cut).withColumn("__r", inside)
    edge = edge.withColumn("split", F.when(F.col("__r") <= left, "val").otherwise("train")).drop("__r")
    rest = t.where(F.col("__p") != cut).withColumn("split", F.when(F.col("__p") < cut, "val").otherwise("train"))
    return rest.unionByName(edge).drop("__d", "__p")


def signed_ranks(df: DataFrame, a: str, b: str, keys: list[str] = ()) -> DataFrame:
    """(keys, n, w, zeros, ties): pairs that differ, the smaller sum of signed mid-ranks of their absolute differences, pairs that do not differ, and the sum of t^3 - t over ties of t.

    Pairs without a difference (a null on either side) are left out. Differences are counted by size and ranked over sampled ranges.
    """
    keys = list(keys)
    d = df.select(*keys, (F.col(a) - F.col(b)).alias("d")).where("d is not null")
    sizes = d.groupBy(*keys, F.abs("d").alias("m")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    some = sizes.withColumns({"c": F.when(F.col("m") != 0, F.col("c")).otherwise(0), "same": F.when(F.col("m") == 0, F.col("c")).otherwise(0)})
    t = R.before(R.dealt(some, keys, ["m"]), keys, ["m"], {"before": "c"}).withColumn("r", F.col("before") + (F.col("c") + 1) / 2.0)
    up, down = F.sum(F.col("r") * F.col("up")), F.sum(F.col("r") * (F.col("c") - F.col("up")))
    return t.groupBy(*keys).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.least(up, down).alias("w"), F.coalesce(F.sum("same"), F.lit(0)).alias("zeros"), F.coalesce(F.sum(F.pow("c", 3) - F.col("c")), F.lit(0.0)).alias("ties"))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, w): pairs that differ, and the smaller sum of signed mid-ranks of their absolute differences."""
    return signed_ranks(df, a, b).select("n", "w")


#: Up to so many pairs the distribution of the statistic is counted exactly, if none is tied or without a difference.
EXACT_PAIRS = 50


def exact_p(n: Column, w: Column) -> Column:
    """The two-sided p of n untied differences: how many of the 2^n sets of ranks have a sum up to w, by folding each rank into an array of counts by sum."""
    empty = F.transform(F.sequence(F.lit(0), F.floor(w).cast("int")), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    add = lambda ways, r: F.transform(ways, lambda x, s: x + F.when(s >= r, F.get(ways, s - r)).otherwise(0.0))
    ways = F.aggregate(F.sequence(F.lit(1), n.cast("int")), empty, add)
    return F.least(F.lit(1.0), 2 * F.aggregate(ways, F.lit(0.0), lambda a, x: a + x) / F.pow(F.lit(2.0), n))


@F.pandas_udf(DoubleType())
def _two_sided(z: pd.Series) -> pd.Series:
    """p of a normal deviate: the complementary error function, which Spark has not; a row for each test."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)))


def wilcoxon_test(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """(keys, n, w, p_value): two-sided signed-rank tests. Exact up to 50 pairs that all differ and are not tied, else the normal approximation with correction for ties; no p without a difference."""
    t = signed_ranks(df, a, b, list(keys))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    exact = (F.col("n") > 0) & (F.col("n") + F.col("zeros") <= EXACT_PAIRS) & (F.col("zeros") == 0) & (F.col("ties") == 0)
    t = t.withColumn("z", F.when((F.col("n") > 0) & ~exact & (var > 0), (F.col("w") - n * (n + 1) / 4) / F.sqrt(var)))
    p = F.when(exact, exact_p(F.col("n"), F.col("w"))).when(F.col("n") > 0, F.least(F.lit(1.0), _two_sided(F.col("z"))))
    return t.select(*keys, "n", F.when(F.col("n") > 0, F.col("w")).alias("w"), p.alias("p_value"))


def wilcoxon_p(n: int, w: float) -> float:
    """exact_p of plain numbers."""
    ways = [1.0] + [0.0] * int(w)
    for r in range(1, n + 1):
        ways = [x + (ways[s - r] if s >= r else 0.0) for s, x in enumerate(ways)]
    return min(1.0, 2 * sum(ways) / 2**n)

"""Confusion counts and what derives from them; null where undefined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aperture.functions.scalars import div
from aperture.operators import ranges as R

COUNTS = ["tp", "tn", "fp", "fn"]


def confusion(gt: Column, pred: Column) -> list[Column]:
    one = lambda c, name: F.count_if(c).alias(name)
    return [one((gt == 1) & (pred == 1), "tp"), one((gt == 0) & (pred == 0), "tn"), one((gt == 0) & (pred == 1), "fp"), one((gt == 1) & (pred == 0), "fn")]


def derived(df: DataFrame, zero_division: bool = False) -> DataFrame:
    """accuracy, precision, sensitivity, specificity, npv, f1, balanced_accuracy from tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c) for c in COUNTS)
    zero = (lambda c: F.coalesce(c, F.lit(0.0))) if zero_division else (lambda c: c)
    df = df.withColumns({"accuracy": div(tp + tn, tp + tn + fp + fn), "precision": zero(div(tp, tp + fp)), "sensitivity": div(tp, tp + fn), "specificity": div(tn, tn + fp), "npv": div(tn, tn + fn)})
    p, r = F.col("precision"), F.col("sensitivity")
    return df.withColumns({"f1": zero(div(2 * p * r, p + r)), "balanced_accuracy": (r + F.col("specificity")) / 2})


def per_class(df: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_id, tp, support, predicted, recall, precision, f1) of (label, pred), one row for every class of the spine."""
    t = df.groupBy("label", "pred").agg(F.count("*").alias("n"))
    a = t.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    b = t.groupBy(F.col("pred").alias("d")).agg(F.sum("n").alias("predicted"))
    out = classes.join(a, classes.class_id == a.c, "left").join(b, classes.class_id == b.d, "left").select("class_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("tp", "support", "predicted")])
    out = out.withColumns({"recall": div(F.col("tp"), F.col("support")), "precision": div(F.col("tp"), F.col("predicted"))})
    return out.withColumn("f1", F.coalesce(div(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0)))


def wide_f1(classes: DataFrame, n: int) -> DataFrame:
    """One row of f1__0 ... and the counts predicted__0 ..., support__0 ... of per_class()."""
    pick = lambda c, k: F.max(F.when(F.col("class_id") == k, F.col(c)))
    return classes.agg(*[pick(c, k).alias(f"{c}__{k}") for c in ("f1", "predicted", "support") for k in range(n)])


def macro(classes: DataFrame) -> DataFrame:
    """Macro figures over all classes (0 where undefined), balanced accuracy over those with support, dead classes."""
    zero = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    return classes.agg(
        F.try_divide(F.sum("tp").cast("double"), F.sum("support").cast("double")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), zero(F.col("precision")).alias("macro_precision"), zero(F.col("recall")).alias("macro_recall"),
        F.avg("f1").alias("macro_f1"), F.count_if(F.col("f1") == 0).alias("dead_classes"), F.sum("support").alias("n"), F.count("*").alias("n_classes"),
    )


def quadratic_kappa(df: DataFrame) -> DataFrame:
    """1 - sum of w O / sum of w E with w the squared distance of (label, pred); expected counts from moments, so no class grid is needed."""
    l, p = F.col("label").cast("double"), F.col("pred").cast("double")
    a = df.agg(F.avg((l - p) * (l - p)).alias("o"), F.avg(l * l).alias("ll"), F.avg(p * p).alias("pp"), F.avg(l).alias("l"), F.avg(p).alias("p"))
    return a.select((1.0 - F.try_divide(F.col("o"), F.col("ll") + F.col("pp") - 2 * F.col("l") * F.col("p"))).alias("kappa"))


def grouped_and_overall(df: DataFrame, group: str, aggs: list[Column], overall: str = "__overall__") -> DataFrame:
    """A row for each group and one for all, from one pass (grouping sets)."""
    out = df.groupingSets([[group], []], group).agg(F.grouping(F.col(group)).alias("__g"), *aggs)
    return out.withColumn(group, F.when(F.col("__g") == 1, F.lit(overall)).otherwise(F.col(group))).drop("__g")


def _beside(base: DataFrame, more: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Both tables' columns by key; a key that `more` lacks has nulls. Without keys each is one row."""
    if not keys:
        return base.join(F.broadcast(more), F.lit(True), "left")
    other = more.withColumnsRenamed({k: f"__{k}" for k in keys})
    return base.join(other, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*[f"__{k}" for k in keys])


def score_summary(df: DataFrame, col: str, *keys: str) -> DataFrame:
    """mean, std, min, max and exact quantiles of a column by key."""
    shares = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    out = df.groupBy(*keys).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"))
    return _beside(out, R.quantiles(df, col, shares, list(keys)), keys)


def rank_summary(df: DataFrame, rank: str, *keys: str) -> DataFrame:
    r = F.col(rank)
    out = df.groupBy(*keys).agg(F.avg(r.cast("double")).alias("mean_rank"), F.avg(1.0 / r).alias("mrr"), *[F.avg((r <= k).cast("double")).alias(f"recall_{k}") for k in (1, 5, 10)])
    return _beside(out, R.quantiles(df, rank, {"median_rank": 0.5}, list(keys)), keys).select(*keys, "median_rank", "mean_rank", "mrr", "recall_1", "recall_5", "recall_10")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """(bin, n) over `bins` equal ranges from the smallest to the largest finite value, the last closed; empty bins are left out."""
    df = df.where(F.abs(col) < float("inf")).select(col)
    ends = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    lo, hi = F.col("__lo"), F.col("__hi")
    b = F.when(hi > lo, F.least(F.floor((F.col(col) - lo) / ((hi - lo) / bins)), F.lit(bins - 1))).otherwise(0)
    return df.join(F.broadcast(ends)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def rank_cdf(df: DataFrame, rank: str) -> DataFrame:
    """The share of rows up to each rank: counted by rank first, then summed over ranges of ranks."""
    t = R.before(R.dealt(df.groupBy(rank).agg(F.count("*").alias("n")), [], [rank]), [], [rank], {"lower": "n"})
    total = t.agg(F.sum("n").alias("__all"))
    return t.join(F.broadcast(total)).select(rank, ((F.col("lower") + F.col("n")) / F.col("__all")).alias("cdf"))

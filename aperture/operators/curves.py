"""Ranking curves on (keys, score, gt[, weight]): scores are counted by value first, then accumulated over sampled ranges of (keys, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aperture.functions.scalars import div
from aperture.operators import metrics as M
from aperture.operators import ranges as R


def _points(df: DataFrame, keys: list[str], weight=None) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return df.groupBy(*keys, "score").agg(F.sum(F.when(F.col("gt") == 1, w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("gt") == 0, w).otherwise(0.0)).alias("n"))


def rising(df: DataFrame, keys: list[str] = (), weight=None) -> DataFrame:
    """(keys, score, p, n, tps, fps, range): weights of both classes at each score, and of all scores down to it. The functions below take it as `curve`, so that several need one pass."""
    keys = list(keys)
    t = R.dealt(_points(df, keys, weight), keys, ["score"])
    t = R.before(t, keys, ["score"], {"tps": "p", "fps": "n"}, True)
    return t.withColumns({"tps": F.col("tps") + F.col("p"), "fps": F.col("fps") + F.col("n")})


def auroc(df: DataFrame, keys: list[str] = (), weight=None, curve: DataFrame | None = None) -> DataFrame:
    """Mann-Whitney with half for ties; null with one class."""
    t = curve if curve is not None else rising(df, keys, weight)
    pairs = F.sum("p") * F.sum("n")
    return t.groupBy(*keys).agg(div(pairs - F.sum(F.col("p") * (F.col("fps") - 0.5 * F.col("n"))), pairs).alias("auroc"))


def macro_ovr_auroc(probs: DataFrame, n_classes: int) -> DataFrame:
    """(macro_auroc, classes) of (label, class_id, prob): each class against the rest, averaged; with two classes, that of the second.

    Null if any class is undefined, as when no item has its label; classes counts the defined ones.
    """
    some = probs.where("class_id = 1") if n_classes == 2 else probs.where(F.col("class_id").between(0, n_classes - 1))
    t = auroc(some.select("class_id", (F.col("label") == F.col("class_id")).cast("int").alias("gt"), F.col("prob").alias("score")), ["class_id"])
    n = F.count("auroc")
    return t.agg(F.when(n == (1 if n_classes == 2 else n_classes), F.avg("auroc")).alias("macro_auroc"), n.alias("classes"))


def roc(df: DataFrame, keys: list[str] = (), drop_intermediate: bool = False, curve: DataFrame | None = None) -> DataFrame:
    """(keys, threshold, tpr, fpr, tps, fps) by falling threshold; the first point is an infinite threshold and nothing predicted. With one class the other's rates are null but for that point.

    drop_intermediate leaves out points on a straight run, but for its ends.
    """
    keys = list(keys)
    t = (curve if curve is not None else rising(df, keys)).select(*keys, "score", "tps", "fps", R.PART)
    if drop_intermediate:
        turn = lambda c: F.col(f"{c}_lead") - 2 * F.col(c) + F.col(f"{c}_lag")
        t = R.neighbours(t, keys, "score", ["tps", "fps"], True).where(F.coalesce((turn("tps") != 0) | (turn("fps") != 0), F.lit(True)))
    t = t.select(*keys, "score", "tps", "fps")
    totals = t.groupBy(*keys).agg(F.max("tps").alias("all_p"), F.max("fps").alias("all_n")).where("all_p is not null")  # no points of no rows
    first = totals.select(*keys, F.lit(float("inf")).alias("score"), F.lit(0.0).alias("tps"), F.lit(0.0).alias("fps"))
    t = _with(first.unionByName(t), totals, keys)
    part = lambda c, whole: F.when(F.col(c) == 0.0, F.when((F.col("score") == float("inf")) | (F.col(whole) > 0), 0.0)).otherwise(div(F.col(c), F.col(whole)))
    return t.select(*keys, F.col("score").alias("threshold"), part("tps", "all_p").alias("tpr"), part("fps", "all_n").alias("fpr"), "tps", "fps")


def _with(df: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Each row of `df` with the row of its keys of `one`; without keys that is one row."""
    if not keys:
        return df.join(F.broadcast(one), F.lit(True), how)
    other = one.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(other, on, how).drop(*[f"__{k}" for k in keys])


def average_precision(df: DataFrame, keys: list[str] = (), curve: DataFrame | None = None) -> DataFrame:
    """Sum of the steps in recall times precision."""
    t = curve if curve is not None else rising(df, keys)
    return t.groupBy(*keys).agg(div(F.sum(F.col("p") * F.col("tps") / (F.col("tps") + F.col("fps"))), F.sum("p")).alias("average_precision"))


def precision_recall(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, threshold, precision, recall) at each score, and the end point of precision 1 and recall 0 with no threshold; recall is 1 without positives."""
    keys = list(keys)
    t = rising(df, keys)
    totals = t.groupBy(*keys).agg(F.max("tps").alias("all_p"))
    t = _with(t, totals, keys).select(*keys, F.col("score").alias("threshold"), div(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"), F.coalesce(div(F.col("tps"), F.col("all_p")), F.lit(1.0)).alias("recall"))
    return t.unionByName(totals.select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))


def youden(points: DataFrame, keys: list[str] = (), tolerant: bool = False) -> DataFrame:
    """The threshold of the largest tpr - fpr: the highest of equals; `tolerant`: of all within rounding of it (then null for an infinite one). No row for a group of one class."""
    keys = list(keys)
    p = points.withColumn("j", F.col("tpr") - F.col("fpr"))
    if not tolerant:
        best = p.groupBy(*keys).agg(F.max(F.struct("j", "threshold")).alias("m"), F.count_if(F.col("j").isNull()).alias("undefined"))
        return best.where("undefined = 0").select(*keys, F.col("m.threshold").alias("threshold"), F.col("m.j").alias("j"))
    tops = p.groupBy(*keys).agg(F.max("j").alias("best"), F.count_if(F.col("j").isNull()).alias("undefined"))
    p = _with(p, tops, keys).where("undefined = 0").where(F.abs(F.col("j") - F.col("best")) <= 1e-8 + 1e-5 * F.abs("best"))
    return p.groupBy(*keys).agg(F.max("threshold").alias("t"), F.max("best").alias("j")).select(*keys, F.when(F.col("t") < float("inf"), F.col("t")).alias("threshold"), "j")


def at_sensitivity(points: DataFrame, floor: float, keys: list[str] = ()) -> DataFrame:
    """Of the points with tpr of `floor` or more, the highest specificity, then the highest threshold; if none, the largest tpr."""
    ok = F.col("tpr") >= floor
    pick = F.struct(ok.alias("ok"), F.when(ok, -F.col("fpr")).otherwise(F.col("tpr")).alias("by"), F.col("threshold").alias("threshold"), "tpr", "fpr")
    return points.where("tpr is not null").groupBy(*keys).agg(F.max(pick).alias("m")).select(*keys, "m.threshold", F.col("m.tpr").alias("sensitivity"), (1 - F.col("m.fpr")).alias("specificity"))


def at_threshold(df: DataFrame, threshold, keys: list[str] = (), zero_division: bool = False) -> DataFrame:
    """Confusion and derived figures of score >= threshold."""
    pred = (F.col("score") >= threshold).cast("int")
    return M.derived(df.groupBy(*keys).agg(*M.confusion(F.col("gt"), pred), F.count("*").alias("n")), zero_division)

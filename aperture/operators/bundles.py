"""Figures that reports show together: one row a group with all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aperture.functions.scalars import div
from aperture.operators import curves as K
from aperture.operators import metrics as M
from aperture.operators import resample as B

NEUTRAL = 0.5


def _joined(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = K._with(out, p, keys, "left")
    return out


def operating_points(df: DataFrame, keys: list[str] = (), floors: dict[str, float] | None = None, curve: DataFrame | None = None) -> DataFrame:
    """youden_{thresh, sens, spec, j} and, for each floor of sensitivity, {name}_{thresh, sens, spec}, from one pruned curve; null with one class.

    Youden: the highest threshold among equals. A floor: the highest specificity of the points that reach
    it, then the highest threshold; if none does, the largest sensitivity.
    """
    keys = list(keys)
    p = K.roc(df, keys, True, curve).withColumns({"j": F.col("tpr") - F.col("fpr"), "spec": 1.0 - F.col("fpr")})
    picks = {"youden": F.struct("j", "threshold", F.col("tpr").alias("sens"), "spec")}
    for name, floor in (floors or {}).items():
        ok = F.col("tpr") >= floor
        picks[name] = F.struct(ok.alias("ok"), F.when(ok, F.col("spec")).otherwise(F.col("tpr")).alias("by"), F.col("threshold").alias("threshold"), F.col("tpr").alias("sens"), F.col("spec").alias("spec"))
    t = p.groupBy(*keys).agg(*[F.when(F.count_if(F.col("j").isNull()) == 0, F.max(x)).alias(n) for n, x in picks.items()])
    cols = [F.col(f"{n}.{a}").alias(f"{n}_{b}") for n in picks for a, b in (("threshold", "thresh"), ("sens", "sens"), ("spec", "spec"))]
    return t.select(*keys, *cols, F.col("youden.j").alias("youden_j"))


def _counts(df: DataFrame, keys: list[str], pred: Column) -> DataFrame:
    pos, neg = F.col("gt") == 1, F.col("gt") == 0
    sums = [F.count("*").alias("n"), F.count_if(pos).alias("n_pos"), F.count_if(neg).alias("n_neg"), F.avg(F.when(pos, F.col("score"))).alias("mean_prob_pos"), F.avg(F.when(neg, F.col("score"))).alias("mean_prob_neg")]
    return df.groupBy(*keys).agg(*M.confusion(F.col("gt"), pred), *sums)


def _areas(df: DataFrame, keys: list[str], curve: DataFrame) -> list[DataFrame]:
    return [K.auroc(df, keys, curve=curve), K.average_precision(df, keys, curve).withColumnRenamed("average_precision", "aupr")]


def probability_metrics(df: DataFrame, keys: list[str] = (), pred: str | None = None) -> DataFrame:
    """Counts, confusion of the stored predictions (`pred`; score >= 0.5 where blank or none), areas and operating points of (keys, gt, score).

    Areas and operating points are null for a group of one class.
    """
    keys = list(keys)
    over = (F.col("score") >= NEUTRAL).cast("int")
    stored = F.coalesce(F.trim(F.col(pred).cast("string")).try_cast("double").cast("int"), over) if pred else over
    base = M.derived(_counts(df, keys, stored))
    curve = K.rising(df, keys)
    out = _joined([base, *_areas(df, keys, curve), operating_points(df, keys, {"sens90": 0.9, "sens95": 0.95}, curve)], keys).drop("youden_j")
    return out.withColumn("aupr", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("aupr")))


def fixed_threshold(df: DataFrame, threshold: float | Column, keys: list[str] = ()) -> DataFrame:
    """n, n_pos, n_neg, auroc, aupr, accuracy, balanced_accuracy, sensitivity, specificity, precision, f1 at score >= threshold; all but the counts null with one class."""
    keys = list(keys)
    base = M.derived(_counts(df, keys, (F.col("score") >= threshold).cast("int")), True)
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    out = _joined([base, *_areas(df, keys, K.rising(df, keys))], keys)
    names = ["auroc", "aupr", "accuracy", "balanced_accuracy", "sensitivity", "specificity", "precision", "f1"]
    return out.select(*keys, "n", "n_pos", "n_neg", *[F.when(both, F.col(c)).alias(c) for c in names])


BINARY = ["accuracy", "f1", "precision", "sensitivity", "specificity", *M.COUNTS]


def binary_thresholds(df: DataFrame, n_classes: int, keys: list[str] = ()) -> DataFrame:
    """binary_auroc and binary_{0p5, youden}_* of (keys, gt: the label, score: the second class's probability), precision and F1 zero where undefined.

    Null unless there are two classes and all labels are 0 or 1 (binary_0p5_threshold is 0.5 all the same); what needs both
    classes is null with one. Without keys there is one row, of an empty table too.
    """
    keys = list(keys)
    one = df.groupBy(*keys).agg(F.max("gt").alias("hi"), F.min("gt").alias("lo"))
    fit = F.lit(n_classes == 2) & F.col("lo").isin(0, 1) & F.col("hi").isin(0, 1)
    df = K._with(df, one.select(*keys, fit.alias("__fit")), keys).where("__fit").drop("__fit") if n_classes == 2 else df.limit(0)
    curve = K.rising(df, keys)
    points = operating_points(df, keys, curve=curve).select(*keys, F.col("youden_thresh").alias("binary_youden_threshold"), F.col("youden_j").alias("binary_youden_j"))
    at = K._with(df, points, keys, "left").withColumn("__t", F.col("binary_youden_threshold"))

    def part(t: DataFrame, pred: Column, name: str) -> DataFrame:
        x = M.derived(t.groupBy(*keys).agg(*M.confusion(F.col("gt"), pred), F.count("*").alias("__n")), True).where("__n > 0")
        return x.select(*keys, *[F.col(c).alias(f"binary_{name}_{c}") for c in BINARY])

    fixed = part(df, (F.col("score") >= NEUTRAL).cast("int"), "0p5")
    best = part(at.where("__t is not null"), (F.col("score") >= F.col("__t")).cast("int"), "youden")
    auc = K.auroc(df, keys, curve=curve).withColumnRenamed("auroc", "binary_auroc")
    return _joined([one.select(*keys, F.lit(NEUTRAL).alias("binary_0p5_threshold")), fixed, auc, points, best], keys)


def grouped_tables(df: DataFrame, group: str, poolings: dict[str, str], at: float = NEUTRAL) -> DataFrame:
    """fixed_threshold for each pooling (name: its score column) and group, and for each pooling as a whole (group "__overall__")."""
    out = None
    for name, c in poolings.items():
        t = df.select(F.col(group).cast("string").alias(group), "gt", F.col(c).alias("score"))
        both = fixed_threshold(t, at, [group]).unionByName(fixed_threshold(t, at).withColumn(group, F.lit("__overall__")))
        both = both.withColumn("pooling", F.lit(name))
        out = both if out is None else out.unionByName(both)
    return out


# ------------------------------------------------------------------ with intervals


def replicate_metrics(df: DataFrame, draws: DataFrame, cluster: str, threshold: float | Column, keys: list[str] = ()) -> DataFrame:
    """auroc, accuracy, balanced_accuracy, sensitivity, specificity of each replicate (rep) of (keys, gt, score); rates are null with one class."""
    keys = [*keys, "rep"]
    c = draws.select("rep", F.col("cluster").alias("__c"), "weight")
    t = df.withColumn("__own", F.col(cluster).cast("string")).join(c, F.col("__own") == F.col("__c")).drop("__own", "__c")
    hit, w = F.col("score") >= threshold, lambda x: F.sum(F.when(x, F.col("weight")).otherwise(0))
    pos, neg = F.col("gt") == 1, F.col("gt") == 0
    k = t.groupBy(*keys).agg(w(pos & hit).alias("tp"), w(neg & ~hit).alias("tn"), w(pos).alias("p"), w(neg).alias("q"))
    both = (F.col("p") > 0) & (F.col("q") > 0)
    se, sp = div(F.col("tp"), F.col("p")), div(F.col("tn"), F.col("q"))
    k = k.select(*keys, div(F.col("tp") + F.col("tn"), F.col("p") + F.col("q")).alias("accuracy"), *[F.when(both, x).alias(n) for n, x in (("balanced_accuracy", (se + sp) / 2), ("sensitivity", se), ("specificity", sp))])
    return K._with(k, K.auroc(t, keys, "weight"), keys)


def locked_threshold_intervals(df: DataFrame, cluster: str, threshold: float, reps: int, keys: list[str] = ()) -> DataFrame:
    """Percentile intervals of auroc, balanced_accuracy, sensitivity and specificity at a threshold fixed before, over draws of clusters in which auroc is defined."""
    t = replicate_metrics(df, B.cluster_draws(df, cluster, reps), cluster, threshold, list(keys))
    return B.intervals(t, ["auroc", "balanced_accuracy", "sensitivity", "specificity"], *keys, require="auroc")


def paired_comparison(df: DataFrame, cluster: str, reps: int, a: str, b: str, ta: float | Column = NEUTRAL, tb: float | Column = NEUTRAL, keys: list[str] = ()) -> DataFrame:
    """(keys, metric, delta, lo, hi, p_value, n_valid): score column a against b on the same slides and the same draws of clusters.

    delta is the difference on the slides themselves; auroc and balanced accuracy (each model at its own threshold).
    """
    keys = list(keys)
    draws = B.cluster_draws(df, cluster, reps)
    whole = df.select(F.col(cluster).cast("string").alias("cluster")).distinct().select(F.lit(-1).alias("rep"), "cluster", F.lit(1).cast("long").alias("weight"))
    draws = whole.unionByName(draws)  # replicate -1: every slide once
    side = lambda c, at: replicate_metrics(df.withColumn("score", F.col(c)), draws, cluster, at, keys).select(*keys, "rep", "auroc", "balanced_accuracy")
    x = K._with(side(a, ta), side(b, tb).withColumnsRenamed({"auroc": "auroc_b", "balanced_accuracy": "balanced_accuracy_b"}), [*keys, "rep"])
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(m) - F.col(f"{m}_b")).alias("d")) for m in ("auroc", "balanced_accuracy")])
    x = x.select(*keys, "rep", F.inline(metrics))
    seen = x.where("rep = -1").select(*keys, "metric", F.col("d").alias("delta"))
    return K._with(seen, B.paired_p(x.where("rep >= 0"), "d", *keys, "metric"), [*keys, "metric"], "left")


def compare_models(reference: DataFrame, others: DataFrame, thresholds: DataFrame, cluster: str, reps: int, name: str) -> DataFrame:
    """paired_comparison of a reference model with each other one, and Holm's correction for each metric of a table.

    reference: table, grp, slide, gt, score and `cluster`; others: table, model, grp, slide, gt, score; thresholds:
    model, threshold (`name` is the reference's; models without one are left out). Slides pair one to one, and
    only where both labels agree; a pair of one class has null deltas.
    """
    from aperture.operators import tables as J

    own = thresholds.where(F.col("model") == name).select(F.col("threshold").alias("ta"))
    o = J.with_threshold(others.where(F.col("model") != name), thresholds).select("table", "model", "grp", "slide", F.col("gt").alias("gt_b"), F.col("score").alias("b"), F.col("threshold").alias("tb"))
    models = o.select("table", "model").distinct()
    r = reference.join(models, "table").select("table", "model", "grp", "slide", F.col(cluster).alias("cluster"), "gt", F.col("score").alias("a"))
    both = J.agreeing(J.one_to_one(r, o, ["table", "model", "grp", "slide"]), "gt", "gt_b").join(F.broadcast(own))
    out = paired_comparison(both, "cluster", reps, "a", "b", F.col("ta"), F.col("tb"), ["table", "model"])
    return B.holm(out, "p_value", "table", "metric", order="model")

"""Class vectors, logits, probabilities and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aperture.functions import vectors as V
from aperture.functions.scalars import sigmoid


def class_vectors(prompts: DataFrame) -> DataFrame:
    """(class_id, class_vec) from (class_id, vec): the prompt ensemble of each class."""
    return V.mean_by(prompts, ["class_id"], "vec", "m").select("class_id", V.unit_class(F.col("m")).alias("class_vec"))


def logits(items: DataFrame, classes: DataFrame) -> DataFrame:
    """(item_id, class_id, logit): every item with every class. Classes are a bounded dimension, one row each; all of an item's classes ride in one array, so no join of pairs is made."""
    table = classes.agg(F.array_sort(F.collect_list(F.struct("class_id", "class_vec"))).alias("classes"))
    both = items.join(F.broadcast(table))
    return both.select(*[c for c in items.columns if c != "embedding"], F.explode(F.transform("classes", lambda c: F.struct(c["class_id"].alias("class_id"), V.dot(F.col("embedding"), c["class_vec"]).alias("logit")))).alias("x")).select("*", "x.*").drop("x")


def softmax(df: DataFrame, scale: float = 1.0) -> DataFrame:
    w = Window.partitionBy("item_id")
    e = F.exp(F.lit(scale) * (F.col("logit") - F.max("logit").over(w)))
    return df.withColumn("e", e).withColumn("prob", F.col("e") / F.sum("e").over(w)).drop("e")


def probabilities(df: DataFrame, n_classes: int, scale: float = 1.0) -> DataFrame:
    """One class: a sigmoid; more: a softmax."""
    return df.withColumn("prob", sigmoid(F.col("logit") * scale)) if n_classes == 1 else softmax(df, scale)


def predict(df: DataFrame, *keep: str) -> DataFrame:
    """The class of the largest logit, the lowest id among equals."""
    return df.groupBy("item_id", *keep).agg(F.max(F.struct("logit", -F.col("class_id"))).alias("m")).select("item_id", *keep, (-F.col("m.col2")).alias("pred"))


def pair_scores(negative: str, positive: str):
    """The probability of the positive of two prompts, a softmax of two."""
    return 1.0 / (1.0 + F.exp(F.col(negative) - F.col(positive)))

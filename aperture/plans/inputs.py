"""The driver's tables in the roles of the library's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aperture.functions import vectors as V


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def items(spark, d) -> DataFrame:
    """Evaluation items: embeddings but every tenth."""
    return read(spark, d, "embeddings").where("vec_id % 10 <> 0").select(F.col("vec_id").alias("item_id"), "label", "embedding")


def prompts(spark, d) -> DataFrame:
    """Prompt vectors: every tenth embedding, its label the class."""
    return read(spark, d, "embeddings").where("vec_id % 10 = 0").select(F.col("label").alias("class_id"), F.col("embedding").alias("vec"))


def slide_scores(spark, d) -> DataFrame:
    """(slide, patient, grp, gt, score) of every order."""
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("slide"), F.col("o_custkey").alias("patient"), F.col("c_mktsegment").alias("grp"), (F.col("o_orderstatus") == "F").cast("int").alias("gt"), (F.floor(F.col("o_totalprice") / 100) / 6000.0).alias("score"))


def doc_scores(spark, d) -> DataFrame:
    """(doc_id, lang, source, gt, score) of every labelled document; many scores are tied."""
    t, x = read(spark, d, "labels"), read(spark, d, "documents")
    return t.join(x, "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("gt"), (F.floor(F.col("n_chars") / 50) / 1000.0).alias("score"))


def pairs(spark, d) -> DataFrame:
    """(pair_index, image_emb, text_emb, group_id, image_id, caption): a text is near its image and nearer to another."""
    e = read(spark, d, "embeddings")
    n = e.count()
    other = e.select(F.col("vec_id").alias("o"), F.col("embedding").alias("oe"))
    t = e.join(other, F.col("o") == (F.col("vec_id") * 7 + 3) % n)
    text = F.zip_with("embedding", "oe", lambda a, b: a.cast("double") * 0.2 + b.cast("double") * 0.8)
    double = F.transform("embedding", lambda x: x.cast("double"))
    return t.select(F.col("vec_id").alias("pair_index"), V.unit(double).alias("image_emb"), V.unit(text).alias("text_emb"), F.col("label").cast("string").alias("group_id"), F.floor(F.col("vec_id") / 2).cast("string").alias("image_id"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("caption"))


def tiles(spark, d) -> DataFrame:
    """(slide, grp, tile_ix, embedding)."""
    e = read(spark, d, "embeddings")
    return e.select((F.col("vec_id") % 50).alias("slide"), (F.col("vec_id") % 5).alias("grp"), F.col("vec_id").alias("tile_ix"), "embedding")

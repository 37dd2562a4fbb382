"""The training-data pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns the documents that
it kept, as it left them; the last returns the pieces of packed sequences.

Rows are documents, whatever their doc_id: it may be null or used again, and a stage decides by row.
Rows that are equal in every column are copies. Columns beside doc_id, text, lang, source and n_chars
go through all stages but the last as they are, whatever their names. An empty table gives an empty
one. A stage's result is lazy over a few narrow tables in the shared folder, which stay until Python ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aperture.llm import common as C
from aperture.llm import minhash, mixing, packing, quality, suffix


#: All that a column holds: microseconds, and fields that are null.
WHOLE = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, row): each row of `docs` as one struct, so that no column name can clash, and a 128-bit hash of all its columns."""
    short = F.struct(*[F.md5("text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    return docs.select(F.md5(F.to_json(short, WHOLE)).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `rows` (key, row) whose key is in `keys` (key)."""
    return rows.join(keys, "key", "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass the rules of op4; equal rows are judged alike, each stays or goes.

    A null or empty text fails (under 50 words). A null lang is a language of its own. Of a very long
    text all words count. References are those of the rows given.
    """
    rows, scratch = _keyed(docs), C.Scratch(spark, "p-quality")
    verdict = quality.quality(rows.select(F.col("key").alias("doc_id"), "row.lang", "row.text"), scratch)
    kept = scratch.last(verdict.where("kept").select(F.col("doc_id").alias("key")).distinct(), "kept")
    return _only(rows, kept).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, that of the smallest doc_id (null last), among equals that of the smallest hash.

    Texts that are null, empty or without words are alike with nothing, and stay; but of rows that are
    equal in every column, one stays, whatever the text.
    """
    rows, scratch = _keyed(docs), C.Scratch(spark, "p-minhash")
    numbered = rows.select(F.monotonically_increasing_id().alias("doc_id"), "row.text", F.col("row.doc_id").alias("id"), F.col("key").alias("k"))
    classes = minhash.near_duplicates(numbered, scratch, carry=("id", "k"))
    first = classes.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "k")).alias("x")).select(F.col("x.k").alias("key")).distinct()
    return _only(rows, scratch.last(first, "first")).groupBy("key").agg(F.any_value("row").alias("row")).select("row.*")


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with each byte cut out that a string of 200 bytes covers which also begins elsewhere, in the same text or another.

    Every occurrence goes, also in equal rows. A row of which nothing is left goes; a null or empty text
    stays as it is. n_chars becomes the new length.
    """
    return suffix.without_repeats(docs, C.Scratch(spark, "p-suffix"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of op7 in the order of its schedule: a row for each pass that takes words of a document, with those words.

    Equal rows are documents of their own. A null source is one of its own. A text without words has
    nothing to take and goes. n_chars becomes the new length.
    """
    return mixing.mixed_documents(docs, C.Scratch(spark, "p-mix"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of op2: sequences of at most 2048 tokens, the rows in the order read. A null or empty text has its end alone."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("repeat_removal", repeat_removal), ("source_mixing", source_mixing), ("packing", packing_stage)]

#: ProbMinHash candidates and the tokenizer have no SQL; tests hold the stages and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = C.read(spark, sf_dir, "documents"), C.Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.last(stage(spark, docs, sf_dir), name)
    return docs

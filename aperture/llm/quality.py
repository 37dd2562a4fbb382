"""Quality rules by Jensen-Shannon distance from references of each language; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aperture.llm import common as C

GAP = r"[\x20\x09-\x0D]+"
#: Classes of characters in words, taken away one after the other; what is left is beyond ASCII.
CLASSES = {"lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "symbol": "[#*$%&|<>]+", "punct": r"[!-/:-@\[-`{-~]+"}
BUCKETS, COMMON = 65536, 64
LN2 = 0.6931471805599453


def measures(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, lang, text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the class counts and word_ids, 16 bits of each word's hash.

    Three-word windows are sorted by all 64 bits of the hash of their words, then by place, which brings
    equal ones together; nothing leaves the row. Texts whose windows all differ need no sort.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(C.SPACES))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(C.SPACES))) > 0)
    df = docs.withColumns({"bare": bare, "lines": lines})
    df = df.select("doc_id", "lang", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", GAP)).alias("words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    df = df.withColumns({"n_words": F.size("words").cast("long"), "left": F.array_join("words", "")}).withColumn("word_chars", F.length("left").cast("long"))
    for name, pattern in CLASSES.items():
        df = df.withColumn("next", F.regexp_replace("left", pattern, "")).withColumn(f"n_{name}", (F.length("left") - F.length("next")).cast("long")).drop("left").withColumnRenamed("next", "left")
    df = df.withColumn("n_beyond", F.length("left").cast("long")).drop("left").withColumnRenamed("n_symbol", "n_symbols")
    tail = lambda x, k: F.slice(x, F.lit(k), F.greatest(F.size(x) - (k - 1), F.lit(0)))
    three = F.slice(F.arrays_zip("words", tail(F.col("words"), 2).alias("b"), tail(F.col("words"), 3).alias("c")), F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))
    df = df.withColumns({"h": F.transform(three, lambda x: F.xxhash64(x)), "word_ids": F.transform("words", lambda w: F.xxhash64(w).bitwiseAND(BUCKETS - 1).cast("int"))}).drop("words")
    df = df.withColumn("h", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.col("h")))
    df = df.withColumn("placed", F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))).drop("h")
    next_to = F.slice(F.arrays_zip(F.col("placed").alias("a"), tail(F.col("placed"), 2).alias("b")), F.lit(1), F.greatest(F.size("placed") - 1, F.lit(0)))
    equal = F.filter(next_to, lambda x: x["a"]["h"] == x["b"]["h"])
    df = df.withColumn("at", F.sort_array(F.array_distinct(F.flatten(F.transform(equal, lambda x: F.array(x["a"]["i"], x["b"]["i"])))))).drop("placed")
    start = F.struct(F.lit(-3).cast("long").alias("p"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("at", start, lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(3).cast("long"), p - a["p"])).alias("n")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("at")


HIST = ["n_lower", "n_upper", "n_digit", "n_symbols", "n_punct", "n_beyond"]


def references(measured: DataFrame, common: int = COMMON) -> tuple[DataFrame, DataFrame]:
    """Per language: shares of character classes (one row), and its common words with their shares (`common` rows).

    Words are counted over all texts, by 16 bits of their hash: a class that is common is so by its
    common word, to which the rare words of the same class add about a 65536th of all rare ones.
    """
    chars = measured.groupBy("lang").agg(F.sum("n_words").alias("ref_words"), *[(F.sum(c) / F.greatest(F.sum("word_chars"), F.lit(1))).alias(f"r_{c}") for c in HIST])
    counts = measured.select("lang", F.explode("word_ids").alias("w")).groupBy("lang", "w").agg(F.count("*").alias("c"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "w"))
    top = counts.withColumn("r", rank).where(F.col("r") <= common).select(F.col("lang").alias("l2"), "w", "c")
    top = top.join(chars.select("lang", "ref_words"), F.col("lang").eqNullSafe(F.col("l2"))).select("l2", "w", (F.col("c") / F.col("ref_words")).alias("q"))
    return chars.withColumnRenamed("lang", "ref_lang"), top


def _part(p: Column, q: Column) -> Column:
    """A bin's share of the divergence of p and q from their mean; zero where both are."""
    log = lambda a: F.when(a > 0, a * F.log(2 * a / (p + q))).otherwise(0.0)
    return (log(p) + log(q)) / 2


def quality(docs: DataFrame, scratch: C.Scratch, max_char: float = 0.33, max_word: float = 0.385, min_chars_words: int = 50, min_words: int = 100, min_reference: int = 2000) -> DataFrame:
    """Per row of `docs` (doc_id, lang, text): its measures, char_distance, word_distance (null: not judged), base_failed, kept.

    A document that passes the base rules is rejected if the Jensen-Shannon distance (base 2, in [0, 1])
    of its character classes or of its common words from its language's reference is over the limit.
    The references are those of all the documents of the language, a null language being one of its own.
    Short documents, whose distances are mostly chance, are not judged (by classes under
    `min_chars_words` words, by words under `min_words`), nor are languages under `min_reference` words:
    such a document is kept if it passes the rest. A null or empty text has no
    words and fails them. Repeated rows are judged alike; extra columns are ignored.
    """
    docs = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    measured = scratch.table(measures(docs).withColumn("id", F.monotonically_increasing_id()), "measured")
    chars_ref, words_ref = references(measured)
    chars_ref, words_ref = scratch.table(chars_ref, "chars"), scratch.table(words_ref, "words")
    chars_ref = chars_ref.join(words_ref.groupBy("l2").agg(F.sum("q").alias("top")), F.col("ref_lang").eqNullSafe(F.col("l2")), "left").drop("l2")
    seen = measured.where(F.col("n_words") >= min_words).select("id", "lang", "n_words", F.explode("word_ids").alias("word"))
    seen = seen.join(words_ref, (F.col("word") == F.col("w")) & F.col("lang").eqNullSafe(F.col("l2")))
    seen = seen.groupBy("id", "word").agg(F.count("*").alias("c"), F.first("q").alias("q"), F.first("n_words").alias("n"))
    seen = seen.groupBy("id").agg(F.sum(_part(F.col("c") / F.col("n"), F.col("q")) - F.col("q") * (LN2 / 2)).alias("common"), F.sum("c").alias("n_common"))
    df = measured.drop("word_ids").join(chars_ref, F.col("lang").eqNullSafe(F.col("ref_lang")), "left").join(seen.withColumnRenamed("id", "i2"), F.col("id") == F.col("i2"), "left")
    enough = F.col("ref_words") >= min_reference
    chars = sum((_part(F.col(c) / F.col("word_chars"), F.col(f"r_{c}")) for c in HIST), F.lit(0.0))
    top, n_common = F.coalesce("top", F.lit(0.0)), F.coalesce("n_common", F.lit(0))
    words = F.coalesce("common", F.lit(0.0)) + top * (LN2 / 2) + _part((F.col("n_words") - n_common) / F.col("n_words"), F.greatest(1 - top, F.lit(0.0)))
    distance = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)) / LN2)
    df = df.withColumns({"char_distance": F.when(enough & (F.col("n_words") >= min_chars_words), distance(chars)), "word_distance": F.when(enough & (F.col("n_words") >= min_words), distance(words))})
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    verdict = F.coalesce(F.col("char_distance") <= max_char, F.lit(True)) & F.coalesce(F.col("word_distance") <= max_word, F.lit(True))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict).alias("kept"), "char_distance", "word_distance")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(C.read(spark, sf_dir, "documents"), C.Scratch(spark, "quality"))

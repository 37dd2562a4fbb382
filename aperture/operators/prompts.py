"""Prompt banks: templates filled with class names, pairs of a negative and a positive prompt, and their wide matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aperture.functions import text as T
from aperture.functions import vectors as V

#: The short bank's templates by key.
TEMPLATES = {
    "bare": "{}",
    "a_photo": "a photo of {}.",
    "he_image": "an H&E stained image of {}.",
    "histo": "histopathology of {}.",
    "patch": "a histopathology image showing {}.",
    "wsi": "a whole-slide image of {}.",
}
#: The rich bank's templates, those that were published with a public model.
RICH_TEMPLATES = [
    "CLASSNAME.", "a photomicrograph showing CLASSNAME.", "a photomicrograph of CLASSNAME.", "an image of CLASSNAME.", "an image showing CLASSNAME.", "an example of CLASSNAME.",
    "CLASSNAME is shown.", "this is CLASSNAME.", "there is CLASSNAME.", "a histopathological image showing CLASSNAME.", "a histopathological image of CLASSNAME.",
    "a histopathological photograph of CLASSNAME.", "a histopathological photograph showing CLASSNAME.", "shows CLASSNAME.", "presence of CLASSNAME.", "CLASSNAME is present.",
    "an H&E stained image of CLASSNAME.", "an H&E stained image showing CLASSNAME.", "an H&E image showing CLASSNAME.", "an H&E image of CLASSNAME.", "CLASSNAME, H&E stain.", "CLASSNAME, H&E.",
]
#: The two vocabularies of slide prompts, variant: (negative, positive).
VOCABULARIES = {
    "shared": {
        "canonical": ("normal lymph node tissue", "lymph node tissue with metastatic carcinoma"),
        "status": ("a lymph node negative for metastatic carcinoma", "a lymph node positive for metastatic carcinoma"),
        "healthy_tumor": ("healthy lymph node tissue", "metastatic tumor in lymph node tissue"),
    },
    "melanoma_agnostic": {
        "canonical": ("normal lymph node tissue", "lymph node tissue with metastatic tumor"),
        "status": ("a lymph node negative for metastatic malignancy", "a lymph node positive for metastatic malignancy"),
        "healthy_tumor": ("healthy lymph node tissue", "metastatic tumor in lymph node tissue"),
    },
}
CANONICAL = "canonical"


def short_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(TEMPLATES.items())], "t_ord long, template_key string, template string")


def rich_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f"rich{i:02d}", t) for i, t in enumerate(RICH_TEMPLATES)], "t_ord long, template_key string, template string")


def _filled(names: DataFrame, templates: DataFrame) -> DataFrame:
    """Every template with every row of `names`; templates are a bounded dimension of a few rows."""
    return names.join(F.broadcast(templates)).withColumn("prompt", T.fill_template(F.col("template"), F.col("name"))).drop("template")


def prompt_bank(classes: DataFrame, templates: DataFrame) -> DataFrame:
    """(class_id, ord, template_key, name, prompt): each template filled with each different name of a class (class_id, name, ord), in order of first mention."""
    names = classes.groupBy("class_id", "name").agg(F.min("ord").alias("ord"))
    return _filled(names, templates).select("class_id", "ord", "template_key", "name", "prompt")


def variant_bank(names: DataFrame, variant: str, templates: DataFrame) -> DataFrame:
    """(dataset, class_id, place, prompt) of one wording of `names` (dataset, variant, class_id, name, v_ord): a prompt a template; place counts within the class."""
    t = _filled(names.where(F.col("variant") == variant), templates)
    return t.select("dataset", "class_id", F.col("t_ord").alias("place"), "prompt")


def canonical_bank(names: DataFrame) -> DataFrame:
    """The canonical wording in the six short templates."""
    return variant_bank(names, CANONICAL, short_templates(names.sparkSession))


def rich_canonical_bank(names: DataFrame) -> DataFrame:
    """The canonical wording in the 22 rich templates."""
    return variant_bank(names, CANONICAL, rich_templates(names.sparkSession))


def rich_bank(names: DataFrame) -> DataFrame:
    """Every different wording of a class, in order of first mention, in the 22 rich templates, one wording after the other."""
    first = names.groupBy("dataset", "class_id", "name").agg(F.min("v_ord").alias("v_ord"))
    synonyms = first.groupBy("dataset", "class_id").agg(F.array_sort(F.collect_list(F.struct("v_ord", "name"))).alias("all")).select("dataset", "class_id", F.posexplode("all").alias("s", "x"))
    t = _filled(synonyms.select("dataset", "class_id", "s", F.col("x.name").alias("name")), rich_templates(names.sparkSession))
    return t.select("dataset", "class_id", (F.col("s") * len(RICH_TEMPLATES) + F.col("t_ord")).cast("long").alias("place"), "prompt")


def prompt_sweep(names: DataFrame, templates: DataFrame) -> DataFrame:
    """(dataset, template_key, variant, class_id, prompt): a prompt set for each template and wording."""
    return _filled(names, templates).select("dataset", "template_key", "variant", "class_id", "prompt")


def vocabulary(spark: SparkSession, name: str | dict[str, tuple[str, str]] = "shared") -> DataFrame:
    """(v_ord, variant, negative, positive) of a vocabulary by name, or of one given."""
    if isinstance(name, str) and name not in VOCABULARIES:
        raise KeyError(f"unknown vocabulary {name}; known: {', '.join(sorted(VOCABULARIES))}")
    words = VOCABULARIES[name] if isinstance(name, str) else name
    return spark.createDataFrame([(i, v, *pair) for i, (v, pair) in enumerate(words.items())], "v_ord long, variant string, negative string, positive string")


def prompt_pairs(words: DataFrame, templates: DataFrame) -> DataFrame:
    """(pair, template_key, variant, negative, positive): every wording in every template, wording after wording."""
    t = words.join(F.broadcast(templates))
    fill = lambda c: T.fill_template(F.col("template"), F.col(c)).alias(c)
    size = templates.count()
    return t.select((F.col("v_ord") * size + F.col("t_ord")).cast("long").alias("pair"), "template_key", "variant", fill("negative"), fill("positive"))


def text_matrix(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(row, kind, vec): unit vectors of negative and positive prompt of each pair in turn, then the two ensembles made of the same pairs.

    vectors: (prompt, vec). A prompt without a vector fails the query.
    """
    each = pairs.select("pair", F.posexplode(F.array("negative", "positive")).alias("side", "prompt"))
    each = each.join(vectors.withColumnRenamed("prompt", "__p"), F.col("prompt") == F.col("__p"), "left").drop("__p")
    each = each.withColumn("vec", V.unit(F.when(F.col("vec").isNull(), F.raise_error(F.lit("a prompt has no vector"))).otherwise(F.col("vec"))))
    rows = each.select((2 * F.col("pair") + F.col("side")).alias("row"), F.lit("prompt").alias("kind"), "vec")
    means = V.mean_by(each, ["side"], "vec", "m").select((F.lit(2 * pairs.count()).cast("long") + F.col("side")).alias("row"), F.lit("ensemble").alias("kind"), V.unit_class(F.col("m")).alias("vec"))
    return rows.unionByName(means)


def pair_grid(tiles: DataFrame, matrix: DataFrame) -> DataFrame:
    """(tile columns, pair, prob): for each pair of rows of a wide matrix the positive's share of a softmax of two; the last pair is the ensemble.

    The matrix is a bounded dimension, one array that rides along; no pair of rows is joined.
    """
    table = matrix.groupBy(F.floor(F.col("row") / 2).alias("pair")).agg(F.max(F.when(F.col("row") % 2 == 0, F.struct("vec"))).alias("n"), F.max(F.when(F.col("row") % 2 == 1, F.struct("vec"))).alias("p"))
    table = table.agg(F.array_sort(F.collect_list(F.struct("pair", F.col("n.vec").alias("n"), F.col("p.vec").alias("p")))).alias("pairs"))
    prob = lambda x: 1.0 / (1.0 + F.exp(V.dot(F.col("embedding"), x["n"]) - V.dot(F.col("embedding"), x["p"])))
    both = tiles.join(F.broadcast(table))
    return both.select(*[c for c in tiles.columns if c != "embedding"], F.inline(F.transform("pairs", lambda x: F.struct(x["pair"].alias("pair"), prob(x).alias("prob")))))

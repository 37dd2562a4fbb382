"""Scans that end in canonical tables; label maps are parameters or the fixed values below."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aperture.functions import text as T
from aperture.functions.scalars import safe_double

#: Class codes before the first dash of a file name, in label order.
PREFIX_CODES = ["ADI", "BACK", "DEB", "LYM", "MUC", "MUS", "NORM", "STR", "TUM"]
#: One-hot columns and the classes that they mean.
GRADE_CLASSES = {"NC": 0, "G3": 1, "G4": 2, "G5": 3, "G4C": 2}
#: File name prefixes by priority, and the labels of external slides.
PREFIX_PRIORITY = ["is", "iv", "b", "n"]
EXTERNAL_LABELS = {"0": 0, "neg": 0, "negative": 0, "0.0": 0, "1": 1, "pos": 1, "macro": 1, "micro": 1, "1.0": 1}
IMAGE_TYPES = ["tif", "tiff", "png", "jpg", "jpeg"]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def first_existing(spark: SparkSession, *paths: str) -> str:
    for path in paths:
        fs, p = _fs(spark, path)
        if fs.exists(p):
            return path
    raise FileNotFoundError(f"none of {paths} exists")


def split_files(spark: SparkSession, folder: str, split: str, columns: list[str] | None = None) -> DataFrame:
    """`split`-*.parquet or `split`.parquet of a folder; only the columns asked for are read."""
    fs, p = _fs(spark, f"{folder}/{split}-*.parquet")
    found = sorted(str(x.getPath()) for x in fs.globStatus(p) or [])
    found = found or [first_existing(spark, f"{folder}/{split}.parquet")]
    df = spark.read.parquet(*found)
    return df.select(*columns) if columns else df


def numbered(df: DataFrame, into: str = "row") -> DataFrame:
    """Rows numbered 0, 1, ... in the order of the scan; only the sizes of partitions reach the driver."""
    t = df.withColumn("__m", F.monotonically_increasing_id())
    part = F.shiftright("__m", 33)
    sizes = sorted((r.p, r.n) for r in t.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    starts = df.sparkSession.createDataFrame(starts, "__p long, __s long")
    out = t.join(F.broadcast(starts), part == F.col("__p"))
    return out.withColumn(into, F.col("__s") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m", "__p", "__s")


def image_rows(df: DataFrame, label: str = "label") -> DataFrame:
    """(id, label, image) of a table with an image struct; a row without a path is named by its number in the table."""
    df = df if "row" in df.columns else numbered(df)
    return df.select(F.coalesce(T.blank_to_null(F.col("image.path")), F.concat(F.lit("row"), F.col("row").cast("string"))).alias("id"), F.col(label).cast("int").alias("label"), "image")


def composed_label(organ, label):
    return F.when(organ == 0, label).otherwise(label + 3)


def files_by_class(spark: SparkSession, root: str, classes: dict[str, int]) -> DataFrame:
    """(id, label) of images in a folder per class; a class without a folder is an error."""
    for name in classes:
        first_existing(spark, f"{root}/{name}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    kind = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    by = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    return files.where(kind.isin(IMAGE_TYPES)).select(F.col("path").alias("id"), F.try_element_at(by, T.parent(F.col("path"))).alias("label")).where("label is not null")


def label_by_parent_or_prefix(path, parents: dict[str, int], prefixes: list[tuple[str, int]]):
    """The parent folder's label, else that of the first prefix of the file name, else null."""
    by = F.create_map(*[F.lit(x) for kv in parents.items() for x in kv])
    folder, name = F.replace(F.lower(F.trim(T.parent(path))), F.lit(" "), F.lit("_")), F.lower(T.stem(path))
    out = F.lit(None).cast("int")
    for prefix, label in reversed(prefixes):
        out = F.when(name.startswith(prefix), F.lit(label)).otherwise(out)
    return F.coalesce(F.try_element_at(by, folder), out)


def prefix_code_label(path, codes: list[str] = PREFIX_CODES):
    at = F.array_position(F.array(*map(F.lit, codes)), F.substring_index(T.basename(path), "-", 1)).cast("int")
    return F.nullif(at, F.lit(0)) - 1


def one_hot_label(columns: list[str], classes: dict[str, int]):
    """The class of the largest of one-hot columns, the first of equals."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    return F.get(F.array(*[F.lit(classes[c]) for c in columns]), F.array_position(values, F.array_max(values)).cast("int") - 1)


def single_positive(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with no null and exactly one 1 of `columns`, with the label of that one."""
    flags = F.array(*[F.col(c).cast("int") for c in columns])
    ok = F.forall(flags, lambda x: x.isNotNull()) & (F.size(F.filter(flags, lambda x: x == 1)) == 1)
    return df.where(ok).withColumn("label", F.array_position(flags, 1).cast("int") - 1)


def csv_partition(spark: SparkSession, path: str, split: str, labels: dict[str, int], split_col: str, label_col: str) -> DataFrame:
    df = spark.read.csv(path, header=True)
    df = df if split == "all" else df.where(F.col(split_col) == split)
    by = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return df.withColumn("label", F.try_element_at(by, F.col(label_col)))


def by_header(spark: SparkSession, paths: list[str], path_column: str | None = None) -> DataFrame:
    """Many CSV files as one table of texts, each by its own header: columns are met by name, and one that a file lacks is null.

    Spark reads files together by place, under the first one's header. So headers are read first, a line of each file, in tasks, and files of
    the same header are read together. A folder stands for its files; an empty file has no rows.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    heads = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "n").alias("head"))  # the first line of the file's first split
    groups = heads.groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("head").collect()  # paths alone
    found = None
    for g in groups:
        df = spark.read.csv(g.files, header=True, enforceSchema=False)
        df = df.withColumn(path_column, F.input_file_name()) if path_column else df
        found = df if found is None else found.unionByName(df, allowMissingColumns=True)
    return found if found is not None else spark.createDataFrame([], f"{path_column} string" if path_column else "_none string")


def prediction_records(spark: SparkSession, paths: list[str], numbers=("max_prob", "avg_prob"), wholes=("gt", "pred", "n_tiles"), path_column: str | None = None) -> DataFrame:
    """Prediction CSVs as one table, each file by its own header; whole numbers may be written as 1.0."""
    df = by_header(spark, paths, path_column)
    return df.withColumns({c: safe_double(F.col(c)) for c in numbers if c in df.columns} | {c: safe_double(F.col(c)).cast("int") for c in wholes if c in df.columns})


def in_range(df: DataFrame, classes: int, column: str = "label") -> DataFrame:
    """Rows as they are; one whose label is not in [0, classes) fails the query."""
    x = F.col(column)
    return df.withColumn(column, F.when((x < 0) | (x >= classes), F.raise_error(F.lit("a label is out of range"))).otherwise(x))


def slide_table(df: DataFrame) -> DataFrame:
    """(filepath, gt, group, slide, patient_id) of any of three dialects, told apart by their columns."""
    have, path = set(df.columns), lambda a, b: F.concat_ws("/", F.col(a).cast("string"), F.col(b).cast("string"))
    if {"organ", "folder"} <= have:
        gt = safe_double(F.col("label").cast("string"))
        df = df.where(gt.isin([0.0, 1.0])).where("folder is not null and file_name is not null")
        group, slide = F.coalesce(F.col("organ"), F.lit("unknown")), T.stem(F.col("file_name"))
        own = F.concat_ws("::", group, F.lit("SLIDE"), slide)
        return df.select(path("folder", "file_name").alias("filepath"), gt.cast("int").alias("gt"), group.alias("group"), slide.alias("slide"), F.coalesce(T.accession(F.col("Bnumber")), own).alias("patient_id"))
    if {"dataset", "file_path"} <= have:
        by = F.create_map(*[F.lit(x) for kv in EXTERNAL_LABELS.items() for x in kv])
        df = df.withColumn("gt", F.try_element_at(by, F.col("label").cast("string"))).where("gt is not null")
        case = F.col("case") if "case" in have else F.lit(None).cast("string")
        return df.select(F.col("file_path").alias("filepath"), "gt", F.coalesce(F.col("dataset"), F.lit("unknown")).alias("group"), T.stem(F.col("file_name")).alias("slide"), T.case_id(F.col("dataset"), case, F.col("file_name")).alias("patient_id"))
    ok = (F.coalesce(F.lower("consent"), F.lit("")) != "abgelehnt") & (F.trim("Topographie") == "Lymphknoten") & F.col("class").isin([0.0, 1.0])
    slide = T.stem(F.col("Filename"))
    return df.where(ok).select(path("Folder", "Filename").alias("filepath"), F.col("class").cast("int").alias("gt"), F.lit("crc").alias("group"), slide.alias("slide"), F.concat(F.lit("crc::SLIDE::"), slide).alias("patient_id"))


def excel(spark: SparkSession, path: str) -> DataFrame:
    """A spreadsheet through pandas; needs a reader such as openpyxl to be installed."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path))


def manifest(spark: SparkSession, path: str, rows: int, n: int | None = None) -> DataFrame:
    """A manifest by pair_index; if there is none, bare indices. Its length must be `rows`; `n` keeps the first n pairs."""
    try:
        df = spark.read.csv(first_existing(spark, path), header=True).withColumn("pair_index", F.col("pair_index").cast("bigint"))
    except FileNotFoundError:
        df = spark.range(rows).withColumnRenamed("id", "pair_index")
    if (found := df.count()) != rows:
        raise ValueError(f"the manifest has {found} rows, not {rows}")
    return df.where(F.col("pair_index") < n) if n is not None else df


def captions(df: DataFrame, column: str = "json") -> DataFrame:
    """(uuid, caption) of JSON objects: a list of objects, an object of texts, or an object of objects."""
    schema = "struct<uuid:string,image_id:string,id:string,filename:string,file_name:string,caption:string,title:string,text:string,description:string>"
    c = F.trim(F.col(column))
    entry = lambda key, raw: F.struct(key.alias("key"), raw.alias("raw"))
    lists = F.transform(F.from_json(c, "array<string>"), lambda x: entry(F.lit(None).cast("string"), x))
    maps = F.transform(F.map_entries(F.from_json(c, "map<string,string>")), lambda x: entry(x["key"], x["value"]))
    t = df.select(F.explode(F.when(c.startswith("["), lists).otherwise(maps)).alias("e")).select("e.*")
    o = F.from_json("raw", schema)
    plain = F.when(~F.ltrim("raw").startswith("{"), F.col("raw"))
    t = t.withColumns({"o": o, "plain": plain})
    return t.select(T.first_filled(*[F.col(f"o.{x}") for x in ("uuid", "image_id", "id", "filename", "file_name")], F.col("key")).alias("uuid"), T.first_filled(F.col("plain"), *[F.col(f"o.{x}") for x in ("caption", "title", "text", "description")]).alias("caption"))


def qa_pairs(df: DataFrame, keep: list[str], n: int = 5) -> DataFrame:
    """A row for each i with Question_i and Answer_i, as one text."""
    pairs = F.array(*[F.struct(F.lit(i).alias("ix"), T.blank_to_null(F.col(f"Question_{i}")).alias("q"), T.blank_to_null(F.col(f"Answer_{i}")).alias("a")) for i in range(1, n + 1)])
    return df.select(*keep, F.explode(pairs).alias("p")).where("p.q is not null and p.a is not null").select(*keep, "p.ix", F.concat(F.lit("Question: "), F.col("p.q"), F.lit(" Answer: "), F.col("p.a")).alias("text"))


def pooled_texts(pairs: DataFrame, key: str, caption: str | None = None) -> DataFrame:
    """One row an item with its texts in order, its caption first if one is asked for."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ix", "text"))), lambda x: x["text"])
    if caption is None:
        return pairs.groupBy(key).agg(texts.alias("texts"))
    return pairs.groupBy(key).agg(F.concat(F.array(F.first(caption)), texts).alias("texts"))


def polygons(df: DataFrame, column: str, wanted: str, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """(polygon, ring) of GeoJSON features whose class contains `wanted` (any case; unnamed ones too), moved by the offset; rings under 3 points go."""
    schema = "struct<features:array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<classification:struct<name:string>>>>>"
    t = df.select(F.posexplode(F.from_json(column, schema)["features"]).alias("polygon", "f"))
    name = F.col("f.properties.classification.name")
    t = t.where(T.blank_to_null(name).isNull() | F.contains(F.lower(name), F.lit(wanted.lower())))
    c = F.col("f.geometry.coordinates")
    one = F.transform(F.from_json(c, "array<array<array<double>>>"), lambda r: r)
    many = F.flatten(F.from_json(c, "array<array<array<array<double>>>>"))
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", many).when(F.col("f.geometry.type") == "Polygon", one)
    t = t.select("polygon", F.posexplode(rings).alias("ring", "points")).where(F.size("points") >= 3)
    return t.withColumn("points", F.transform("points", lambda p: F.array(F.get(p, 0) + dx, F.get(p, 1) + dy)))


def lookup_rows(df: DataFrame, columns: list[str], caption: str, n: int | None = None, strict: bool = False) -> DataFrame:
    """Rows with all of `columns` and a caption that is not blank, `n` of them at most if asked; a missing column is an error, and so is one more if `strict`."""
    if missing := [c for c in (*columns, caption) if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    if strict and (more := [c for c in df.columns if c not in (*columns, caption)]):
        raise ValueError(f"columns not expected: {', '.join(more)}")
    out = df.na.drop(subset=columns).where(T.blank_to_null(F.col(caption)).isNotNull())
    return out.limit(n) if n is not None else out


def existing_only(df: DataFrame, path: str, listing: DataFrame, skip: bool = True) -> DataFrame:
    """Rows whose file is in `listing` (path); with skip=False a row without its file fails the query."""
    found = listing.select(F.col("path").alias("__p")).distinct()
    if skip:
        return df.join(found, F.col(path) == F.col("__p"), "left_semi")
    both = df.join(found, F.col(path) == F.col("__p"), "left")
    return both.where(F.when(F.col("__p").isNull(), F.raise_error(F.lit("a file is missing"))).otherwise(F.lit(True))).drop("__p")


def table_key(path):
    """internal or external if the name says so, else its safe stem."""
    s = F.lower(T.stem(path))
    return F.when(s.contains("internal"), "internal").when(s.contains("external"), "external").otherwise(T.safe_name(T.stem(path)))


def at_least(df: DataFrame, n: int = 2) -> DataFrame:
    if len(df.take(n)) < n:
        raise ValueError(f"fewer than {n} rows")
    return df


def resolve_keys(asked: str, known: list[str]) -> list[str]:
    """`all`, or a comma list of known keys."""
    keys = list(known) if asked == "all" else [k.strip() for k in asked.split(",") if k.strip()]
    if unknown := [k for k in keys if k not in known]:
        raise KeyError(f"unknown: {', '.join(unknown)}")
    return keys


#: Folders of grades and their labels.
GRADE_FOLDERS = {"BC_IDC_Grade_1": 0, "BC_IDC_Grade_2": 1, "BC_IDC_Grade_3": 2}


def graded_files(spark: SparkSession, root: str, split: str, grades: dict[str, int] = GRADE_FOLDERS) -> DataFrame:
    """(id, label) of the images right in root/grade/split; a grade without that folder is an error."""
    folders = {first_existing(spark, f"{root}/{g}/{split}"): n for g, n in grades.items()}
    files = spark.read.format("binaryFile").load([f"{x}/*" for x in folders]).select("path")
    grade = F.regexp_extract("path", r"([^/]*)/[^/]*/[^/]*$", 1)
    by = F.create_map(*[F.lit(x) for kv in grades.items() for x in kv])
    return files.where(F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).isin(IMAGE_TYPES)).select(F.col("path").alias("id"), F.try_element_at(by, grade).alias("label"))


def files_by_parent_or_prefix(spark: SparkSession, roots: list[str], parents: dict[str, int], prefixes: list[tuple[str, int]]) -> DataFrame:
    """(id, label) of the images under the first of `roots` that exists, labelled by parent folder, else by the first prefix; others go."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(first_existing(spark, *roots)).select("path")
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).isin(IMAGE_TYPES))
    return files.select(F.col("path").alias("id"), label_by_parent_or_prefix(F.col("path"), parents, prefixes).alias("label")).where("label is not null")


def prefix_code_files(spark: SparkSession, root: str, split: str = "all", codes: list[str] = PREFIX_CODES) -> DataFrame:
    """(id, label) of the images of root/split (`all`: of every folder), labelled by the code before the first dash; others go."""
    folder = root if split == "all" else first_existing(spark, f"{root}/{split}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return files.select(F.col("path").alias("id"), prefix_code_label(F.col("path"), codes).alias("label")).where("label is not null")


#: Dataset loaders by key: each takes (spark, root, split, options) and gives (id, label, ...); others may be added.
LOADERS: dict[str, Callable[..., DataFrame]] = {
    "parquet": lambda spark, root, split, o: image_rows(split_files(spark, root, split), o.get("label", "label")),
    "class_folders": lambda spark, root, split, o: files_by_class(spark, f"{root}/{split}" if split else root, o["classes"]),
    "graded_folders": lambda spark, root, split, o: graded_files(spark, root, split, o.get("grades", GRADE_FOLDERS)),
    "parent_or_prefix": lambda spark, root, split, o: files_by_parent_or_prefix(spark, [f"{root}/{x}" for x in o.get("roots", [""])], o["parents"], o["prefixes"]),
    "prefix_codes": lambda spark, root, split, o: prefix_code_files(spark, root, split or "all", o.get("codes", PREFIX_CODES)),
    "csv": lambda spark, root, split, o: csv_partition(spark, f"{root}/{o['file']}", split, o["labels"], o.get("split_col", "split"), o.get("label_col", "class")),
}


def load(spark: SparkSession, registry: dict[str, dict], key: str, root: str) -> DataFrame:
    """The dataset of a registry entry by its loader; a label outside its classes fails the query, an unknown key or loader at once."""
    if key not in registry:
        raise KeyError(f"unknown dataset {key}; known: {', '.join(sorted(registry))}")
    spec = registry[key]
    if spec["loader"] not in LOADERS:
        raise KeyError(f"unknown loader {spec['loader']}")
    df = LOADERS[spec["loader"]](spark, f"{root}/{spec.get('dir', key)}", spec.get("split", ""), spec.get("options", {}))
    return in_range(df, len(spec["class_names"]))


def dataset_dimension(spark: SparkSession, registry: dict[str, dict]) -> DataFrame:
    """(key, loader, dir, split, class_names, num_classes): a row a dataset, classes counted."""
    rows = [(k, s["loader"], s.get("dir", k), s.get("split", ""), list(s["class_names"])) for k, s in registry.items()]
    return spark.createDataFrame(rows, "key string, loader string, dir string, split string, class_names array<string>").withColumn("num_classes", F.size("class_names"))


def model_dimension(spark: SparkSession, registry: dict[str, dict]) -> DataFrame:
    """(key, family, dir, extra): a row a model; extra options as JSON."""
    rows = [(k, s["family"], s.get("dir", k), json.dumps(s.get("extra", {}), sort_keys=True)) for k, s in registry.items()]
    return spark.createDataFrame(rows, "key string, family string, dir string, extra string")


def valid_cache(df: DataFrame, vector: str = "embedding", dim: int | None = None) -> DataFrame:
    """Cached rows whose vector can be used: not null, not empty, of `dim` if given, the same length as most if not, all components finite."""
    ok = F.size(F.coalesce(F.col(vector), F.array().cast(df.schema[vector].dataType))) > 0
    df = df.where(ok & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    if dim is None:
        usual = df.groupBy(F.size(vector).alias("__d")).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), "__d").limit(1)
        return df.join(F.broadcast(usual.select("__d")), F.size(vector) == F.col("__d")).drop("__d")
    return df.where(F.size(vector) == dim)


def readable(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The caches that exist as one table, damaged files left out; None if there are none. A model's missing dataset is skipped."""
    found = [p for p in paths if _fs(spark, p)[0].exists(_fs(spark, p)[1])]
    return spark.read.option("ignoreCorruptFiles", True).parquet(*found) if found else None


def cached_pairs(spark: SparkSession, folder: str, models: list[str], datasets: list[str]) -> DataFrame:
    """(model, dataset) of the caches folder/model=../dataset=.. that exist, of those asked for; the rest are skipped."""
    fs, p = _fs(spark, f"{folder}/model=*/dataset=*")
    names = [tuple(part.split("=", 1)[1] for part in str(x.getPath()).split("/")[-2:]) for x in fs.globStatus(p) or []]
    return spark.createDataFrame(sorted((m, d) for m, d in names if m in models and d in datasets), "model string, dataset string")


def score_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(table, model, path) of the files table__model.csv of a folder."""
    fs, p = _fs(spark, f"{folder}/*__*.csv")
    rows = [(*stem.split("__", 1), str(x.getPath())) for x in fs.globStatus(p) or [] if (stem := x.getPath().getName().removesuffix(".csv"))]
    return spark.createDataFrame(sorted(rows), "table string, model string, path string")


def models_of_all(tables: DataFrame, wanted: list[str]) -> DataFrame:
    """(model) that every wanted table has a file of."""
    t = tables.where(F.col("table").isin(wanted)).groupBy("model").agg(F.count_distinct("table").alias("n"))
    return t.where(F.col("n") == len(set(wanted))).select("model")


def read_scores(spark: SparkSession, tables: DataFrame) -> DataFrame:
    """The rows of many score files with the table and model in their names."""
    df = prediction_records(spark, [r.path for r in tables.select("path").collect()], path_column="__path")
    name = F.element_at(F.split("__path", "/"), -1)
    return df.withColumns({"table": F.substring_index(name, "__", 1), "model": F.regexp_extract(name, r"__(.*)\.csv$", 1)}).drop("__path")


def config(spark: SparkSession, path: str, **changes) -> dict:
    """A JSON config (or YAML, if a reader is installed) as a new dict, with changes in place of its values; None changes nothing."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yml", ".yaml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    return found | {k: v for k, v in changes.items() if v is not None}


def sidecar(spark: SparkSession, path: str) -> dict:
    """The metadata beside an input, nothing if there is no file."""
    fs, p = _fs(spark, path)
    return config(spark, path) if fs.exists(p) else {}


def inputs_with_manifest(spark: SparkSession, vectors: DataFrame, manifests: list[str], n: int | None = None) -> DataFrame:
    """`vectors` (pair_index, ...) with the columns of the first manifest that exists, or with none of its own; the first n pairs if asked. A pair without its row fails the query."""
    vectors = vectors.where(F.col("pair_index") < n) if n is not None else vectors
    found = [p for p in manifests if _fs(spark, p)[0].exists(_fs(spark, p)[1])]
    if not found:
        return vectors
    rows = spark.read.csv(found[0], header=True).withColumn("pair_index", F.col("pair_index").cast("bigint")).withColumn("__here", F.lit(True))
    out = vectors.join(rows, "pair_index", "left")
    return out.where(F.when(F.col("__here").isNull(), F.raise_error(F.lit("a pair is not in the manifest"))).otherwise(F.lit(True))).drop("__here")


def shards(df: DataFrame, order: str, n: int, i: int) -> DataFrame:
    """One of n shards of about the same size, by the hash of a key; no order over all rows is needed."""
    return df.where(F.pmod(F.xxhash64(order), F.lit(n)) == i)

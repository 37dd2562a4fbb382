"""Writers: block upserts, append manifests, flat metrics, resumable builds."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aperture.operators.tables import upsert
from aperture.sources import versions as V
from aperture.sources.loaders import _fs


def replace_table(df: DataFrame, path: str, fmt: str = "parquet", grace: float = V.GRACE) -> None:
    """The whole table anew, as the newest version of `path`; whoever reads the one before keeps it (versions.read_current reads the newest)."""
    V.publish(df.sparkSession, path, lambda folder, _: df.write.format(fmt).option("header", True).save(f"{folder}/data"), grace=grace)


def merge_on_write(new: DataFrame, path: str, keys: list[str] | None = None, patience: float = 300.0, grace: float = V.GRACE) -> DataFrame:
    """Blocks of new rows replace the old rows of their keys: (model, table) if there is a table, else (model). Gives the version made.

    Writers at the same time lose nothing: who commits second merges again. A plain table at `path` is the base of the first version.
    """
    spark = new.sparkSession
    keys = keys or (["model", "table"] if "table" in new.columns else ["model"])

    def write(folder: str, base: str | None) -> None:
        whole = upsert(spark.read.parquet(V.part_of(spark, base, "data")), new, keys) if base else new
        whole.orderBy(*keys).write.parquet(f"{folder}/data")

    return spark.read.parquet(f"{V.publish(spark, path, write, patience, grace)}/data")


def merge_summary(new: DataFrame, path: str, keys: list[str] | None = None, patience: float = 300.0, grace: float = V.GRACE) -> DataFrame:
    """A summary as CSV and as JSON lines (parts csv and json): as merge_on_write, all columns as texts in the CSV. Both are of one version, so none is newer than the other."""
    spark = new.sparkSession
    keys = keys or (["model", "table"] if "table" in new.columns else ["model"])

    def write(folder: str, base: str | None) -> None:
        whole = upsert(spark.read.json(V.part_of(spark, base, "json")), new, keys) if base else new
        whole.orderBy(*keys).write.json(f"{folder}/json")
        spark.read.schema(whole.schema).json(f"{folder}/json").orderBy(*keys).write.option("header", True).csv(f"{folder}/csv")

    return spark.read.csv(f"{V.publish(spark, path, write, patience, grace)}/csv", header=True)


def append_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def appended(spark: SparkSession, path: str) -> DataFrame | None:
    """All blocks that append_unfinished has committed at `path`, and a plain table that was there before; None if there are none."""
    base = path.rstrip("/")
    fs, p = _fs(spark, base)
    plain = fs.exists(p) and any(not str(x.getPath().getName()).startswith(("_", ".")) for x in fs.listStatus(p))
    found = [spark.read.parquet(base)] if plain else []
    blocks = [f"{base}/{e['block']}" for e in V.Log(spark, base).all()]
    found += [spark.read.parquet(*blocks).drop("__reason")] if blocks else []
    return found[0].unionByName(found[1], allowMissingColumns=True) if len(found) > 1 else found[0] if found else None


def unfinished(work: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The rows of `work` that no earlier run has committed."""
    done = appended(work.sparkSession, path)
    return work if done is None else work.join(done.select(*keys).distinct(), keys, "left_anti")


def append_unfinished(work: DataFrame, path: str, keys: list[str], failed: Column | None = None, log: str | None = None, patience: float = 300.0) -> int:
    """Commit what is left as one more block; returns how many rows. Rows whose `failed` holds a reason go to `log` instead, and are tried again next time.

    What is left is computed once, into a block that counts only when its entry is in the log; of two
    builders at the same time the second looks again for what is left, so that no row is there twice.
    """
    spark, until = work.sparkSession, time.monotonic() + patience
    entries = V.Log(spark, path)
    while True:
        n = entries.last()
        name = f"_blocks/{n + 1:012d}-{uuid.uuid4().hex}"
        block = f"{path.rstrip('/')}/{name}"
        reason = failed.cast("string") if failed is not None else F.lit(None).cast("string")
        left = unfinished(work, path, keys).withColumn("__reason", reason).withColumn("__failed", F.col("__reason").isNotNull())
        left.write.partitionBy("__failed").parquet(f"{block}/rows")
        part = lambda failed: f"{block}/rows/__failed={failed}"
        fs, p = _fs(spark, part("false"))
        count = spark.read.parquet(part("false")).count() if fs.exists(p) else 0
        if not count or entries.add(n + 1, {"block": f"{name}/rows/__failed=false", "rows": count}):
            if log and fs.exists(_fs(spark, part("true"))[1]):
                append_manifest(spark.read.parquet(part("true")).select(*keys, F.col("__reason").alias("reason")), log)
            if not count:
                fs.delete(_fs(spark, block)[1], True)
            return count
        fs.delete(_fs(spark, block)[1], True)
        if time.monotonic() > until:
            raise TimeoutError(f"other writers of {path} were always first")


def write_cache(df: DataFrame, path: str, *by: str) -> None:
    """Partitioned by model and dataset, so one model's features never serve another; what is written again replaces its own partitions alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(by or ("model", "dataset"))).parquet(path)


def write_pooled(pooled: DataFrame, path: str, vectors: tuple[str, ...] = ("image_emb", "text_emb")) -> None:
    """Pooled vectors as a table by pair_index (part embeddings), and a manifest of all other columns (part manifest), of one version."""

    def write(folder: str, _: str | None) -> None:
        pooled.orderBy("pair_index").write.parquet(f"{folder}/embeddings")
        pooled.drop(*vectors).orderBy("pair_index").write.option("header", True).csv(f"{folder}/manifest")

    V.publish(pooled.sparkSession, path, write)


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """A report (ranks of pairs, top k, metrics) as CSV files with headers, in order from file to file; a version of `path`."""
    replace_table(df.orderBy(*order) if order else df, path, "csv")


def flat_metrics(nested: dict, prefix: str = "") -> dict[str, object]:
    """Dotted names of scalars; undefined numbers become null."""
    out: dict[str, object] = {}
    for k, v in nested.items():
        name = f"{prefix}{k}"
        if isinstance(v, dict):
            out |= flat_metrics(v, f"{name}.")
        elif v is None or isinstance(v, (bool, int, str)) or (isinstance(v, float) and v == v and abs(v) != float("inf")):
            out[name] = v
        elif isinstance(v, float):
            out[name] = None
    return out


def markdown(metrics: dict[str, object]) -> str:
    return "\n".join(["| metric | value |", "|---|---|", *(f"| {k} | {'' if v is None else v} |" for k, v in sorted(metrics.items()))])


def metric_rows(spark: SparkSession, metrics: dict) -> DataFrame:
    """(metric, value) of one run's metrics by dotted name; undefined numbers have no value."""
    rows = [(k, None if v is None else str(v)) for k, v in sorted(flat_metrics(metrics).items())]
    return spark.createDataFrame(rows, "metric string, value string")


def metrics_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(run, metric, value) of many metrics files, read by Spark and flattened file by file in Arrow batches."""
    import pyarrow as pa

    def flat(batches):
        for b in batches:
            out = [(path, k, None if v is None else str(v)) for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, v in sorted(flat_metrics(json.loads(data)).items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], ["run", "metric", "value"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(flat, "run string, metric string, value string")


def merge_shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.csv(folder, header=True)

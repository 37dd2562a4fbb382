"""Which files are there: a cached listing by folder, of which only folders that have changed are listed again."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aperture.sources import versions as V
from aperture.sources.shared import Scratch, _place

_STAT = "folder string, changed long, now long"
_LIST = "folder string, changed long, name string, is_folder boolean"


def _full(root: str, folder: str) -> str:
    return f"{root}/{folder}" if folder else root


def _stat(root: str):
    """(folder, changed, now): when each known folder was changed, then and now; null now if it is gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _place(root)
        for batch in batches:
            found = store.get_file_info([_full(top, f) for f in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.mtime_ns if i.type.name == "Directory" else None for i in found], pa.int64())], ["folder", "changed", "now"])

    return run


def _list(root: str, settle: float):
    """What is in each folder, one level deep, and a row without a name for the folder itself; a change so recent that another may share its time counts as unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = _place(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                own = store.get_file_info([_full(top, folder)])[0]
                if own.type.name != "Directory":
                    continue
                at = own.mtime_ns if time.time() - own.mtime_ns / 1e9 >= settle else -1
                inside = store.get_file_info(fs.FileSelector(_full(top, folder), recursive=False))
                names, kinds = [None, *(x.base_name for x in inside)], [None, *(x.type.name == "Directory" for x in inside)]
                for p in range(0, len(names), 10_000):
                    n = len(names[p : p + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array([folder] * n), pa.array([at] * n, pa.int64()), pa.array(names[p : p + n], pa.string()), pa.array(kinds[p : p + n], pa.bool_())], ["folder", "changed", "name", "is_folder"])

    return run


class PresentSet:
    """The files under `root`, as a versioned table at `cache` (parts folders and files).

    A folder's time of change tells whether names in it came or went (as local folders, network mounts and HDFS keep it), so a refresh asks for
    the time of each known folder, in tasks, and lists again those that differ and those that are new. Object
    stores keep no such times: there each refresh lists all.
    """

    def __init__(self, spark: SparkSession, root: str, cache: str, settle: float = 2.0):
        self.spark, self.root, self.cache, self.settle = spark, root.rstrip("/"), cache, settle

    def _part(self, base: str | None, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{base}/{name}") if base else self.spark.createDataFrame([], schema)

    def refresh(self, patience: float = 300.0, grace: float = V.GRACE) -> int:
        """Bring the table up to date; returns how many folders were listed. Nothing is written if none was, and none is gone."""
        base, scratch = V.current(self.spark, self.cache), Scratch(self.spark, "present")
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        known = self._part(base, "folders", "folder string, changed long")
        seen = scratch.table(known.repartition(parts).mapInArrow(_stat(self.root), _STAT), "seen")
        stale = seen.where("now IS NULL OR now <> changed").select("folder")
        todo = stale if base else self.spark.createDataFrame([("",)], "folder string")
        listed, rounds = None, 0
        while not todo.isEmpty():
            found = scratch.table(todo.repartition(parts).mapInArrow(_list(self.root, self.settle), _LIST), f"listed-{rounds}")
            listed, rounds = found if listed is None else listed.union(found), rounds + 1
            below = found.where("is_folder").select(F.concat_ws("/", F.nullif(F.col("folder"), F.lit("")), F.col("name")).alias("folder"))
            todo = below.join(known.select("folder"), "folder", "left_anti")
        if listed is None:
            scratch.drop()
            return 0

        def write(folder: str, based: str | None) -> None:
            keep = lambda t: t.join(stale, "folder", "left_anti").join(listed.select("folder").distinct(), "folder", "left_anti")
            keep(self._part(base, "folders", "folder string, changed long")).union(listed.where("name IS NULL").select("folder", "changed")).write.parquet(f"{folder}/folders")
            keep(self._part(base, "files", "folder string, name string")).union(listed.where("NOT is_folder").select("folder", "name")).write.parquet(f"{folder}/files")

        V.publish(self.spark, self.cache, write, patience, grace)
        n = listed.where("name IS NULL").count()
        scratch.drop()
        return n

    def paths(self) -> DataFrame:
        """(path) of the files, relative to the root, as of the last refresh."""
        base = V.current(self.spark, self.cache)
        return self._part(base, "files", "folder string, name string").select(F.concat_ws("/", F.nullif(F.col("folder"), F.lit("")), F.col("name")).alias("path"))

    def only(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose file is there. An equal join of a large listing, which Spark may filter by a Bloom filter first (spark.sql.optimizer.runtime.bloomFilter.enabled)."""
        found = self.paths().select(F.col("path").alias("__present")).distinct()
        return rows.join(found, F.col(column) == F.col("__present"), "left_semi")

"""The folder that all executors share: scratch tables that cut lineage, and files that tasks write and map."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set and all runs in this process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="aperture-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's own setting: the shuffle files of a query go when it has ended, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables and files in the shared folder that cut lineage; all go when Python ends, or earlier by drop()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        atexit.register(self.drop)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` and read it back; the shuffle files that writing took go as soon as it is done."""
        path, before = f"{self.root}/{name}", self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        """All goes when the block ends: for results that have been written or collected by then."""
        self.drop()

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def last(self, df: DataFrame, name: str, *also: str) -> DataFrame:
        """Write `df` as a table; all others of this scratch go, but those in `also`."""
        out = self.table(df, name)
        self.only(name, *also)
        return out

    def only(self, *names: str) -> None:
        """Remove all tables but the named ones."""
        for name in self.names - set(names):
            self.drop(name)

    def drop(self, *names: str) -> None:
        """Remove the named tables, or all."""
        for name in names or ("",):
            self._drop(name)
            self.names.discard(name)

    def _drop(self, name: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may have ended before Python does
            if urlparse(self.root).scheme in ("", "file"):
                import shutil

                shutil.rmtree(os.path.join(urlparse(self.root).path, name), ignore_errors=True)


def _place(uri: str):
    """(file system, path) of a file in the shared folder: a mount, or whatever store pyarrow reaches."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def write_shared(uri: str, parts) -> None:
    """Write a new file whole: beside its place first, then renamed, so that no reader meets half a file."""
    store, path = _place(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    store.move(own, path)


def is_mounted(uri: str) -> bool:
    return urlparse(uri).scheme in ("", "file")


def open_shared(uri: str):
    store, path = _place(uri)
    return store.open_input_file(path)


def map_shared(uri: str, dtype) -> np.ndarray:
    """An array memory-mapped where the shared folder is mounted; read whole from any other store."""
    if is_mounted(uri):
        path = urlparse(uri).path
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with open_shared(uri) as f:
        return np.frombuffer(f.read(), dtype)

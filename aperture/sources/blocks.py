"""A store of records built block by block: keys without gaps, a marker of progress in each commit, and an index from keys to files.

Input rows are numbered (0, 1, ...) and taken in blocks. A block's records are written as files in the order of the rows, and one entry of
the log commits it: how far the input is done, the first key, and how many records each file has. A record's key is the first key of its
file and its place there, so failed rows leave no hole, nothing is renumbered, and a builder that was stopped
between writing a block and committing it writes that block again under the same keys.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aperture.sources import versions as V
from aperture.sources.loaders import _fs
from aperture.sources.sinks import append_manifest


class BlockStore:
    """The store at `path`. Two builders may run; of a block that both write only one's commit counts, and the other goes on from it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), V.Log(spark, path)

    # ------------------------------------------------------------------ building

    def progress(self) -> tuple[int, int]:
        """(input rows done, records written) of the commits so far."""
        n = self.log.last()
        if not n:
            return 0, 0
        e = self.log.read(n)
        return e["done"], e["first_key"] + sum(f[1] for f in e["files"])

    def build(self, work: DataFrame, row: str, encode: Callable[[DataFrame], DataFrame] | None = None, failed: str | None = None, block: int = 100_000, failures: str | None = None, files: int | None = None) -> tuple[int, int]:
        """Go on until all of `work` is done; gives (records, failures) of this run.

        `row` numbers the input. `encode` adds what is to be stored, row by row; a row whose column `failed` is then not
        null has no record, and goes to the CSV log `failures` with that reason. Each block is computed once.
        """
        end = work.agg(F.max(row)).first()[0]
        made = lost = 0
        while end is not None and self.progress()[0] <= end:
            good, bad, won = self._block(work, row, encode, failed, block, failures, files, end)
            made, lost = made + good * won, lost + bad * won
        return made, lost

    def _block(self, work, row, encode, failed, block, failures, files, end) -> tuple[int, int, bool]:
        number = self.log.last() + 1
        start, first_key = self.progress()
        part = work.where((F.col(row) >= start) & (F.col(row) < start + block))
        part = part.repartitionByRange(files, row) if files else part.repartitionByRange(row)
        part = encode(part) if encode else part
        reason = F.col(failed).cast("string") if failed else F.lit(None).cast("string")
        part = part.withColumn("__reason", reason).withColumn("__lost", reason.isNotNull())
        folder = f"{self.path}/_blocks/{number:012d}-{uuid.uuid4().hex}"
        part.sortWithinPartitions("__lost", row).write.partitionBy("__lost").parquet(folder)
        good, bad = f"{folder}/__lost=false", f"{folder}/__lost=true"
        sizes = []
        if self._exists(good):
            name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
            found = self.spark.read.parquet(good).groupBy(name.alias("file")).agg(F.count("*").alias("n"), F.min(row).alias("first")).orderBy("first").collect()  # a row per file of one block
            sizes = [[f"{folder.removeprefix(self.path + '/')}/__lost=false/{r.file}", r.n] for r in found]
        bad_rows = self.spark.read.parquet(bad) if self._exists(bad) else None
        entry = {"done": min(start + block, end + 1), "first_key": first_key, "files": sizes, "failed": 0 if bad_rows is None else bad_rows.count()}
        if not self.log.add(number, entry):  # another builder has committed this block
            fs, p = _fs(self.spark, folder)
            fs.delete(p, True)
            return 0, 0, False
        if failures and bad_rows is not None:
            append_manifest(bad_rows.select(row, F.col("__reason").alias("reason")), failures)
        return sum(n for _, n in sizes), entry["failed"], True

    def _exists(self, path: str) -> bool:
        fs, p = _fs(self.spark, path)
        return fs.exists(p)

    # ------------------------------------------------------------------ reading

    def index(self) -> list[tuple[int, int, str]]:
        """(first key, keys, file) of every committed file, in the order of keys."""
        out = []
        for e in self.log.all():
            key = e["first_key"]
            for file, n in e["files"]:
                out.append((key, n, file))
                key += n
        return out

    def __len__(self) -> int:
        return self.progress()[1]

    def records(self) -> DataFrame:
        """All records with their key; the index, a row for each file, is joined by file name."""
        return self._keyed(self.index())

    def _keyed(self, files: list[tuple[int, int, str]]) -> DataFrame:
        if not files:
            raise LookupError(f"{self.path} has no records")
        starts = self.spark.createDataFrame([(f, k) for k, _, f in files], "__file string, __first long")
        read = self.spark.read.parquet(*[f"{self.path}/{f}" for _, _, f in files])
        tail = F.concat_ws("/", F.slice(F.split(F.col("_metadata.file_path"), "/"), -4, 4))
        read = read.withColumns({"__at": F.col("_metadata.row_index"), "__name": tail})
        out = read.join(F.broadcast(starts), F.col("__name") == F.col("__file"))
        return out.withColumn("key", F.col("__first") + F.col("__at")).drop("__file", "__first", "__at", "__name", "__reason")

    def lookup(self, *keys: int) -> DataFrame:
        """The records of the keys; only the files that hold them are opened. A key that there is not is a KeyError."""
        index = self.index()
        starts, wanted = [k for k, _, _ in index], {}
        for key in keys:
            at = bisect_right(starts, key) - 1
            if at < 0 or key >= index[at][0] + index[at][1]:
                raise KeyError(f"no record {key} in {self.path}")
            wanted[at] = index[at]
        return self._keyed(list(wanted.values())).where(F.col("key").isin(*keys))

    def check(self, group: str | None = None) -> int:
        """How many records there are; RuntimeError where the log and the files differ, keys have a gap, or a record lacks its group."""
        index, expected = self.index(), 0
        for key, n, file in index:
            if key != expected:
                raise RuntimeError(f"{self.path}: {file} begins at {key}, not {expected}")
            expected += n
            if not self._exists(f"{self.path}/{file}"):
                raise RuntimeError(f"{self.path}: {file} is missing")
        if index:
            name = F.concat_ws("/", F.slice(F.split(F.col("_metadata.file_path"), "/"), -4, 4))
            empty = F.count_if(F.col(group).isNull()) if group else F.lit(0)
            found = {r.f: (r.n, r.e) for r in self.spark.read.parquet(*[f"{self.path}/{f}" for _, _, f in index]).groupBy(name.alias("f")).agg(F.count("*").alias("n"), empty.alias("e")).collect()}
            for _, n, file in index:
                if found.get(file, (0, 0))[0] != n:
                    raise RuntimeError(f"{self.path}: {file} has {found.get(file, (0, 0))[0]} records, not {n}")
                if found[file][1]:
                    raise RuntimeError(f"{self.path}: {file} has records without {group}")
        return expected

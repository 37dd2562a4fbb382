"""What the operators share: scratch tables, shared files, word hashing, prefix sums, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aperture.operators.prefix import running_sum  # noqa: F401
from aperture.sources.shared import Scratch, is_mounted, map_shared, open_shared, write_shared  # noqa: F401

#: The six bytes that separate words.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- words

_LONG = 64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, (_LONG, 256), np.uint64)
_TABLE[:, _IS_SPACE] = 0
_TABLE = _TABLE.ravel()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), with the fixed values of SplitMix64 (Steele, Lea and Flood, 2014)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one text after the other, and the n + 1 places between texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not n or column.buffers()[1] is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(column.buffers()[1], kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if column.null_count:  # a null may keep bytes that are not part of the column
        lengths = np.where(np.asarray(column.is_null()), 0, np.diff(off))
        if (lengths != np.diff(off)).any():
            return bytes_of(column.fill_null(""))
    if off[-1] == off[0]:
        return np.empty(0, np.uint8), off - off[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = False, chunk: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit tabulation hash of each word of each text, and where each text's words begin (n + 1 places)."""
    out, firsts, p, n = [], [], 0, len(data)
    while p < n:
        q = min(n, p + chunk)
        if q < n:  # cut at a space or between texts, so that no word is halved
            last = off[np.searchsorted(off, q, "right") - 1]
            gap = np.flatnonzero(_IS_SPACE[data[max(p, q - 4096) : q]])
            back = max(last, max(p, q - 4096) + gap[-1] if len(gap) else 0)
            if back > p:
                q = int(back)
            else:
                ahead = np.flatnonzero(_IS_SPACE[data[q:]])
                q = int(min(q + ahead[0] if len(ahead) else n, off[np.searchsorted(off, q, "left")]))
        part = data[p:q]
        if lower:
            part = _LOWER[part]
        space = _IS_SPACE[part]
        first = ~space
        inner = off[np.searchsorted(off, p, "right") : np.searchsorted(off, q, "left")] - p
        open_ = np.empty(len(part), bool)
        open_[0], open_[1:] = True, space[:-1]
        open_[inner] = True
        first &= open_
        at = np.flatnonzero(first)
        if len(at):
            run = np.diff(np.append(at, len(part)))
            place = np.arange(at[0], len(part), dtype=np.int32) - np.repeat(at.astype(np.int32), run)
            got = _TABLE.take(((place & (_LONG - 1)) << 8) | part[at[0] :])
            if run.max() > _LONG:
                got = got * ((place >> 6) * 2 + 1).astype(np.uint64)
            out.append(np.add.reduceat(got, at - at[0]))
            firsts.append(at + p)
        p = q
    if not out:
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64)
    return mix(np.concatenate(out)), np.searchsorted(np.concatenate(firsts), off, "left")


def batches(rows: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20, rows_most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text and of `rows_most` rows at most; one longer text is a batch of its own."""
    for batch in rows:
        if not batch.num_rows:
            continue
        _, off = bytes_of(batch.column(batch.schema.get_field_index(column)))
        p = 0
        while p < batch.num_rows:
            q = min(p + rows_most, max(p + 1, int(np.searchsorted(off, off[p] + most, "right")) - 1))
            yield batch.slice(p, q - p)
            p = q


# ---------------------------------------------------------------- components


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) of the nodes of `edges` (a, b); the component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step is a grouped
    minimum and a join, a hub's neighbours never meet in one task, and the number of rounds
    grows with the logarithm of the longest path. Each round's edges are written to the shared folder.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    cur = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    before, k = None, 0
    while True:
        sums = tuple(cur.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint")), F.sum("b")).first())
        if sums == before or not sums[0]:
            break
        before, k = sums, k + 1
        near = both(cur)
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        small = small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        cur = scratch.table(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()

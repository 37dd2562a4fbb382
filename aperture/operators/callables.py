"""Functions that a user brings: an encoder of texts, and statistics for the bootstrap.

A callable sees Arrow batches in tasks, never single rows. What it needs to be built (a model, a vocabulary) is
built by a factory, once in each worker process, and kept there for later tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aperture.operators import resample as B
from aperture.operators import scoring as P
from aperture.functions.scalars import resolve_scale

_BUILT: dict[str, object] = {}


def built(key: str, factory: Callable[[], object]):
    """What `factory` makes, made once in this process for the key."""
    if key not in _BUILT:
        _BUILT[key] = factory()
    return _BUILT[key]


class Encoder:
    """Texts to vectors: `factory` builds, in a worker, the callable that takes a list of texts and gives an array of as many rows."""

    def __init__(self, factory: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 256):
        self.factory, self.batch, self.key = factory, batch, uuid.uuid4().hex

    def encode(self, df: DataFrame, text: str, into: str = "vec") -> DataFrame:
        """`df` with the vector of its text: each different text is encoded once, and joined back. A null text has a null vector.

        As many rows as texts must come back, all of one length and finite; else the query fails. A text that very many rows share
        meets its vector by a join that adaptive execution can split.
        """
        once = df.where(F.col(text).isNotNull()).select(F.col(text).alias("__text")).distinct()
        once = once.mapInArrow(_encoding(self.factory, self.key, self.batch), "__text string, __vec array<double>")
        return df.join(once, F.col(text) == F.col("__text"), "left").withColumn(into, F.col("__vec")).drop("__text", "__vec")


def _encoding(factory, key: str, size: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from aperture.operators.callables import built as once

        for batch in rows:
            encode = once(key, factory)
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                texts = part.column(0).to_pylist()
                got = np.asarray(encode(texts), np.float64)
                if got.ndim != 2 or len(got) != len(texts) or not np.isfinite(got).all():
                    raise ValueError(f"the encoder gave {got.shape} for {len(texts)} texts, or numbers that are not finite")
                ends = pa.array(np.arange(0, got.size + 1, got.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(got.ravel()))], ["__text", "__vec"])

    return run


def zero_shot(items: DataFrame, prompts: DataFrame, encoder: Encoder, logit_scale: float | None = None, temperature: float | None = None) -> DataFrame:
    """(item_id, class_id, logit, prob) of `items` (item_id, embedding) by `prompts` (class_id, text): each class is the mean of its texts' vectors, made unit.

    One class has a sigmoid, more a softmax, at the temperature, else the logit scale, else 1 / 0.07. Classes are a bounded dimension.
    """
    classes = P.class_vectors(encoder.encode(prompts, "text").select("class_id", "vec"))
    n = prompts.select("class_id").distinct().count()
    scale = resolve_scale(F.lit(temperature).cast("double"), F.lit(logit_scale).cast("double"))
    return P.probabilities(P.logits(items, classes), n, items.sparkSession.range(1).select(scale).first()[0])


# ------------------------------------------------------------------ statistics


def bootstrap_sums(df: DataFrame, cluster: str, reps: int, parts: Callable[[dict[str, np.ndarray]], np.ndarray], final: Callable[[np.ndarray], dict[str, float]], names: list[str], keys: list[str] = (), columns: list[str] | None = None, seed: str = "b") -> DataFrame:
    """(keys, rep, names) of a statistic made of sums: `parts` gives for a batch's columns (arrays) a matrix of a few numbers a row, `final` turns their weighted sums into the named values.

    For statistics such as means, rates, losses and moments. Each row meets its cluster's weights in all replicates as one array,
    and each batch gives reps x numbers sums by one matrix product: rows are shuffled once, whatever `reps` is, and no
    replicate is gathered.
    """
    keys = list(keys)
    columns = columns or [c for c in df.columns if c not in keys]
    draws = B.cluster_draws(df, cluster, reps, seed).groupBy(F.col("cluster").alias("__own")).agg(F.collect_list(F.struct("rep", "weight")).alias("__w"))  # at most `reps`
    rows = df.select(*[F.col(k).cast("string").alias(f"__k{i}") for i, k in enumerate(keys)], *columns, F.col(cluster).cast("string").alias("__c"))
    rows = rows.join(draws, F.col("__c") == F.col("__own")).drop("__c", "__own")
    kind = ", ".join([*(f"__k{i} string" for i in range(len(keys))), "rep int", "__s array<double>"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            values = np.asarray(parts({c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns}), np.float64)
            values = values.reshape(batch.num_rows, -1)
            drawn = batch.column(batch.schema.get_field_index("__w"))
            ends = np.asarray(drawn.offsets)
            flat = drawn.values.slice(ends[0], ends[-1] - ends[0])
            weights = np.zeros((batch.num_rows, reps))
            weights[np.repeat(np.arange(batch.num_rows), np.diff(ends)), np.asarray(flat.field(0))] = np.asarray(flat.field(1))
            own = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))], strict=True)) if keys else [()] * batch.num_rows
            for key in set(own):
                at = np.array([k == key for k in own]) if keys else slice(None)
                found = weights[at].T @ values[at]
                total[key] = total[key] + found if key in total else found
        if total:
            tops = [(k, r) for k in total for r in range(reps)]
            data = [pa.array([k[i] for k, _ in tops], pa.string()) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*data, pa.array([r for _, r in tops], pa.int32()), pa.array([total[k][r] for k, r in tops], pa.list_(pa.float64()))], [*(f"__k{i}" for i in range(len(keys))), "rep", "__s"])

    each = rows.mapInArrow(sums, kind).select("*", F.posexplode("__s").alias("__p", "__x"))
    group = [f"__k{i}" for i in range(len(keys))] + ["rep"]
    each = each.groupBy(*group, "__p").agg(F.sum("__x").alias("__x")).groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__x"))), lambda s: s["__x"]).alias("__s"))
    out_kind = ", ".join([*(f"__k{i} string" for i in range(len(keys))), "rep int", *(f"`{n}` double" for n in names)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [final(np.array(s)) for s in batch.column(batch.num_columns - 1).to_pylist()]
            data = [pa.array([_number(f.get(n)) for f in found], pa.float64()) for n in names]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *data], [*group, *names])

    out = each.mapInArrow(finish, out_kind)
    return out.select(*[F.col(f"__k{i}").cast(df.schema[k].dataType).alias(k) for i, k in enumerate(keys)], "rep", *names)


def bootstrap_any(df: DataFrame, cluster: str, reps: int, statistic: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, float]], names: list[str], most: int, keys: list[str] = (), columns: list[str] | None = None, seed: str = "b") -> DataFrame:
    """(keys, rep, names) of any statistic(rows, weights): rows are the columns as arrays, weights how often each row was drawn.

    A replicate is gathered in one task, since nothing is known of the statistic, so this is for groups of at most
    `most` rows; a larger one fails the query (`bootstrap_sums` has no such bound). The weighted rows of all
    replicates are shuffled.
    """
    keys = list(keys)
    columns = columns or [c for c in df.columns if c not in keys]
    sizes = df.groupBy(*keys).count() if keys else df.agg(F.count("*").alias("count"))
    checked = sizes.select(*[F.col(k).alias(f"__s_{k}") for k in keys], F.when(F.col("count") > most, F.raise_error(F.lit("a group has more rows than the statistic may gather"))).otherwise(F.lit(1)).alias("__fits"))
    draws = B.cluster_draws(df, cluster, reps, seed).select("rep", F.col("cluster").alias("__own"), F.col("weight").alias("__weight"))
    rows = df.select(*[F.col(k) for k in keys], *[F.col(c) for c in columns if c not in keys], F.col(cluster).cast("string").alias("__c"))
    if keys:
        rows = rows.join(checked, [F.col(k).eqNullSafe(F.col(f"__s_{k}")) for k in keys]).where("__fits = 1").drop("__fits", *[f"__s_{k}" for k in keys])
    else:
        rows = rows.join(F.broadcast(checked)).where("__fits = 1").drop("__fits")
    rows = rows.join(draws, F.col("__c") == F.col("__own")).drop("__c", "__own")
    kind = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "rep int", *(f"`{n}` double" for n in names)])
    schema = pa.schema([*((k, _arrow(df, k)) for k in keys), ("rep", pa.int32()), *((n, pa.float64()) for n in names)])

    def one(key, table):
        found = statistic({c: table[c].to_numpy() for c in columns}, table["__weight"].to_numpy())
        return pa.table([*([k.as_py()] for k in key), *([_number(found.get(n))] for n in names)], schema=schema)

    return rows.groupBy(*keys, "rep").applyInArrow(one, kind)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _number(x) -> float | None:
    return None if x is None or not np.isfinite(x) else float(x)

"""Quality by a document classifier and hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aperture.llm import common as C

BITS, SAMPLE = 12, 4000
_KINDS = np.zeros(256, np.int64)  # of bytes: other, lower, upper, digit, punctuation, beyond ASCII, symbol, line end
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b] = 7 if _c == "\n" else 6 if _c in "#*$%&|<>" else 5 if _b > 127 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if 32 < _b < 127 else 0
EXTRA = 10


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value): the hashed words that a text has, by one over the root of their number, shares of kinds of bytes, the share of different words and the length."""
    data, off = C.bytes_of(batch.column(batch.schema.get_field_index("text")))
    h, first = C.word_hashes(data, off)
    n = len(off) - 1
    key = np.unique(np.repeat(np.arange(n), np.diff(first)) << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64))
    text, word = key >> BITS, key & ((1 << BITS) - 1)
    size = np.bincount(text, minlength=n)
    kinds = np.bincount(np.repeat(np.arange(n), np.diff(off)) * EXTRA + _KINDS[data], minlength=n * EXTRA).reshape(n, EXTRA) / np.maximum(np.diff(off), 1)[:, None]
    kinds[:, 8], kinds[:, 9] = size / np.maximum(np.diff(first), 1), np.minimum(np.log1p(np.diff(first)) / 8, 1)
    t, k = np.nonzero(kinds)
    return np.concatenate([text, t]), np.concatenate([word, (1 << BITS) + k]), np.concatenate([1 / np.sqrt(size[text]), 4 * kinds[t, k]])


def _examples(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.batches(rows, "text"):
        t, k, v = _features(batch)
        order = np.argsort(t, kind="stable")
        off = np.searchsorted(t[order], np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(x[order].astype(d))) for x, d in ((k, np.int32), (v, np.float32))]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("y")), *lists], ["y", "k", "v"])


def fit(examples: list, rounds: int = 400, penalty: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression (the last: the intercept) by Adam on all examples at once; zeros if a class is missing."""
    dim = (1 << BITS) + EXTRA
    w = np.zeros(dim + 1)
    y = np.array([r.y for r in examples], float)
    if not len(y) or y.min() == y.max():
        return w
    x = np.zeros((len(y), dim + 1), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(examples):
        x[i, r.k] = r.v
    m = v = np.zeros_like(w)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        grad = x.T @ (p - y).astype(np.float32) / len(y) + penalty * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def _evidence(w: np.ndarray):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.batches(rows, "text"):
            t, k, v = _features(batch)
            z = np.bincount(t, w[k] * v, batch.num_rows) + w[-1]
            cols = [batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "host", "path", "doc_score"])

    return run


def _strength(groups: DataFrame, n: str, s: str, prior: Column) -> float:
    """How many documents the prior weighs, by the method of moments: what groups differ in beyond chance, weighted by size."""
    spread = F.col(n) * F.pow(F.col(s) / F.col(n) - prior, 2)
    chance = F.sum(prior * (1 - prior))
    r = groups.agg(F.sum(spread).alias("a"), chance.alias("c"), F.sum(n).alias("n"), F.avg(prior * (1 - prior)).alias("v")).first()
    if not r.n or not r.v:
        return 1.0
    between = max((r.a - r.c) / r.n, 1e-6)
    return float(min(max(r.v / between - 1, 1.0), 1e6))


def classify(docs: DataFrame, labels: DataFrame, scratch: C.Scratch, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """(doc_id, host, path, doc_score, host_score, path_score, score, kept) for each row of `docs` (doc_id, host, path, text).

    doc_score is the probability of good quality by a logistic regression on hashed words and kinds of
    characters, fitted on at most `sample` of the documents that `labels` (doc_id, quality) covers, those
    whose ids have the smallest hashes. Hosts' mean scores are shrunk towards the global mean, paths' towards
    their host's, by a prior as heavy as the groups' differences beyond chance call for, so a sparse
    group stays near its parent. score adds a document's log odds to those of its path, the
    document itself left out, relative to the global ones; kept if it is `least` or more.

    A null or empty text has features of neither kind. Null hosts and paths are groups of their own; a
    null doc_id is scored but never an example. Of rows that share a labelled doc_id the text of the smallest
    MD5 is the example, of labels that share one the larger counts, so at most `sample` examples reach the driver. Without labels of both classes doc_score is one half.
    Repeated rows count each time; extra columns are ignored; an empty table gives an empty one.
    Groups are summed in map tasks first, and only their sums are joined back.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path"), "text")
    some = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("l")).agg(F.max(F.col("quality").cast("int")).alias("y")).orderBy(F.xxhash64("l"), "l").limit(sample)
    texts = docs.join(F.broadcast(some), F.col("doc_id") == F.col("l")).groupBy("l", "y").agg(F.min_by("text", F.struct(F.md5("text"))).alias("text"))
    got = sorted(texts.select("y", "text").mapInArrow(_examples, "y int, k array<int>, v array<float>").collect(), key=lambda r: (r.y, r.k, r.v))
    scored = scratch.table(docs.mapInArrow(_evidence(fit(got)), "doc_id long, host string, path string, doc_score double"), "scored")
    paths = scratch.table(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("doc_score").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    mean = min(max((total.s or 0.0) / max(total.n or 0, 1), 1e-6), 1 - 1e-6) if total.n else 0.5
    a = _strength(hosts, "hn", "hs", F.lit(mean))
    hosts = hosts.withColumn("host_score", (F.col("hs") + a * mean) / (F.col("hn") + a)).withColumnRenamed("host", "h2")
    both = scratch.table(paths.join(hosts, F.col("host").eqNullSafe(F.col("h2"))).drop("h2"), "groups")
    b = _strength(both, "n", "s", F.col("host_score"))
    both = both.select(F.col("host").alias("h2"), F.col("path").alias("p2"), "n", "s", "hn", "hs")
    df = scored.join(both, F.col("host").eqNullSafe(F.col("h2")) & F.col("path").eqNullSafe(F.col("p2")))
    df = df.withColumn("host_score", (F.col("hs") - F.col("doc_score") + a * mean) / (F.col("hn") - 1 + a))
    df = df.withColumn("path_score", (F.col("s") - F.col("doc_score") + b * F.col("host_score")) / (F.col("n") - 1 + b))
    odds = lambda p: F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    z = odds(F.col("doc_score")) + odds(F.col("path_score")) - odds(F.lit(mean))
    df = df.withColumn("score", 1 / (1 + F.exp(-z)))
    return df.select("doc_id", "host", "path", "doc_score", "host_score", "path_score", "score", (F.col("score") >= least).alias("kept"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), "text")
    return classify(docs, C.read(spark, sf_dir, "labels"), C.Scratch(spark, "classifier"))

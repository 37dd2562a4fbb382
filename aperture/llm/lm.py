"""Interpolated modified Kneser-Ney scoring from sorted hash arrays that workers memory-map."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aperture.llm import common as C

#: Stands for the end of a text as a token and for its beginning as a context.
EDGE = np.uint64(0x9D1C5AF3E77B2461)
#: Buckets of keys: 2 ** BITS at least, and so many that each has about this many tokens at most.
BITS, BUCKET_TOKENS = 10, 4_000_000
SLICE = 3_000_000
HOT = 1000


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return C.mix(v * np.uint64(0x9E3779B97F4A7C15) ^ (w + np.uint64(0x632BE59BD9B4E019)) ^ (v >> np.uint64(32)))


def bucket_bits(tokens: int) -> int:
    return max(BITS, (-(-tokens // BUCKET_TOKENS) - 1).bit_length())


def _bucket(x: np.ndarray, bits: int) -> np.ndarray:
    return (C.mix(x ^ np.uint64(0xA24BAED4963EE407)) >> np.uint64(64 - bits)).astype(np.int64)


def _isin(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def _route(v: np.ndarray, keys: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of a bigram: its context's, or, where the context is a very frequent word, its own."""
    out = _bucket(v, bits)
    if (often := _isin(v, hot)).any():
        out[often] = _bucket(keys[often], bits)
    return out


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text closed by EDGE, and each text's number of tokens."""
    h, first = C.word_hashes(*C.bytes_of(batch.column(batch.schema.get_field_index("text"))), lower=True)
    n = np.diff(first)
    tok = np.empty(len(h) + len(n), np.uint64)
    ends = np.cumsum(n + 1) - 1
    mask = np.ones(len(tok), bool)
    mask[ends] = False
    tok[mask], tok[ends] = h, EDGE
    return tok, n + 1


def _frequent(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.batches(rows, "text"):
        u, c = np.unique(_tokens(batch)[0], return_counts=True)
        often = c * 2 * HOT >= c.sum()
        yield pa.RecordBatch.from_arrays([pa.array(u[often].view(np.int64)), pa.array(c[often].astype(np.int64)), pa.array(np.where(np.arange(often.sum()) == 0, c.sum(), 0))], ["w", "c", "n"])


def _count(hot: np.ndarray, bits: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            v, w = (np.concatenate(x) for x in zip(*held))
            held.clear()
            keys = pair_keys(v, w)
            order = np.argsort(keys)
            first = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
            c = np.diff(np.append(first, len(order))).astype(np.uint32)
            v, w, keys = (x[order[first]] for x in (v, w, keys))
            b = _route(v, keys, hot, bits)
            order = np.lexsort((v, b))
            v, w, c, b = v[order], w[order], c[order], b[order]
            first = np.flatnonzero(np.append(True, np.diff(b) != 0))
            last = np.append(first[1:], len(b))
            return pa.RecordBatch.from_arrays([pa.array(b[first]), *(pa.array([x[i:j].tobytes() for i, j in zip(first, last)], pa.binary()) for x in (v, w, c))], ["bucket", "v", "w", "c"])

        n = 0
        for batch in C.batches(rows, "text"):
            tok, _ = _tokens(batch)
            held.append((np.append(EDGE, tok[:-1]), tok))
            if (n := n + len(tok)) >= SLICE:
                yield flush()
                n = 0
        if held:
            yield flush()

    return run


def _by_bucket(rows: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bucket, its arrays) from rows sorted by bucket."""
    now, parts = None, []

    def joined():
        return now, [np.frombuffer(b"".join(p[k] for p in parts), t) for k, t in enumerate(columns)]

    for batch in rows:
        names = [n for n in batch.schema.names if n != "bucket"]
        cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i, b in enumerate(batch.column(batch.schema.get_field_index("bucket")).to_pylist()):
            if b != now and parts:
                yield joined()
                parts = []
            now = b
            parts.append([c[i].as_py() for c in cols])
    if parts:
        yield joined()


_PART = "kind int, key long, a long, b long, c long, d long, bucket long, w binary, n binary"


def _store(folder: str, hot: np.ndarray, bits: int):
    """Sum each bucket's bigrams, write its arrays, and pass on what crosses buckets."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tally, small = [], np.zeros(6, np.int64), []
        types = dict(zip(["kind", "key", "a", "b", "c", "d", "bucket", "w", "n"], [pa.int32(), *[pa.int64()] * 6, pa.binary(), pa.binary()]))

        def out(**x) -> pa.RecordBatch:
            n = len(next(iter(x.values())))
            return pa.RecordBatch.from_arrays([pa.array(x[k], t) if k in x else pa.nulls(n, t) for k, t in types.items()], list(types))

        def words_out() -> pa.RecordBatch:
            u, n = np.unique(np.concatenate(words), return_counts=True)
            words.clear()
            b = _bucket(u, bits)
            order = np.argsort(b, kind="stable")
            u, n, b = u[order], n[order].astype(np.uint32), b[order]
            first = np.flatnonzero(np.append(True, np.diff(b) != 0))
            last = np.append(first[1:], len(b))
            return out(kind=[0] * len(first), bucket=b[first], w=[u[i:j].tobytes() for i, j in zip(first, last)], n=[n[i:j].tobytes() for i, j in zip(first, last)])

        for bucket, (v, w, c) in _by_bucket(rows, ("<u8", "<u8", "<u4")):
            keys = pair_keys(v, w)
            order = np.argsort(keys)
            first = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
            c = np.add.reduceat(c[order].astype(np.int64), first)
            keys, v, w = (x[order[first]] for x in (keys, v, w))
            C.write_shared(f"{folder}/pair-{bucket}", [keys.tobytes()])
            C.write_shared(f"{folder}/count-{bucket}", [c.astype(np.uint32 if c.max() < 2**32 else np.int64).tobytes()])
            tally += [*(int((c == k).sum()) for k in (1, 2, 3, 4)), int(c.sum()), len(c)]
            ctx, inverse = np.unique(v, return_inverse=True)
            stats = np.stack([np.bincount(inverse, c, len(ctx)), *(np.bincount(inverse, x, len(ctx)) for x in (c == 1, c == 2, c >= 3))], 1).astype(np.int64)
            often = _isin(ctx, hot)
            C.write_shared(f"{folder}/ctx-{bucket}", [ctx[~often].tobytes()])
            C.write_shared(f"{folder}/stats-{bucket}", [stats[~often].tobytes()])
            if often.any():
                small.append((ctx[often], stats[often]))
            words.append(w)
            if sum(map(len, words)) >= SLICE:
                yield words_out()
        if words:
            yield words_out()
        if small:
            ctx, inverse = np.unique(np.concatenate([x for x, _ in small]), return_inverse=True)
            stats = np.zeros((len(ctx), 4), np.int64)
            np.add.at(stats, inverse, np.concatenate([x for _, x in small]))
            yield out(kind=[1] * len(ctx), key=ctx.view(np.int64), **dict(zip("abcd", stats.T)))
        yield out(kind=[2] * 6, key=np.arange(6), a=tally)

    return run


def _store_words(folder: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(6, np.int64)
        for bucket, (w, n) in _by_bucket(rows, ("<u8", "<u4")):
            u, inverse = np.unique(w, return_inverse=True)
            n = np.bincount(inverse, n, len(u)).astype(np.int64)
            C.write_shared(f"{folder}/word-{bucket}", [u.tobytes()])
            C.write_shared(f"{folder}/before-{bucket}", [n.tobytes()])
            tally += [*(int((n == k).sum()) for k in (1, 2, 3, 4)), int((n >= 3).sum()), len(u)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(6)), pa.array(tally)], ["key", "a"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts; where counts of counts leave one undefined, 0.5, 1 and 1.5 stand in."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    found = [k - (k + 1) * y * b / a if a and b else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.0), k) for k, x in zip((1, 2, 3), found))


def train(docs: DataFrame, scratch: C.Scratch, parts: int | None = None) -> dict:
    """Count the bigrams of all `docs` (text) and store them; returns the model's constants and folder.

    Orders: bigrams with raw counts, unigrams with continuation counts, then the uniform
    distribution over the vocabulary and one unknown word. Counts are summed by key in map tasks
    first. A bigram goes to its context's bucket, or, where its context is a frequent word (over
    one token in HOT; at most 2 * HOT words, so the driver may hold them), to a bucket of its own,
    so that no bucket gathers a frequent word's continuations.
    """
    docs = docs.select("text")
    spark = docs.sparkSession
    parts = parts or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    often = docs.mapInArrow(_frequent, "w long, c long, n long")
    n_all = often.agg(F.sum("n")).first()[0] or 0
    found = often.groupBy("w").agg(F.sum("c").alias("c")).where(F.col("c") * 2 * HOT >= F.lit(n_all)).orderBy(F.desc("c"), "w").limit(2 * HOT).collect() if n_all else []
    hot, bits = np.sort(np.array([r.w for r in found], np.int64).view(np.uint64)), bucket_bits(n_all)
    folder = scratch.folder("model")
    pairs = docs.mapInArrow(_count(hot, bits), "bucket long, v binary, w binary, c binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    crossing = scratch.table(pairs.mapInArrow(_store(folder, hot, bits), _PART), "crossing")
    tally = {r.key: r.a for r in crossing.where("kind = 2").groupBy("key").agg(F.sum("a").alias("a")).collect()}
    hot_rows = crossing.where("kind = 1").groupBy("key").agg(*[F.sum(x).alias(x) for x in "abcd"]).orderBy("key").collect()
    words = crossing.where("kind = 0").select("bucket", "w", "n").repartition(parts, "bucket").sortWithinPartitions("bucket")
    after = {r.key: r.a for r in words.mapInArrow(_store_words(folder), "key long, a long").groupBy("key").agg(F.sum("a").alias("a")).collect()}
    order = np.argsort(np.array([r.key for r in hot_rows], np.int64).view(np.uint64))
    d, e = discounts(*(tally.get(k, 0) for k in range(4))), discounts(*(after.get(k, 0) for k in range(4)))
    types = tally.get(5, 0)
    left = e[0] * after.get(0, 0) + e[1] * after.get(1, 0) + e[2] * after.get(4, 0)
    return {
        "folder": folder, "bits": bits, "d": d, "e": e, "tokens": tally.get(4, 0), "types": types, "vocabulary": after.get(5, 0), "left": left / types if types else 1.0, "hot": hot,
        "hot_ctx": np.array([hot_rows[i].key for i in order], np.int64).view(np.uint64), "hot_stats": np.array([[hot_rows[i][x] for x in "abcd"] for i in order], np.int64).reshape(-1, 4),
    }


def _load(uri: str, dtype: str) -> np.ndarray:
    try:
        return C.map_shared(uri, dtype)
    except FileNotFoundError:  # no key of this bucket was seen in training
        return np.empty(0, dtype)


#: Mapped arrays cost no memory of their own; of those read from a store that is not mounted a worker keeps a few.
_mapped, _fetched = lru_cache(maxsize=8192)(_load), lru_cache(maxsize=32)(_load)


def _find(x: np.ndarray, buckets: np.ndarray, folder: str, keys: str, values: str, dtype: str, width: int = 1) -> np.ndarray:
    """Rows of `values` for the keys x, zero where absent; each bucket's mapped array is searched once, in order."""
    out, get = np.zeros((len(x), width), np.int64), _mapped if C.is_mounted(folder) else _fetched
    order = np.lexsort((x, buckets))
    b = buckets[order]
    first = np.flatnonzero(np.append(True, np.diff(b) != 0)) if len(b) else []
    for i, j in zip(first, np.append(first[1:], len(b)) if len(b) else []):
        have = get(f"{folder}/{keys}-{b[i]}", "<u8")
        if not len(have):
            continue
        q = x[order[i:j]]
        at = np.minimum(np.searchsorted(have, q), len(have) - 1)
        hit = have[at] == q
        rows = get(f"{folder}/{values}-{b[i]}", dtype)
        if len(rows) == 2 * width * len(have):  # counts over 32 bits
            rows = rows.view("<i8")
        out[order[i:j][hit]] = rows.reshape(-1, width)[at[hit]]
    return out


def _scorer(model: dict):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, hot, n, v_all = model["folder"], model["hot"], model["tokens"], model["vocabulary"]
        d, e = np.array([0.0, *model["d"]]), np.array([0.0, *model["e"]])
        for batch in C.batches(rows, "text"):
            tok, sizes = _tokens(batch)
            u, inv = np.unique(tok, return_inverse=True)
            b = _bucket(u, model["bits"])
            stats = _find(u, b, folder, "ctx", "stats", "<i8", 4)
            if len(model["hot_ctx"]) and (often := _isin(u, model["hot_ctx"])).any():
                stats[often] = model["hot_stats"][np.searchsorted(model["hot_ctx"], u[often])]
            before = _find(u, b, folder, "word", "before", "<i8")[:, 0]
            count = stats[:, 0]  # a word is a context as often as a token, and so is EDGE
            low = np.maximum(before - e[np.minimum(before, 3)], 0) / max(model["types"], 1) + model["left"] / (v_all + 1)
            back = np.where(count > 0, (stats[:, 1:] @ d[1:]) / np.maximum(count, 1), 1.0)
            edge = np.searchsorted(u, EDGE)
            ctx = np.append(edge, inv[:-1])
            keys, kin = np.unique(pair_keys(u[ctx], tok), return_inverse=True)
            one = np.empty(len(keys), np.int64)
            one[kin] = np.arange(len(tok))
            c = _find(keys, _route(u[ctx[one]], keys, hot, model["bits"]), folder, "pair", "count", "<u4")[:, 0][kin]
            p = np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(count[ctx], 1) + back[ctx] * low[inv]
            base = np.log10((count + 1) / (n + 1 * (v_all + 1)))[inv]
            first = np.append(0, np.cumsum(sizes)[:-1])
            keep = [batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sizes.astype(np.int64)), pa.array(np.add.reduceat((count > 0).astype(np.int64)[inv], first)), pa.array(np.full(len(sizes), n, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(p), first))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, training: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Score `docs` (doc_id, held_out, text) by the model of `training` (text).

    A null or empty text is its end alone: one token. A model of no texts gives every word the
    uniform probability of one unknown word, 1. Repeated rows are scored, and counted, each time.
    Extra columns are ignored; an empty table gives an empty one.
    """
    model = train(training, scratch)
    return docs.select("doc_id", "held_out", "text").mapInArrow(_scorer(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2)
    return score(docs, docs.where("not held_out"), C.Scratch(spark, "lm"))

"""Ranks of positives among all candidates, and the best of them, in blocks of matrix products."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aperture.functions import vectors as V
from aperture.operators import metrics as M
from aperture.sources.shared import Scratch, open_shared, write_shared

EPS = 1e-12
#: Rows of a file of candidates, and queries that meet it at once: a matrix of similarities has BLOCK x STEP numbers (8 MB).
BLOCK, STEP = 4096, 256
#: Bytes of queries that a task holds while it goes through the candidates' files.
HELD = 32 << 20


def dedup_candidates(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(cand_id, vec, grp): rows of one non-blank key are pooled (mean, then unit), others stay; grp is the first member's."""
    k = F.coalesce(F.nullif(F.trim(F.col(key).cast("string")), F.lit("")), F.concat(F.lit("row::"), F.col("pair_index").cast("string")))
    t = df.select("pair_index", "group_id", k.alias("k"), F.col(vector).alias("v"))
    first = t.groupBy("k").agg(F.min("pair_index").alias("cand_id"), F.min_by("group_id", "pair_index").alias("grp"))
    return first.join(V.mean_by(t, ["k"], "v", "m"), "k").select("k", "cand_id", V.unit(F.col("m")).alias("vec"), "grp")


# ------------------------------------------------------------------ blocks of candidates


def _array(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = np.asarray(_array(batch, "vec").flatten(), np.float64)
    return x.reshape(batch.num_rows, -1)


def _store(folder: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            path, f = f"{folder}/block-{uuid.uuid4().hex}.npz", io.BytesIO()
            np.savez(f, **{k: np.concatenate([h[k] for h in held]) for k in held[0]})
            write_shared(path, [f.getvalue()])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

        for batch in rows:
            if batch.num_rows:
                ids, grp, vec, p = np.asarray(_array(batch, "cand_id")), np.asarray(_array(batch, "grp")), _matrix(batch), 0
                while p < len(ids):
                    q = min(len(ids), p + BLOCK - n)
                    held.append({"id": ids[p:q], "grp": grp[p:q], "vec": vec[p:q]})
                    n, p = n + q - p, q
                    if n == BLOCK:
                        yield out()
                        n = 0
        if held:
            yield out()

    return run


def store_candidates(candidates: DataFrame, scratch: Scratch) -> list[str]:
    """Write `candidates` (cand_id, vec[, grp]) as files of BLOCK rows at most in the shared folder; their paths, one a file."""
    grp = F.xxhash64(F.col("grp").cast("string")) if "grp" in candidates.columns else F.lit(0).cast("long")
    rows = candidates.select(F.col("cand_id").cast("long").alias("cand_id"), grp.alias("grp"), "vec")
    return sorted(r.path for r in rows.mapInArrow(_store(scratch.folder("candidates")), "path string").collect())


def _blocks(paths: list[str]) -> Iterator[dict]:
    for path in paths:
        with open_shared(path) as f, np.load(io.BytesIO(f.read())) as z:
            yield {k: z[k] for k in z.files}


def _gathered(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's queries in as few batches as HELD bytes of vectors allow, for each batch goes through all candidates."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()  # before it is used: what is held is not held twice
        return one

    for batch in rows:
        if batch.num_rows:
            held.append(batch)
            size += 8 * len(_array(batch, "vec").flatten())
        if size >= HELD:
            yield out()
            size = 0
    if held:
        yield out()


def _ranks(paths: list[str], grouped: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(rows):
            q, pos, grp = _matrix(batch), np.asarray(_array(batch, "pos")), np.asarray(_array(batch, "grp"))
            at, best = np.full(len(q), np.nan), np.full(len(q), -np.inf)
            more, above = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
            parts = [slice(p, p + STEP) for p in range(0, len(q), STEP)]
            for c in _blocks(paths):  # the positive's similarity, and the best of the group's
                order = np.argsort(c["id"], kind="stable")
                k = order[np.minimum(np.searchsorted(c["id"][order], pos), len(order) - 1)]
                hit = c["id"][k] == pos
                at[hit] = np.einsum("nd,nd->n", q[hit], c["vec"][k[hit]])
                for p in parts if grouped else ():
                    best[p] = np.maximum(best[p], np.where(grp[p, None] == c["grp"], q[p] @ c["vec"].T, -np.inf).max(1))
            for c in _blocks(paths):
                for p in parts:
                    s = q[p] @ c["vec"].T
                    more[p] += ((s > at[p, None] + EPS) & (c["id"] != pos[p, None])).sum(1)
                    if grouped:
                        above[p] += (s > best[p, None] + EPS).sum(1)
            none = np.isnan(at)
            yield pa.RecordBatch.from_arrays(
                [_array(batch, "query_id"), pa.array(more + 1, mask=none), pa.array(at, mask=none), pa.array(above + 1, mask=np.isinf(best))], ["query_id", "rank", "pos_sim", "group_rank"]
            )

    return run


def _queries(queries: DataFrame) -> DataFrame:
    """Queries as the tasks take them."""
    grp = F.xxhash64(F.col("grp").cast("string")) if "grp" in queries.columns else F.lit(0).cast("long")
    pos = F.col("pos").cast("long") if "pos" in queries.columns else F.lit(None).cast("long")
    return queries.select(F.col("query_id").cast("long").alias("query_id"), F.coalesce(pos, F.lit(-(2**63))).alias("pos"), grp.alias("grp"), "vec")


def ranks(queries: DataFrame, candidates: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, pos_sim[, group_rank]): 1 + the candidates more similar than the positive, so ties are in the query's favour.

    queries: query_id, vec, pos[, grp]; candidates: cand_id, vec[, grp]. With grp, group_rank is 1 + the candidates
    more similar than the most similar one of the query's own group (null if the group has none). A query
    whose positive is no candidate has no rank.

    Candidates are written once as files in the shared folder; each task of queries goes through them
    and keeps counts alone, so nothing is shuffled and no pair leaves a matrix product.
    """
    scratch = scratch or Scratch(queries.sparkSession, "ranks")
    grouped = "grp" in queries.columns and "grp" in candidates.columns
    paths = store_candidates(candidates, scratch)
    out = _queries(queries).mapInArrow(_ranks(paths, grouped), "query_id long, rank long, pos_sim double, group_rank long")
    return out if grouped else out.drop("group_rank")


def _first(sim: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of each row's n largest similarities (to nine digits), the smaller id first among equals: only those that reach the n-th are sorted."""
    r = np.round(sim, 9)
    least = np.partition(r, r.shape[1] - n, 1)[:, r.shape[1] - n]
    m = int((r >= least[:, None]).sum(1).max())
    near = np.argpartition(-r, m - 1, 1)[:, :m]
    order = np.lexsort((np.take_along_axis(ids, near, 1), -np.take_along_axis(r, near, 1)), axis=1)[:, :n]
    return np.take_along_axis(near, order, 1)


def _best(paths: list[str], k: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(rows):
            q = _matrix(batch)
            sim, ids, found = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64), 0
            for c in _blocks(paths):
                found = min(k, found + len(c["id"]))
                new_sim, new_ids = np.empty((len(q), found)), np.empty((len(q), found), np.int64)
                for p in range(0, len(q), STEP):
                    p = slice(p, p + STEP)
                    s = np.concatenate([sim[p], q[p] @ c["vec"].T], 1)
                    i = np.concatenate([ids[p], np.broadcast_to(c["id"], (len(s), len(c["id"])))], 1)
                    order = _first(s, i, found)
                    new_sim[p], new_ids[p] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
                sim, ids = new_sim, new_ids
            n = found
            yield pa.RecordBatch.from_arrays(
                [_array(batch, "query_id").take(pa.array(np.repeat(np.arange(len(q)), n))), pa.array(ids.ravel()), pa.array(sim.ravel()), pa.array(np.tile(np.arange(1, n + 1), len(q)).astype(np.int32))], ["query_id", "cand_id", "sim", "place"]
            )

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, cand_id, sim, place) of the k most similar candidates, the smaller id first among equals (to nine digits)."""
    scratch = scratch or Scratch(queries.sparkSession, "top")
    return _queries(queries).mapInArrow(_best(store_candidates(candidates, scratch), k), "query_id long, cand_id long, sim double, place int")


def top_k_report(queries: DataFrame, candidates: DataFrame, k: int, files: DataFrame, rank: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """top_k with what a reader wants beside: the true rank, and whether the candidate is the query's own pair or of its file.

    files: (pair_index, file_id) of both sides; rank: (query_id, rank), as of ranks().
    """
    t = top_k(queries, candidates, k, scratch).join(rank.select("query_id", F.col("rank").alias("true_rank")), "query_id", "left")
    q, c = (files.select(F.col("pair_index").alias(n), F.col("file_id").alias(f"{n}_file")) for n in ("query_id", "cand_id"))
    t = t.join(q, "query_id", "left").join(c, "cand_id", "left")
    exact, same = F.col("query_id") == F.col("cand_id"), F.col("query_id_file").eqNullSafe(F.col("cand_id_file"))
    return t.select("query_id", "true_rank", "place", "cand_id", F.col("sim").alias("score"), exact.cast("int").alias("is_exact_pair"), same.cast("int").alias("is_same_file"))


def sampled_queries(df: DataFrame, n: int, key: str = "pair_index", seed: str = "42") -> DataFrame:
    """n rows without replacement: those whose ids have the smallest digests, whatever the partitions."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


# ------------------------------------------------------------------ both directions


def both_directions(pairs: DataFrame, scratch: Scratch | None = None) -> dict[str, DataFrame]:
    """Retrieval from images to texts and back on `pairs` (pair_index, image_emb, text_emb, group_id, image_id, caption_id).

    Candidates are pooled by image_id and by caption_id; every image is ranked against the unique texts, every
    text against the unique images. `pairs`: per pair both ranks, both same-group ranks and the mean of
    both cosines; `pools`: sizes of the pools and whether pooling left out any.
    """
    scratch = scratch or Scratch(pairs.sparkSession, "both")
    pairs = scratch.table(pairs.select("pair_index", "image_emb", "text_emb", "group_id", "image_id", "caption_id"), "inputs")
    texts = scratch.table(dedup_candidates(pairs, "caption_id", "text_emb"), "texts")
    images = scratch.table(dedup_candidates(pairs, "image_id", "image_emb"), "images")
    out = None
    for name, own, key, pool in (("i2t", "image_emb", "caption_id", texts), ("t2i", "text_emb", "image_id", images)):
        k = F.coalesce(F.nullif(F.trim(F.col(key).cast("string")), F.lit("")), F.concat(F.lit("row::"), F.col("pair_index").cast("string")))
        q = pairs.select(F.col("pair_index").alias("query_id"), F.col(own).alias("vec"), F.col("group_id").alias("grp"), k.alias("k")).join(pool.select("k", F.col("cand_id").alias("pos")), "k")
        one = ranks(q, pool, Scratch(pairs.sparkSession, name)).select(F.col("query_id").alias("pair_index"), F.col("rank").alias(f"{name}_rank"), F.col("group_rank").alias(f"{name}_group_rank"), F.col("pos_sim").alias(f"{name}_sim"))
        out = one if out is None else out.join(one, "pair_index")
    done = scratch.table(out.withColumn("cosine", (F.col("i2t_sim") + F.col("t2i_sim")) / 2).drop("i2t_sim", "t2i_sim"), "pairs")
    count = lambda df, n: df.agg(F.count("*").alias(n))
    pools = count(images, "n_images").join(count(texts, "n_texts")).join(count(done, "n_pairs"))
    pools = pools.withColumn("deduplicated", (F.col("n_images") != F.col("n_pairs")) | (F.col("n_texts") != F.col("n_pairs")))
    return {"pairs": done, "pools": pools, "images": images, "texts": texts}


def retrieval_summary(found: dict[str, DataFrame], nonmatches: DataFrame, groups: bool = True) -> DataFrame:
    """One row: rank figures of both directions (and within groups), those of the matched cosines, matched minus `nonmatches` (sim) in mean."""
    done, out = found["pairs"], found["pools"]
    for name in ("i2t", "t2i", *(("i2t_group", "t2i_group") if groups else ())):
        s = M.rank_summary(done.where(F.col(f"{name}_rank").isNotNull()), f"{name}_rank")
        out = out.join(s.select(*[F.col(c).alias(f"{name}_{c}") for c in s.columns]))
    c = done.agg(F.avg("cosine").alias("cosine_mean"), F.stddev_pop("cosine").alias("cosine_std"))
    n = nonmatches.agg(F.avg("sim").alias("nonmatch_mean"))
    return out.join(c).join(n).withColumn("matched_minus_nonmatch", F.col("cosine_mean") - F.col("nonmatch_mean"))


def pool_pairs(pairs: DataFrame, key: str) -> DataFrame:
    """`pairs` pooled to one row a slide: unit vectors averaged and made unit, ids in order of first appearance, n_patches."""
    if_blank = F.raise_error(F.lit("a slide has no key"))
    k = F.when(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == "", if_blank).otherwise(F.col(key).cast("string"))
    t = pairs.select(k.alias("k"), "pair_index", V.unit(F.col("image_emb")).alias("i"), V.unit(F.col("text_emb")).alias("t"))
    first = t.groupBy("k").agg(F.min("pair_index").alias("pair_index"), F.count("*").alias("n_patches"))
    both = first.join(V.mean_by(t, ["k"], "i", "mi"), "k").join(V.mean_by(t, ["k"], "t", "mt"), "k")
    none = F.lit(None).cast("string")
    return both.select("pair_index", F.col("k").alias("slide"), "n_patches", V.unit(F.col("mi")).alias("image_emb"), V.unit(F.col("mt")).alias("text_emb"), none.alias("group_id"), none.alias("image_id"), none.alias("caption_id"))


def nonmatches(pairs: DataFrame, n: int, i: Column, j: Column) -> DataFrame:
    """(s, i, j, sim) of the samples s = 0 .. n - 1: image i with another pair's text; `i` and `j` are numbers made of the column s, taken modulo the number of pairs and that less one.

    pair_index must be 0, 1, ... without gaps.
    """
    size = pairs.count()
    s = pairs.sparkSession.range(n).withColumnRenamed("id", "s").select("s", F.pmod(i, F.lit(size)).alias("i"), F.pmod(j, F.lit(size - 1)).alias("j"))
    s = s.withColumn("j", F.col("j") + (F.col("j") >= F.col("i")).cast("int"))
    t = s.join(pairs.select(F.col("pair_index").alias("i"), "image_emb"), "i").join(pairs.select(F.col("pair_index").alias("j"), "text_emb"), "j")
    return t.select("s", "i", "j", V.dot(F.col("image_emb"), F.col("text_emb")).alias("sim"))


def modality_gap(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distance, cosine and norms of the two centroids."""
    one = df.select(F.lit(0).alias("g"), F.col(a).alias("v"))
    two = df.select(F.lit(0).alias("g"), F.col(b).alias("v"))
    both = V.mean_by(one, ["g"], "v", "x").join(V.mean_by(two, ["g"], "v", "y"), "g")
    gap = F.zip_with("x", "y", lambda p, q: p - q)
    return both.select(V.norm(gap).alias("centroid_l2"), (V.dot(F.col("x"), F.col("y")) / F.greatest(V.norm(F.col("x")) * V.norm(F.col("y")), F.lit(EPS))).alias("centroid_cosine"), V.norm(F.col("x")).alias("norm_a"), V.norm(F.col("y")).alias("norm_b"))


def info_nce(df: DataFrame, scale: float, *keys: str) -> DataFrame:
    """(keys, loss, top1) of the pairs (i, j, sim) of each batch, one batch without keys: the mean of both directions' cross entropies."""
    def one(key: str) -> DataFrame:
        w = Window.partitionBy(*keys, key)
        z = F.col("sim") * scale
        t = df.withColumn("lse", F.max(z).over(w) + F.log(F.sum(F.exp(z)).over(w)) - F.max(z).over(w)).withColumn("top", F.max("sim").over(w))
        return t.where("i = j").groupBy(*keys).agg(F.avg(F.col("lse") - z).alias("l"), F.avg((F.col("sim") >= F.col("top")).cast("double")).alias("t"))

    a, b = one("i").toDF(*keys, "la", "ta"), one("j").toDF(*keys, "lb", "tb")
    both = a.join(b, list(keys)) if keys else a.join(F.broadcast(b))
    return both.select(*keys, ((F.col("la") + F.col("lb")) / 2).alias("loss"), ((F.col("ta") + F.col("tb")) / 2).alias("top1"))

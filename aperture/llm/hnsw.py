"""Near-duplicate vectors by one hierarchical navigable small-world graph per shard."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aperture.llm import common as C

M, EF, LEVEL_ODDS = 16, 64, 16
#: The beam that audits begin with.
START = 64
#: A shard has at most so many rows, and so many bytes of vectors (a worker holds three).
SHARDS, SHARD_ROWS, SHARD_BYTES, BLOCK = 8, 100_000, 128 << 20, 1024
#: Audited vectors of each shard, and of all, that its graph is searched for; while these have fewer than ENOUGH links, up to ROUNDS times as many of its own.
AUDIT, ENOUGH, ROUNDS, RECALL = 256, 100, 16, 0.99


def _spread(sim: np.ndarray, ids: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
    """Up to `keep` of each row's candidates (nearest first, -1 none): one nearer to a chosen one than to the row's node waits till the end."""
    rows, n = ids.shape
    among = np.einsum("rid,rjd->rij", x[ids], x[ids])
    taken, blocked = np.zeros((rows, n), bool), ids < 0
    for j in range(n):
        ok = ~blocked[:, j] & (taken.sum(1) < keep)
        ok &= ~(taken & (among[:, j, :] > sim[:, j][:, None])).any(1)
        taken[:, j] = ok
    rank = np.where(taken, 0, np.where(ids >= 0, 1, 2)) * n + np.arange(n)
    order = np.argsort(rank, 1)[:, :keep]
    return np.where(np.take_along_axis(ids, order, 1) >= 0, np.take_along_axis(ids, order, 1), -1)


class Graph:
    """A graph over unit vectors, searched for many queries at once in lock-step."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray] | None = None, top: int = 0):
        self.x, self.layers, self.top = x, layers or [], top

    @classmethod
    def build(cls, x: np.ndarray, m: int = M, ef: int = EF, seed: int = 7) -> Graph:
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LEVEL_ODDS)).astype(int), 8)
        order = np.argsort(-level, kind="stable")  # upper layers first, so that each layer can be entered from above
        g = cls(x, [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(level.max() + 1 if n else 1)], int(order[0]) if n else 0)
        done = 1
        while done < n:
            batch = order[done : done + min(done, 512)]
            entry = np.full((len(batch), 1), g.top)
            for k in range(len(g.layers) - 1, -1, -1):
                here = np.flatnonzero(level[batch] >= k)
                sim, ids = g._beam(x[batch], entry, k, 1 if not len(here) else ef)
                entry = ids[:, : min(4, ids.shape[1])]
                if len(here):
                    g._link(k, batch[here], sim[here], ids[here])
            done += len(batch)
        return g

    def _link(self, k: int, nodes: np.ndarray, sim: np.ndarray, ids: np.ndarray) -> None:
        """Join new nodes with what their search found and with each other, then prune whoever has too many."""
        near = self.x[nodes] @ self.x[nodes].T
        np.fill_diagonal(near, -2)
        part = np.argsort(-near, 1)[:, :M]
        sim = np.concatenate([sim, np.take_along_axis(near, part, 1)], 1)
        ids = np.concatenate([ids, np.where(np.take_along_axis(near, part, 1) > -2, nodes[part], -1)], 1)
        sim = np.where(ids >= 0, sim, -2)
        best = np.argsort(-sim, 1, kind="stable")[:, : 3 * M]
        chosen = _spread(np.take_along_axis(sim, best, 1), np.take_along_axis(ids, best, 1), self.x, M)
        layer = self.layers[k]
        a, b = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        pairs = np.unique(np.stack([np.concatenate([a, b]), np.concatenate([b, a])], 1), axis=0)
        who, first, n = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        width = layer.shape[1]
        all_ = np.full((len(who), width + n.max()), -1, np.int64)
        all_[:, :width] = layer[who]
        at = np.arange(len(pairs)) - np.repeat(first, n)
        all_[np.repeat(np.arange(len(who)), n), width + at] = pairs[:, 1]
        for p in range(0, len(who), 256):
            own, cand = who[p : p + 256], all_[p : p + 256]
            cand = np.sort(cand, 1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            few = (cand >= 0).sum(1) <= width
            cand = np.sort(cand, 1)[:, ::-1]
            layer[own[few]] = cand[few, :width]
            if not few.all():
                c = cand[~few]
                c = c[:, : max(1, int((c >= 0).sum(1).max()))]
                s = np.where(c >= 0, np.einsum("rcd,rd->rc", self.x[c], self.x[own[~few]]), -2)
                o = np.argsort(-s, 1, kind="stable")
                layer[own[~few]] = _spread(np.take_along_axis(s, o, 1), np.take_along_axis(c, o, 1), self.x, width)

    def _beam(self, q: np.ndarray, entry: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The `ef` nearest found of each query on layer k, nearest first (-1: fewer)."""
        n, layer, rows = len(self.x), self.layers[k], np.arange(len(q))
        seen = np.zeros((len(q), n + 1), bool)
        ids = np.full((len(q), max(ef, entry.shape[1])), -1, np.int64)
        ids[:, : entry.shape[1]] = entry
        s = np.sort(ids, 1)
        if entry.shape[1] > 1:
            s[:, 1:][s[:, 1:] == s[:, :-1]] = -1
            ids = np.sort(s, 1)[:, ::-1].copy()
        ids = ids[:, :ef] if ids.shape[1] > ef else ids
        sim = np.where(ids >= 0, np.einsum("qed,qd->qe", self.x[ids], q) if ids.shape[1] <= 8 else self._sims(ids, q), -2).astype(np.float32)
        seen[rows[:, None], ids] = True
        open_ = ids >= 0
        live = rows
        while len(live):
            pick = np.argmax(np.where(open_[live], sim[live], -3), 1)
            ok = open_[live, pick]
            live, pick = live[ok], pick[ok]
            if not len(live):
                break
            open_[live, pick] = False
            new = layer[ids[live, pick]].astype(np.int64)
            old = seen[live[:, None], new] | (new < 0)
            seen[live[:, None], new] = True
            s = np.where(old, np.float32(-2), np.einsum("qmd,qd->qm", self.x[new], q[live])).astype(np.float32)
            worst = sim[live].min(1)
            use = (s > worst[:, None]).any(1)
            if use.any():
                r = live[use]
                cs = np.concatenate([sim[r], s[use]], 1)
                ci = np.concatenate([ids[r], np.where(old[use], -1, new[use])], 1)
                co = np.concatenate([open_[r], ~old[use]], 1)
                top = np.argpartition(-cs, ids.shape[1] - 1, 1)[:, : ids.shape[1]]
                sim[r], ids[r], open_[r] = (np.take_along_axis(v, top, 1) for v in (cs, ci, co))
                open_[r] &= ids[r] >= 0
        order = np.argsort(-sim, 1, kind="stable")
        return np.take_along_axis(sim, order, 1), np.take_along_axis(ids, order, 1)

    def _sims(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.full(ids.shape, -2, np.float32)
        r, c = np.nonzero(ids >= 0)
        out[r, c] = np.einsum("nd,nd->n", self.x[ids[r, c]], q[r])
        return out

    def within(self, q: np.ndarray, least: float, ef: int = START) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of the pairs found with similarity `least` or more; a query whose beam is full of them searches again with a wider one."""
        n = len(self.x)
        entry = np.full((len(q), 1), self.top)
        for k in range(len(self.layers) - 1, 0, -1):
            entry = self._beam(q, entry, k, 4)[1]
        todo, out = np.arange(len(q)), []
        while len(todo):
            ef = min(ef, n)
            wide = []
            step = max(1, min(512, (64 << 20) // max(n, ef * 64)))
            for p in range(0, len(todo), step):
                t = todo[p : p + step]
                sim, ids = self._beam(q[t], entry[t], 0, ef)
                full = (sim[:, -1] >= least) & (ef < n)
                wide.append(t[full])
                hit = (sim >= least) & ~full[:, None]
                out.append((np.repeat(t, hit.sum(1)), ids[hit]))
            todo, ef = np.concatenate(wide), ef * 4
        return (np.concatenate([x[k] for x in out]) if out else np.empty(0, np.int64) for k in (0, 1))


def _pack(**arrays) -> bytes:
    f = io.BytesIO()
    np.savez(f, **arrays)
    return f.getvalue()


def _file(folder: str, dim: int, shard: int) -> str:
    return f"{folder}/graph-{dim}-{shard}.npz"


def _unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; the largest component first becomes one, so that no square leaves the range."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _build(folder: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, shard = key[0].as_py(), key[1].as_py()
        table = table.sort_by("rep")
        v = np.asarray(table.column("embedding").combine_chunks().flatten()).reshape(-1, dim)
        g = Graph.build(_unit(v).astype(np.float32))
        ids, copies = (np.asarray(table.column(c)) for c in ("rep", "copies"))
        C.write_shared(_file(folder, dim, shard), [_pack(v=v, ids=ids, copies=copies, top=np.array(g.top), **{f"layer{k}": a for k, a in enumerate(g.layers)})])
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "n": pa.array([len(v)], pa.int64())})

    return run


def _load(folder: str, dim: int, shard: int) -> dict:
    with C.open_shared(_file(folder, dim, shard)) as f, np.load(io.BytesIO(f.read())) as z:
        return {k: z[k] for k in z.files}


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many pairs as connect what (a, b) connects: each node and the smallest that it reaches."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    some = label != np.arange(len(nodes))
    return nodes[some], nodes[label[some]]


def _searchable(part: dict) -> dict:
    if "graph" not in part:
        part["unit"] = _unit(part["v"]).astype(np.float32)
        part["graph"] = Graph(part["unit"], [part[f"layer{k}"] for k in range(sum(x.startswith("layer") for x in part))], int(part["top"]))
    return part


_AUDITED = "dim int, target int, ef int, recall double, links long"


def _audit(folder: str, least: float, sample: dict[int, tuple[np.ndarray, np.ndarray]], audit: int):
    """The beam at which each shard's graph finds the links that full scans for the audited vectors find, the recall measured there, and how many links that is of.

    A vector's match with itself is no link and counts on neither side. Without any link there is nothing to be lost, and recall is null.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for r in batch.to_pylist():
                part, bound = _searchable(_load(folder, r["dim"], r["shard"])), least - 1e-4
                unit, ids = part["unit"], part["ids"]
                order = np.random.default_rng(11).permutation(len(unit))[: ROUNDS * audit]
                q, own = sample.get(r["dim"], (unit[:0], ids[:0]))
                links = lambda a, b: int((own[a] != ids[b]).sum())  # noqa: B023, E731
                want = done = 0
                while done < len(order) and (not done or want < ENOUGH):
                    more = order[done : done + audit]
                    q, own, done = np.concatenate([q, unit[more]]), np.concatenate([own, ids[more]]), done + len(more)
                    scans = (np.nonzero(q[p : p + 64] @ unit.T >= bound) for p in range(0, len(q), 64))
                    want = sum(links(a + 64 * k, b) for k, (a, b) in enumerate(scans))
                ef = START
                while True:
                    got = links(*part["graph"].within(q, bound, ef))
                    if ef >= len(unit) or got >= RECALL * want:
                        break
                    ef *= 2
                yield pa.RecordBatch.from_arrays([pa.array([r["dim"]], pa.int32()), pa.array([r["shard"]], pa.int32()), pa.array([ef], pa.int32()), pa.array([min(1.0, got / want) if want else None], pa.float64()), pa.array([want])], ["dim", "target", "ef", "recall", "links"])

    return run


def _query(folder: str, least: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def get(dim: int, shard: int) -> dict:
            if (dim, shard) not in held:
                if len(held) > 2:
                    held.pop(next(iter(held)))
                held[dim, shard] = _load(folder, dim, shard)
            return held[dim, shard]

        for batch in rows:
            for r in sorted(batch.to_pylist(), key=lambda r: (r["dim"], r["target"], r["shard"], r["lo"])):
                ours, theirs = get(r["dim"], r["shard"]), _searchable(get(r["dim"], r["target"]))
                q64 = _unit(ours["v"][r["lo"] : r["hi"]])
                a, b = theirs["graph"].within(q64.astype(np.float32), least - 1e-4, r["ef"])
                cos = np.concatenate([np.einsum("nd,nd->n", q64[a[p : p + 100_000]], _unit(theirs["v"][b[p : p + 100_000]])) for p in range(0, len(a), 100_000)] or [np.empty(0)])
                a, b = a[cos >= least], b[cos >= least]
                if r["shard"] == r["target"]:  # each pair once
                    later = b > a + r["lo"]
                    a, b = a[later], b[later]
                ids = ours["ids"][r["lo"] : r["hi"]]
                from_a = np.bincount(a, theirs["copies"][b], len(ids)).astype(np.int64)
                from_b = np.bincount(b, ours["copies"][r["lo"] : r["hi"]][a], len(theirs["ids"])).astype(np.int64)
                ends = np.concatenate([ids[from_a > 0], theirs["ids"][from_b > 0]])
                counts = np.concatenate([from_a[from_a > 0], from_b[from_b > 0]])
                x, y = _forest(ids[a], theirs["ids"][b]) if len(a) else (np.empty(0, np.int64),) * 2
                no = np.arange(len(ends) + len(x)) < len(ends)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ends, x])), pa.array(np.concatenate([np.full(len(ends), -1), y]), mask=no), pa.array(np.concatenate([counts, np.zeros(len(x), np.int64)]))], ["a", "b", "links"])

    return run


def link_vectors(vectors: DataFrame, scratch: C.Scratch, least: float = 0.95, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES, audit: int = AUDIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall, audit_links) for each row of `vectors` (vec_id, embedding).

    Two vectors of the same length are linked if their cosine, in double precision, is `least` or
    more; n_links counts the other vectors linked, component_id is the smallest vec_id reachable. A
    vector that is null, empty, zero, or has a null or non-finite component links with nothing, nor
    does one without vec_id (component_id is its vec_id). Rows that share a vec_id and vector are
    copies of each other. Extra columns are ignored; an empty table gives an empty one. Vectors of doubles
    stay doubles; only the graphs are searched in single precision, with a margin.

    Equal vectors are one node with a count. Nodes are dealt to shards of at most about `shard_rows` rows and `shard_bytes` of vectors by hash
    (SHARDS at least), one graph each, written to the shared folder. Each graph is audited: `audit` of all
    vectors (those of the smallest hashes) and `audit` of its own, or more of these until there are ENOUGH links, are compared with its whole
    shard, and its beams widen until they find RECALL of the links; audit_recall is what the vector's own
    shard reached (null if the audit met no link), audit_links of how many. That is work in proportion to the vectors. Then every block of queries goes to the graphs of its own
    shard and of those after it, so each pair of vectors is looked for once, and a link counts for both ends. A
    beam that fills with links widens until it does not. A task passes on counts and a spanning forest,
    not its pairs.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = (F.size("embedding") > 0) & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0)
    base = base.withColumn("good", F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull())
    nodes = base.where("good").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    nodes = scratch.table(nodes.withColumn("dim", F.size("embedding")), "nodes")
    width = 8 if kind == "array<double>" else 4
    sizes = nodes.groupBy("dim").agg(F.count("*").alias("n")).agg(F.max("n"), F.max(F.col("n") * F.col("dim") * width)).first()
    shards = max(SHARDS, -(-(sizes[0] or 0) // shard_rows), -(-(sizes[1] or 0) // shard_bytes))
    folder = scratch.folder("graphs")
    placed = nodes.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))
    files = placed.groupBy("dim", "shard").applyInArrow(_build(folder), "dim int, shard int, n long")
    files = scratch.table(files, "files")
    some: dict[int, list] = {}
    for r in nodes.orderBy(F.xxhash64("rep", F.lit(17)), "rep").limit(audit).select("dim", "embedding", "rep").collect():
        some.setdefault(r.dim, []).append((r.embedding, r.rep))
    sample = {d: (_unit(np.array([x for x, _ in v])).astype(np.float32), np.array([i for _, i in v])) for d, v in some.items()}
    parts = max(1, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))
    audits = scratch.table(files.repartition(parts, "dim", "shard").mapInArrow(_audit(folder, least, sample, audit), _AUDITED), "audits")
    lists = files.groupBy("dim").agg(F.collect_list("shard").alias("targets"))
    work = files.join(lists, "dim").select("dim", "shard", "n", F.explode("targets").alias("target")).where("shard <= target")
    work = work.select("dim", "shard", "target", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))).alias("lo")).withColumn("hi", F.least(F.col("lo") + BLOCK, "n"))
    work = work.join(F.broadcast(audits.select("dim", "target", "ef")), ["dim", "target"])  # one row a shard
    found = scratch.table(work.repartition(parts).mapInArrow(_query(folder, least), "a long, b long, links long"), "found")
    comp = C.components(found.where("b is not null").select("a", "b"), scratch)
    links = found.groupBy(F.col("a").alias("l_rep")).agg(F.sum("links").alias("links"))
    recall = audits.select("dim", F.col("target").alias("shard"), "recall", F.col("links").alias("audited"))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int")).join(F.broadcast(recall), ["dim", "shard"], "left")
    nodes = nodes.join(links, F.col("rep") == F.col("l_rep"), "left").join(comp, F.col("rep") == F.col("node"), "left").select(F.col("embedding").alias("e2"), "rep", "copies", "links", "component", "recall", "audited")
    out = base.join(nodes, F.col("good") & (F.col("embedding") == F.col("e2")), "left")
    n_links = F.when(F.col("good"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0)
    scratch.only("nodes", "found", "audits", *[x for x in scratch.names if x.startswith("cc-")])
    return out.select("vec_id", n_links.cast("long").alias("n_links"), F.when(F.col("good"), F.coalesce("component", "rep")).otherwise(F.col("vec_id")).alias("component_id"), F.when(F.col("good"), F.col("recall")).alias("audit_recall"), F.when(F.col("good"), F.col("audited")).alias("audit_links")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(C.read(spark, sf_dir, "embeddings"), C.Scratch(spark, "hnsw"))

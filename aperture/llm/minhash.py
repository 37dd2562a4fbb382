"""ProbMinHash near-duplicate detection on weighted five-word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aperture.llm import common as C

WORDS = 5
BANDS, ROWS = 25, 4
LOW48 = np.uint64((1 << 48) - 1)


def shingles(h: np.ndarray, first: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, 48-bit shingle, how often) of each distinct shingle of each text, sorted.

    A text of fewer words has one shingle, all its words; a text without words has none.
    """
    n = np.diff(first)
    acc = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(acc)]
    text = np.repeat(np.arange(len(n)), np.maximum(n - words + 1, 0))
    at = np.arange(len(text)) + np.repeat(first[:-1] - np.append(0, np.cumsum(np.maximum(n - words + 1, 0))[:-1]), np.maximum(n - words + 1, 0))
    acc = acc[at]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            has = n[short] > k
            own[has] = own[has] * np.uint64(0x9E3779B97F4A7C15) + h[first[short[has]] + k]
        text, acc = np.concatenate([text, short]), np.concatenate([acc, own + n[short].astype(np.uint64)])
    key = (text.astype(np.uint64) << np.uint64(48)) | (C.mix(acc) >> np.uint64(16))
    key.sort()
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return (key[new] >> np.uint64(48)).astype(np.int64), key[new] & LOW48, np.diff(np.append(new, len(key)))


def probminhash(text: np.ndarray, item: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """The [texts, m] registers of ProbMinHash (Ertl, 2020): the items that arrive first.

    Each item is a Poisson process of rate `weight` whose points, drawn from the item alone, fall
    on random registers; a register keeps the item of its earliest point. An item stops once its
    next point comes later than every register of its text. Two texts agree in a register with
    their probability Jaccard similarity.
    """
    reg, kept = np.full(texts * m, np.inf), np.zeros(texts * m, np.uint64)
    t, s, w, x, k = text, item, weight, np.zeros(len(item)), 0
    while len(t):
        r = C.mix(s + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) / w
        at = t * m + ((C.mix(r) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(reg, at, x)
        won = reg[at] == x
        kept[at[won]] = s[won]
        live = x < reg.reshape(texts, m).max(1)[t]
        t, s, w, x, k = t[live], s[live], w[live], x[live], k + 1
    return kept.reshape(texts, m)


def _bands(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key of each band of each text's registers."""
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    for k in range(rows):
        acc = C.mix(acc * np.uint64(0x9E3779B97F4A7C15) + sig[:, k::rows])
    return acc


_SIG = "doc_id long, ca long, cb long, n int, bands array<long>, grams array<int>"


def _signatures(words: int, bands: int, rows_: int, carry: tuple[str, ...] = ()):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.batches(rows, "text", rows_most=1 << 15):
            n = batch.num_rows
            h, first = C.word_hashes(*C.bytes_of(batch.column(batch.schema.get_field_index("text"))))
            text, item, often = shingles(h, first, words)
            acc = _bands(probminhash(text, item, 1 + np.log(often), n, bands * rows_), bands, rows_)
            twice = np.bincount(text, often > 1, n) > 0  # only these have other registers if all weights are one
            part = twice[text]
            plain = _bands(probminhash((np.cumsum(twice) - 1)[text[part]], item[part], np.ones(part.sum()), int(twice.sum()), bands * rows_), bands, rows_)
            copies = [xxhash.xxh3_128_digest(h[first[i] : first[i + 1]]) for i in range(n)]
            copies = np.frombuffer(b"".join(copies), np.int64).reshape(n, 2)
            off = np.searchsorted(text, np.arange(n + 1))
            some = np.diff(off) > 0
            width = np.where(some, bands, 0) + np.where(twice, bands, 0)
            at = np.append(0, np.cumsum(width))
            keys = np.empty(at[-1], np.uint64)
            keys[(at[:-1][some][:, None] + np.arange(bands)).ravel()] = acc[some].ravel()
            keys[(at[:-1][twice][:, None] + bands + np.arange(bands)).ravel()] = plain.ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")), pa.array(copies[:, 0]), pa.array(copies[:, 1]), pa.array(np.diff(off).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array((item >> np.uint64(16)).astype(np.uint32).view(np.int32))),
                    *(batch.column(batch.schema.get_field_index(c)) for c in carry),
                ],
                ["doc_id", "ca", "cb", "n", "bands", "grams", *carry],
            )

    return run


def rare_shingles(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, rep, met, n, left): the shingles by which documents of `sets` (rep, met, n, grams) can find all that are similar to them.

    Sets of a similarity s share s of the larger one's shingles at least, so the n - ceil(s n) + 1 rarest of
    one and of the other meet (prefix filtering: Chaudhuri et al., 2006). Those of one document only are left out.
    left counts the shingle and all less rare ones: no more are shared by two that meet there first (Xiao et al., 2008).
    """
    each = sets.withColumn("set", F.xxhash64("grams")).dropDuplicates(["rep", "set"]).select("rep", "met", "set", F.explode(F.array_distinct("grams")).alias("gram"))
    often = each.groupBy(F.col("gram").alias("key")).agg(F.count("*").alias("often"))
    each = each.join(often, F.col("gram") == F.col("key")).groupBy("rep", "met", "set").agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("all")).withColumn("n", F.size("all"))
    first = F.slice("all", F.lit(1), (F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).cast("int"))
    return each.select("rep", "met", "n", F.posexplode(first).alias("at", "x")).where("x.often > 1").select(F.col("x.gram").cast("long").alias("key"), "rep", "met", "n", (F.col("n") - F.col("at")).alias("left"))


def near_duplicates(docs: DataFrame, scratch: C.Scratch, similarity: float = 0.8, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, class_id, kept, and the columns `carry`) for each row of `docs` (doc_id, text).

    Texts whose shingle sets have a Jaccard similarity of `similarity` or more are linked, and
    class_id is the smallest doc_id among all reachable by links; kept marks that document.
    Candidates share a band of the ProbMinHash registers, in which a shingle that occurs k times
    weighs 1 + ln k, or, as links are defined by sets, of those in which each weighs one (other
    registers only in texts that repeat a shingle); every link is verified on the whole sets. A pair
    of similarity 0.8 shares none of 25 bands of 4 with a probability of 2 in a million.

    A null or empty text, or one of spaces, links with nothing (class_id = doc_id); a text of fewer
    words than a shingle has one shingle, all its words. Rows that share a doc_id count as one
    document. A null doc_id takes the class of its exact copies, if any, and is kept only if none has
    an id. Other columns are ignored; an empty table gives an empty one.

    Equal texts are one node. In each band bucket a centre, the document that meets most others over
    all its buckets, is compared with those not yet in its component. The documents of buckets that
    are then still divided, say by a passage that many share, are dealt anew by the shingles that
    two similar sets must share (rare_shingles), which that passage is not. Further rounds take 16 times
    as many new centres each, until each bucket is one component or all its documents were centres.
    So a bucket's pairs are never listed at once, and a pair that a bucket suggests goes untested
    only when its documents are already connected or cannot be similar.
    """
    more = "".join(f", {c} {t}" for c, t in docs.dtypes if c in carry)
    carry = tuple(c for c in docs.columns if c in carry)
    sig = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry).mapInArrow(_signatures(words, bands, rows, carry), _SIG + more), "sig")
    copies = sig.where("n > 0").groupBy("ca", "cb").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    copies = scratch.table(copies, "copies")
    keys = copies.where("rep is not null").select("rep", F.explode(F.array_distinct("bands")).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("g"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("key", "g")
    active = scratch.table(keys.join(shared, "key").select("key", "rep", "g").distinct(), "active")
    met = active.groupBy("rep").agg(F.sum("g").alias("met"))
    sets = scratch.table(sig.join(met.select(F.col("rep").alias("doc_id"), "met"), "doc_id").select(F.col("doc_id").alias("rep"), "met", "n", "grams"), "sets")
    active = scratch.table(active.join(sets.select("rep", "met", "n").distinct(), "rep").select("key", "rep", "met", "n", F.col("n").alias("left")).withColumn("tried", F.lit(0)), "met")
    comp = edges = None
    share = similarity / (1 + similarity)  # of both sets' sizes that two similar sets have in common at least
    k = 0
    while True:
        if k == 1:  # what one centre a bucket has left divided
            some = active.select(F.col("rep").alias("r")).distinct()
            active = scratch.table(rare_shingles(sets.join(some, F.col("rep") == F.col("r"), "left_semi"), similarity).withColumn("tried", F.lit(0)), "rare")
        now = active.withColumn("comp", F.col("rep")) if comp is None else active.join(comp, active.rep == comp.node, "left").select("key", "rep", "met", "n", "left", "tried", F.coalesce("component", "rep").alias("comp"))
        split = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("tried").alias("some"), F.min("n").alias("fewest")).where("lo <> hi and some = 0").select("key", "fewest")
        now = now.join(split, "key").where(F.col("left") >= share * (F.col("n") + F.col("fewest")) - 1e-6).drop("fewest")
        if k == 0:
            centre = now.groupBy("key").agg(F.max(F.struct("met", -F.col("rep"))).alias("c")).select("key", (-F.col("c.col2")).alias("centre"))
        else:
            rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("met"), "rep"))
            centre = now.where("tried = 0").withColumn("r", rank).where(F.col("r") <= 16**k).select("key", F.col("rep").alias("centre"))
        now = scratch.table(now, f"now-{k}")
        centre = scratch.table(centre.distinct(), f"centre-{k}")
        if centre.isEmpty():
            break
        ours = centre.join(now.select("key", F.col("rep").alias("centre"), F.col("comp").alias("own"), F.col("n").alias("own_n"), F.col("left").alias("own_left")), ["key", "centre"])
        enough = F.least("left", "own_left") >= share * (F.col("n") + F.col("own_n")) - 1e-6
        pairs = now.join(ours, "key").where((F.col("comp") != F.col("own")) & (F.col("rep") != F.col("centre")) & enough).select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
        left, right = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga")), sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
        both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("ga", "gb")))
        found = both.where(F.col("i") >= similarity * (F.col("na") + F.col("nb") - F.col("i")) - 1e-9).select("a", "b")
        found = scratch.table((found if edges is None else found.union(edges)).distinct(), f"edges-{k}")
        edges, comp = found, scratch.table(C.components(found, scratch, f"cc-{k}"), f"comp-{k}")
        done = centre.select("key", F.col("centre").alias("rep"), F.lit(1).alias("t"))
        active = now.join(done, ["key", "rep"], "left").select("key", "rep", "met", "n", "left", F.greatest("tried", F.coalesce("t", F.lit(0))).alias("tried"))
        if k == 0:  # only buckets that are still divided
            now = active.join(comp, active.rep == comp.node, "left").withColumn("comp", F.coalesce("component", "rep"))
            divided = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("tried").alias("some")).where("lo <> hi and some = 0").select("key")
            active = active.join(divided, "key", "left_semi")
        active = scratch.table(active, f"active-{k}")
        scratch.only("sig", "copies", "sets", f"edges-{k}", f"comp-{k}", f"active-{k}")
        k += 1
    scratch.only("sig", "copies", f"comp-{k - 1}")
    out = sig.select("doc_id", "n", "ca", "cb", *carry).join(copies.select("ca", "cb", "rep"), ["ca", "cb"], "left")
    if comp is not None:
        out = out.join(comp, out.rep == comp.node, "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    cls = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", cls.alias("class_id"), *carry).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read(spark, sf_dir, "documents"), C.Scratch(spark, "minhash"))

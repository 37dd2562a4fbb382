"""Removal of repeated byte strings by a logarithmic family of sampled suffix arrays in the shared folder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aperture.llm import common as C

LENGTH, GRAM, BATCHES = 200, 32, 2
_BYTES = np.random.Generator(np.random.PCG64(77)).integers(1, 2**64, 256, np.uint64) | np.uint64(1)
_POS = np.uint64((1 << 24) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes that begin at each place, by five doublings."""
    h = _BYTES.take(data)
    for k, odd in enumerate(_ODD):
        h = h[: -(1 << k)] * odd + h[1 << k :]
        h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, chunk: int = 1 << 17) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, anchor, first, last, gram) arrays: the sampled suffixes and the windows each stands for.

    Every window of `length` bytes has as its anchor the leftmost 32 bytes of smallest hash in it,
    so equal windows have equal anchors at equal places; windows first..last of a text (all places
    count in `data`) share one anchor. One place in about 85 is an anchor.
    """
    span = length - GRAM + 1
    long = np.flatnonzero(np.diff(off) >= length)
    if not len(long):
        return
    lo, hi = off[long], off[long + 1]
    p, held = int(lo[0]), None  # held: the last of the chunk before, which may go on
    while p <= hi[-1] - length:  # windows that begin in [p, q)
        q = p + chunk
        part = data[p : min(q + length - 1, hi[-1])]
        if len(part) < length:
            break
        h = _grams(part)
        m = (C.mix(h) & ~_POS) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while step * 2 <= span:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        m = np.minimum(m[: len(h) - span + 1], m[span - step :][: len(h) - span + 1]) & _POS
        m = m.astype(np.int64)
        at = np.arange(p, p + len(m))
        text = np.searchsorted(hi, at, "right")
        text = np.minimum(text, len(long) - 1)
        ok = (at >= lo[text]) & (at + length <= hi[text])
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (m[1:] != m[:-1]) | (text[1:] != text[:-1])
        end = ok.copy()
        end[:-1] &= ~ok[1:] | new[1:]
        a, b = np.flatnonzero(new), np.flatnonzero(end)
        if len(a):
            found = [long[text[a]], m[a] + p, a + p, b + p, h[m[a]]]
            if held is not None:
                if found[0][0] == held[0][0] and found[1][0] == held[1][0]:
                    found[2][0] = held[2][0]
                else:
                    found = [np.concatenate(x) for x in zip(held, found)]
            held = [x[-1:] for x in found]
            if len(found[0]) > 1:
                yield tuple(x[:-1] for x in found)
        p += len(m)
    if held is not None:
        yield tuple(held)


class Runs:
    """A map task's share of a new suffix array: sorted runs of (prefix, gram, window hash, count), merged geometrically.

    Each run is at most half as long as the one before it. What comes in is sorted, merged with the runs
    that are not longer than it, and so on upwards, so n entries cost n log n in all.
    """

    def __init__(self):
        self.runs: list[tuple[np.ndarray, ...]] = []

    @staticmethod
    def sort(k, g, f, c):
        order = np.lexsort((f, g, k))
        k, g, f, c = k[order], g[order], f[order], c[order]
        first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (f[1:] != f[:-1]))) if len(g) else np.empty(0, np.int64)
        return k[first], g[first], f[first], np.add.reduceat(c, first) if len(first) else c

    def add(self, *new: np.ndarray) -> None:
        new = self.sort(*new)
        while self.runs and len(self.runs[-1][0]) <= 2 * len(new[0]):
            new = self.merge(self.runs.pop(), new)
        self.runs.append(new)

    def merge(self, a, b):
        return self.sort(*(np.concatenate(x) for x in zip(a, b)))

    def whole(self):
        while len(self.runs) > 1:
            b, a = self.runs.pop(), self.runs.pop()
            self.runs.append(self.merge(a, b))
        return self.runs[0] if self.runs else (np.empty(0, np.int64),) * 4


def _windows(data: np.ndarray, a: np.ndarray, b: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the bytes from each first window's begin to its last one's end, and of the anchor's place in them."""
    whole = memoryview(np.ascontiguousarray(data))
    h = xxhash.xxh3_64_intdigest
    got = np.fromiter((h(whole[i:j]) for i, j in zip(a.tolist(), (b + length).tolist())), np.uint64, len(a))
    return C.mix(got ^ ((anchor - a).astype(np.uint64) * _ODD[0]))


def _prefix(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first eight bytes of the suffixes that begin at `at`, as signed numbers in the order of the bytes."""
    got = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[at]).view(">u8").ravel()
    return (got.astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _sampled(rows: Iterator[pa.RecordBatch], length: int):
    for batch in C.batches(rows, "text", 4 << 20):
        data, off = C.bytes_of(batch.column(batch.schema.get_field_index("text")))
        for text, anchor, a, b, gram in anchors(data, off, length):
            yield batch, data, off, text, anchor, a, b, gram


_ENTRY = "part int, k long, g long, f long, c long, old long"
#: Splitters of ranges are taken from every so manieth document, about so many keys a range.
SAMPLED, KEYS = 16, 32


def _entries(length: int, splitters: list[tuple[int, int, int]]):
    """The sorted array of a batch, each entry with the range of keys that it is in; equal entries of a task are one with a count."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Runs()

        def out():
            k, g, f, c = own.whole()
            own.runs.clear()
            cuts = []
            for sk, sg, sf in splitters:
                lo, hi = np.searchsorted(k, sk, "left"), np.searchsorted(k, sk, "right")
                lo, hi = lo + np.searchsorted(g[lo:hi], sg, "left"), lo + np.searchsorted(g[lo:hi], sg, "right")
                cuts.append(lo + np.searchsorted(f[lo:hi], sf, "left"))
            part = np.searchsorted(np.array(cuts, np.int64), np.arange(len(k)), "right").astype(np.int32)
            for p in range(0, len(k), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[p : p + 50_000]) for v in (part, k, g, f, c, np.zeros(len(c), np.int64))], ["part", "k", "g", "f", "c", "old"])

        n = 0
        for _, data, _, _, anchor, a, b, gram in _sampled(rows, length):
            own.add(_prefix(data, anchor), gram.view(np.int64), _windows(data, a, b, anchor, length).view(np.int64), np.ones(len(a), np.int64))
            if (n := n + len(a)) > 2_000_000:
                yield from out()
                n = 0
        yield from out()

    return run


def _columns(rows: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    """The columns of all batches of a range, which holds about one part in `parts` of the array."""
    found = [[np.asarray(batch.column(batch.schema.get_field_index(n))) for n in names] for batch in rows]
    return [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * len(names)


def _one(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range in the order of keys, with equal entries made one."""
    part, k, g, f, c, old = _columns(rows, ["part", "k", "g", "f", "c", "old"])
    if len(k):
        first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (f[1:] != f[:-1])))
        c, old = np.add.reduceat(c, first), np.add.reduceat(old, first)
        for p in range(0, len(first), 50_000):
            at = first[p : p + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (part[at], k[at], g[at], f[at], c[p : p + 50_000], old[p : p + 50_000])], ["part", "k", "g", "f", "c", "old"])


_SCAN = "g long, f long, c long, old long, single long, before long, n long, edge boolean"


def _scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range in the order of keys: suffixes that begin with the same gram are neighbours there, and each entry is told what stands beside it.

    single, before and n: of the entries of the gram those seen once, what older levels have, and all, counted. The first and the last gram of a
    range may go on in the next one: their entries are marked as an edge, and a row without f has what this range knows of the gram.
    """
    _, _, g, f, c, old = _columns(_one(rows), ["part", "k", "g", "f", "c", "old"])
    if not len(g):
        return
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    size = np.diff(np.append(first, len(g)))
    n, single, before = np.add.reduceat(c, first), np.add.reduceat((c == 1).astype(np.int64), first), np.add.reduceat(old, first)
    edge = np.zeros(len(first), bool)
    edge[[0, -1]] = True
    grams, keep = g[first], np.repeat(edge | (n > 1), size)
    of = np.repeat(np.arange(len(first)), size)[keep]
    g, f, c, old = g[keep], f[keep], c[keep], old[keep]
    names = ["g", "f", "c", "old", "single", "before", "n", "edge"]
    for p in range(0, len(g), 50_000):
        at, q = of[p : p + 50_000], slice(p, p + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (g[q], f[q], c[q], old[q], single[at], before[at], n[at], edge[at])], names)
    ends = np.unique([0, len(first) - 1])
    zero = np.zeros(len(ends), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(grams[ends]), pa.array([None] * len(ends), pa.int64()), pa.array(zero), pa.array(zero), pa.array(single[ends]), pa.array(before[ends]), pa.array(n[ends]), pa.array(edge[ends])], names)


class SuffixIndex:
    """A logarithmic family of sampled suffix arrays, its levels tables in the shared folder.

    A level holds the sampled suffixes of all batches merged into it: (k, g, f, c), in order of k, the
    first eight bytes of the suffix, then by fingerprints of its first 32 bytes (g) and of all the
    windows that it stands for (f); c counts equal ones. A new batch gets a suffix array of its own,
    which is merge-scanned against the levels for long matches (scan), and becomes the
    smallest level (add); a level that is not over twice as long as the one after it is merged with
    it, so there are at most log n levels and an entry is written again log n times.

    All arrays are dealt by the same ranges of (k, g, f), whose borders are taken from a sample of the first batch, and lie in that
    order. So a scan is one pass over a range of all arrays in the order of keys, and a gram with very many contexts
    covers several ranges; equal contexts are counted in map tasks first.
    """

    def __init__(self, scratch: C.Scratch, length: int = LENGTH, parts: int | None = None):
        self.scratch, self.length, self.made = scratch, length, 0
        self.parts = parts or max(1, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))
        self.splitters: list[tuple[int, int, int]] | None = None
        self.levels: list[tuple[int, str, DataFrame]] = []  # entries, name, table; the longest first

    def _array(self, docs: DataFrame) -> DataFrame:
        if self.splitters is None:
            some = docs.where(F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(_entries(self.length, []), _ENTRY)
            some = self.scratch.table(some.select("k", "g", "f"), "keys")
            every = max(1, some.count() // (KEYS * self.parts))
            keys = sorted(tuple(r) for r in some.where(F.pmod(F.xxhash64("g", "f"), F.lit(every)) == 0).collect())  # about KEYS a range
            self.scratch.drop("keys")
            self.splitters = sorted({keys[i * len(keys) // self.parts] for i in range(1, self.parts)}) if keys else []
        return docs.select("text").mapInArrow(_entries(self.length, self.splitters), _ENTRY)

    def _ordered(self, *arrays: DataFrame) -> DataFrame:
        """The arrays as one, each range a partition, in order."""
        whole = arrays[0]
        for t in arrays[1:]:
            whole = whole.union(t)
        return whole.repartitionById(self.parts, "part").sortWithinPartitions("k", "g", "f")

    def _write(self, *arrays: DataFrame) -> tuple[int, str, DataFrame]:
        name, self.made = f"level-{self.made}", self.made + 1
        table = self.scratch.table(self._ordered(*arrays).mapInArrow(_one, _ENTRY), name)
        return table.count(), name, table

    def add(self, docs: DataFrame) -> None:
        """The suffix array of a batch (text) joins the family."""
        new = self._write(self._array(docs))
        while self.levels and self.levels[-1][0] <= 2 * new[0]:
            old = self.levels.pop()
            merged = self._write(old[2], new[2])
            self.scratch.drop(old[1], new[1])
            new = merged
        self.levels.append(new)

    def whole(self) -> DataFrame:
        """The entries of all levels, equal ones as one."""
        return self._ordered(*[t for _, _, t in self.levels]).mapInArrow(_one, _ENTRY).select("k", "g", "f", "c")

    def scan(self, docs: DataFrame, name: str = "scan") -> DataFrame:
        """(g, f, c, old, single, before) of the entries of a new batch (text) and of the levels that share their gram with another: the merge scan.

        c counts the entry in all, old in the levels; single and before count the gram's entries that are seen once, and those of the levels.
        """
        older = [t.withColumn("old", F.col("c")) for _, _, t in self.levels]
        scanned = self.scratch.table(self._ordered(self._array(docs), *older).mapInArrow(_scan, _SCAN), name)
        edges = scanned.where("f IS NULL").groupBy(F.col("g").alias("g2")).agg(*[F.sum(c).alias(f"{c}2") for c in ("single", "before", "n")])  # two rows a range at most
        inner = scanned.where("NOT edge").select("g", "f", "c", "old", "single", "before")
        outer = scanned.where("edge AND f IS NOT NULL").join(F.broadcast(edges), F.col("g") == F.col("g2")).where("n2 > 1").select("g", "f", "c", "old", F.col("single2").alias("single"), F.col("before2").alias("before"))
        return inner.union(outer)

    def matches(self, docs: DataFrame) -> DataFrame:
        """(id, row, a, e, whole) of a new batch (id, row, text), before it is added: its stretches that meet a level.

        whole: all of [a, e) is in an older text, else only its anchor's gram is known to be.
        """
        met = self.scan(docs, f"scan-{self.made}").where("c > old AND before > 0").select("g", "f", (F.col("old") > 0).alias("whole"))
        places = docs.mapInArrow(_places(self.length), _PLACE).join(met, ["g", "f"])
        return places.select("id", "row", "a", (F.col("b") + self.length).alias("e"), "whole")

    def states(self, docs: DataFrame) -> DataFrame:
        """(g, f, state) by a scan of the last batch (text): 1 repeated, 2 seen once beside others at the same gram, 3 both."""
        state = F.when(F.col("c") > 1, F.when(F.col("single") > 0, 3).otherwise(1)).otherwise(2)
        return self.scan(docs).select("g", "f", state.cast("int").alias("state"))


_PLACE = "id long, row long, a int, b int, m int, g long, f long"


def _places(length: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off, text, anchor, a, b, gram in _sampled(rows, length):
            take = lambda name: batch.column(batch.schema.get_field_index(name)).take(pa.array(text))
            f = _windows(data, a, b, anchor, length)
            yield pa.RecordBatch.from_arrays([take("id"), take("row"), *(pa.array((x - off[text]).astype(np.int32)) for x in (a, b, anchor)), pa.array(gram.view(np.int64)), pa.array(f.view(np.int64))], ["id", "row", "a", "b", "m", "g", "f"])

    return run


#: Windows are compared in runs of this many by the bytes that all of them have in common.
RUN = 32


def _pieces(length: int):
    """From (text, spans): a row for each run of RUN windows of each undecided span, keyed by its common bytes."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for doc, row, data, spans in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("id", "row", "text", "spans"))):
                data = (data or "").encode()
                out: list[tuple] = []
                for s in spans:
                    a, b, m = s["a"], s["b"], s["m"]
                    for k in range((m - b) // RUN, (m - a) // RUN + 1):  # windows that begin m - d, for d in [k, k + 1) * RUN
                        lo, hi = max(a, m - k * RUN - RUN + 1), min(b, m - k * RUN)
                        core = slice(m - k * RUN, m - k * RUN - RUN + 1 + length)
                        key = xxhash.xxh3_128_digest(data[core] + s["g"].to_bytes(8, "little", signed=True) + bytes([k]))
                        left = (m - k * RUN) - lo
                        out.append((doc, row, lo, hi, int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), left, data[lo : m - k * RUN] + data[core.stop : hi + length]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [*[pa.int64()] * 7, pa.binary()])], ["id", "row", "lo", "hi", "k1", "k2", "left", "rim"])

    return run


def _rims(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of a piece as a hash of the piece's key and the bytes around the common ones."""
    for batch in rows:
        row, lo, hi, k1, k2, left = (np.asarray(batch.column(batch.schema.get_field_index(x))) for x in ("row", "lo", "hi", "k1", "k2", "left"))
        rim = batch.column(batch.schema.get_field_index("rim")).to_pylist()
        ids = batch.column(batch.schema.get_field_index("id"))
        take, at, h1 = [], [], []
        for i in range(len(lo)):
            for p in range(lo[i], hi[i] + 1):
                d = p - lo[i]  # window p has the last left - d bytes before the common ones and RUN - 1 - (left - d) after them
                n = left[i] - d
                take.append(i)
                at.append(p)
                h1.append(xxhash.xxh3_64_intdigest(rim[i][d : left[i] + RUN - 1 - n], int(k1[i]) & 0xFFFFFFFF))
        t = np.array(take, np.int64)
        h = C.mix(np.array(h1, np.uint64) ^ k2[t].view(np.uint64)) + np.array([left[i] - (p - lo[i]) for i, p in zip(take, at)], np.uint64)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(t)), pa.array(row[t]), pa.array(np.array(at, np.int64)), pa.array(k1[t]), pa.array(h.view(np.int64))], ["id", "row", "at", "k1", "h"])


def spans(docs: DataFrame, scratch: C.Scratch, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """(id, row, spans) of the documents that have bytes to remove; a span [a, e) is within its text.

    `docs` has id, row (a hash of the text; rows of one id and hash are equal texts) and text.

    First the index: the documents come in `batches`; all but the last join it, and the last is merge-scanned against its
    levels and itself. Entries that the scan finds twice mark all their windows, in the last batch and in older ones.
    Then the exact rest: an entry found once beside others at the same gram may still share some
    windows with them. Its windows are compared in runs of 32 by the bytes that the run has in common
    (an edit there settles them at once), and what is left window by window.
    Each intermediate table goes once it has been used; the result is a table of spans alone.
    """
    docs = docs.select("id", "row", "text")
    index = SuffixIndex(scratch, length)
    batch = lambda k: docs.where(F.pmod("row", F.lit(batches)) == k)
    for k in range(batches - 1):
        index.add(batch(k))
    states = index.states(batch(batches - 1))
    for _, name, _ in index.levels:
        scratch.drop(name)
    hits = scratch.table(docs.mapInArrow(_places(length), _PLACE).join(states, ["g", "f"]).select("id", "row", "a", "b", "m", "g", "state", F.when(F.col("state") == 3, F.col("f")).alias("f")), "hits")
    scratch.drop("scan")
    sure = hits.where("state <> 2").select("id", "row", "a", "b")
    one = hits.where("state = 3").groupBy("g", "f").agg(F.min(F.struct("id", "row", "a", "b", "m")).alias("x")).select("x.*", "g")
    open_ = hits.where("state = 2").select("id", "row", "a", "b", "m", "g").union(one)
    lists = open_.groupBy(F.col("id").alias("i2"), F.col("row").alias("r2")).agg(F.collect_set(F.struct("a", "b", "m", "g")).alias("spans"))
    pieces = docs.join(lists, (F.col("id") == F.col("i2")) & (F.col("row") == F.col("r2"))).select("id", "row", "text", "spans").mapInArrow(_pieces(length), "id long, row long, lo long, hi long, k1 long, k2 long, left long, rim binary")
    pieces = scratch.table(pieces.distinct(), "pieces")
    shared = pieces.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    some = scratch.table(pieces.join(shared, ["k1", "k2"]), "some")
    scratch.drop("pieces")
    # a piece as a whole equal to another's is settled; of such pieces one stays to be compared with the others
    equal = some.groupBy("k1", "k2", "left", "rim").agg(F.count("*").alias("n"), F.min(F.struct("id", "row", "lo", "hi")).alias("x"))
    whole = some.join(equal.where("n > 1").select("k1", "k2", "left", "rim"), ["k1", "k2", "left", "rim"]).select("id", "row", F.col("lo").alias("a"), F.col("hi").alias("b"))
    windows = scratch.table(equal.select("x.*", "k1", "k2", "left", "rim").mapInArrow(_rims, "id long, row long, at long, k1 long, h long"), "windows")
    twice = windows.groupBy("k1", "h").agg(F.count("*").alias("n")).where("n > 1").select("k1", "h")
    single = windows.join(twice, ["k1", "h"]).select("id", "row", F.col("at").alias("a"), F.col("at").alias("b"))
    every = sure.union(whole).union(single)
    out = scratch.table(every.groupBy("id", "row").agg(F.collect_set(F.struct("a", (F.col("b") + length).cast("long").alias("e"))).alias("spans")), "spans")
    scratch.drop("hits", "some", "windows")
    return out


def _merged(found) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["a"], s["e"]) for s in found or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(x) for x in out]


def _cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        n, removed, runs, digest, kept = [], [], [], [], []
        for data, found in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("text", "spans"))):
            none, data, gone = data is None, (data or "").encode(), _merged(found)
            left = b"".join(data[i:j] for i, j in zip([0, *(e for _, e in gone)], [*(a for a, _ in gone), len(data)]))
            n.append(len(data))
            removed.append(len(data) - len(left))
            runs.append(len(gone))
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(None if none else left)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("more")), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], ["more", "n_bytes", "n_removed", "n_spans", "kept_sha256", "left_bytes"])


def _cuts(docs: DataFrame, scratch: C.Scratch, length: int, batches: int) -> DataFrame:
    """more (all columns of `docs` as one struct, so that no name can clash), n_bytes, n_removed, n_spans, kept_sha256, left_bytes."""
    # rows without a doc_id are told apart by 128 bits of their text
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(1), "text")).alias("id"), F.xxhash64("text").alias("row"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("more"))
    found = spans(base, scratch, length, batches).select(F.col("id").alias("i2"), F.col("row").alias("r2"), "spans")
    both = base.join(found, (F.col("id") == F.col("i2")) & (F.col("row") == F.col("r2")), "left").select("text", "spans", "more")
    return both.mapInArrow(_cut, f"more {base.schema['more'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, left_bytes binary")


def cut_repeats(docs: DataFrame, scratch: C.Scratch, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, left_bytes.

    Removed is each byte of a string of `length` bytes that also begins anywhere else, in the same text
    or another. A null or empty text has no bytes (left_bytes is null where text is); one shorter than `length` keeps all. Repeated rows
    are copies of each other and lose all strings of `length` bytes or more, and so do rows that share a
    doc_id, or have none, if their texts are equal. Extra columns are ignored, whatever their names; an
    empty table gives an empty one.
    """
    got = _cuts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scratch, length, batches)
    return got.select("more.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "left_bytes")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(C.read(spark, sf_dir, "documents"), C.Scratch(spark, "suffix")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, scratch: C.Scratch) -> DataFrame:
    """The documents with their repeated passages cut out, all other columns as they are.

    A character cut in two goes, and so does a document of which nothing is left, if it had text; one
    whose text was null or empty stays. n_chars, where there is one, becomes the new length.
    """
    left = _cuts(docs, scratch, LENGTH, BATCHES).where((F.octet_length("left_bytes") > 0) | (F.col("n_bytes") == 0))
    text = F.regexp_replace(F.make_valid_utf8(F.col("left_bytes").cast("string")), "\ufffd", "")
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return left.select(*[new.get(c, F.col(f"more.`{c}`")).alias(c) for c in docs.columns])

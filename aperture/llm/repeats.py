"""Periodic runs of words: Gusfield and Stoye's vocabulary of tandem repeats, located and merged into runs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aperture.llm import common as C

LEAST, TIMES = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
GRAM = 3
_ODD = np.uint64(0x9E3779B97F4A7C15)  # a fixed odd multiplier (2^64 over the golden ratio)
_PRIMES = (2147483629, 2147483587)  # the two largest primes under 2^31 - 1


class Sequence:
    """A sequence of small integers with equality and common extensions of any two places, by two prefix hashes modulo 31-bit primes."""

    def __init__(self, x: np.ndarray):
        self.x, self.n, self.sums = x, len(x), []
        rng = np.random.Generator(np.random.PCG64(7))
        for p in _PRIMES:
            base, power = int(rng.integers(2**29, p)), np.ones(max(1, self.n), np.uint64)
            done = 1
            while done < self.n:  # base^0 ... by doubling
                more = min(done, self.n - done)
                power[done : done + more] = power[:more] * np.uint64(pow(base, done, p)) % np.uint64(p)
                done += more
            value = rng.integers(1, p, int(x.max()) + 1 if self.n else 1).astype(np.uint64)[x]
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(value * power[: self.n] % np.uint64(p), out=sums[1:])
            self.sums.append((np.uint64(p), power, sums % np.uint64(p)))

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the `length` items from a and from b are equal (both inside the sequence)."""
        low, high = np.minimum(a, b), np.maximum(a, b)
        out = np.ones(len(a), bool)
        for p, power, sums in self.sums:
            one, two = sums[low + length] + p - sums[low], sums[high + length] + p - sums[high]
            out &= one % p * power[high - low] % p == two % p
        return out

    def ahead(self, a: np.ndarray, b: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        """How many items from a on equal those from b on, up to the end or `most`."""
        high = self.n - np.maximum(a, b) if most is None else np.minimum(most, self.n - np.maximum(a, b))
        return self._longest(high, lambda k, m: self.same(a[k], b[k], m))

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items before a equal those before b."""
        return self._longest(np.minimum(a, b), lambda k, m: self.same(a[k] - m, b[k] - m, m))

    @staticmethod
    def _longest(high: np.ndarray, holds) -> np.ndarray:
        """The largest length in [0, high] that holds, for a property that no longer length regains; short ones are found first."""
        low, high, step = np.zeros(len(high), np.int64), np.maximum(high, 0).astype(np.int64), 1
        rising = np.flatnonzero(high > 0)
        while len(rising):  # double the length while it holds
            m = np.minimum(low[rising] + step, high[rising])
            ok = holds(rising, m)
            low[rising[ok]] = m[ok]
            high[rising[~ok]] = m[~ok] - 1
            rising = rising[ok]
            rising, step = rising[low[rising] < high[rising]], 2 * step
        open_ = np.flatnonzero(low < high)
        while len(open_):
            m = (low[open_] + high[open_] + 1) >> 1
            ok = holds(open_, m)
            low[open_[ok]] = m[ok]
            high[open_[~ok]] = m[~ok] - 1
            open_ = open_[low[open_] < high[open_]]
        return low


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Places in order of the suffixes that begin there, by prefix doubling, for items from 0 to the number of places; a suffix that begins another comes before it."""
    rank, h = x.astype(np.int64), 1
    while True:
        after = np.zeros(len(x), np.int64)
        after[: max(0, len(x) - h)] = rank[h:] + 1
        key = rank * (len(x) + 2) + after
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
        if rank[order[-1]] == len(x) - 1:
            return order
        h *= 2


def lz_blocks(s: Sequence, sa: np.ndarray) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin: each is the longest stretch that also begins earlier, or one new item."""
    n = s.n
    left, right, stack = np.full(n, -1, np.int64), np.full(n, -1, np.int64), []
    for p in sa.tolist():  # the nearest suffixes in order, on either side, that begin earlier
        while stack and stack[-1] > p:
            right[stack.pop()] = p
        if stack:
            left[p] = stack[-1]
        stack.append(p)
    place, longest = np.arange(n), np.zeros(n, np.int64)
    for near in (left, right):
        k = np.flatnonzero(near >= 0)
        longest[k] = np.maximum(longest[k], s.ahead(place[k], near[k]))
    step, h, out = np.maximum(longest, 1).tolist(), 0, []
    while h < n:
        out.append(h)
        h += step[h]
    return np.array(out, np.int64)


def leftmost_squares(s: Sequence, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, k): squares of length 2k that cover the leftmost square of each kind, by extensions from the borders of blocks."""
    ends = np.append(blocks[1:], s.n)
    size = ends - blocks
    starts, periods = [], []

    def keep(border, other, k, begin, good):
        fits = np.flatnonzero(good)
        border, other, k = border[fits], other[fits], k[fits]
        ahead, behind = s.ahead(border, other), s.behind(border, other)
        start = begin(border, other, k, behind)
        return start, k, ahead, behind

    # squares whose second half reaches over the end of a block, the centre in the block
    one = np.flatnonzero(ends < s.n)
    k = _counts(size[one])
    border = np.repeat(ends[one], size[one])
    start, k, ahead, behind = keep(border, border - k, k, lambda b, q, k, back: np.maximum(q - back, q - k + 1), s.x[border] == s.x[border - k])
    ok = ahead + behind >= k
    starts.append(start[ok])
    periods.append(k[ok])
    # squares that begin before a block and whose centre is in it; the right end is in this block or the next
    many = size + np.append(size[1:], 0)
    k = _counts(many)
    border, end = np.repeat(blocks, many), np.repeat(ends, many)
    inside = border + k < s.n
    border, end, k = border[inside], end[inside], k[inside]
    good = (s.x[border] == s.x[border + k]) & (border > 0) & (s.x[border - 1] == s.x[border + k - 1])
    end = end[good]
    start, k, ahead, behind = keep(border, border + k, k, lambda b, q, k, back: np.maximum(b - back, b - k + 1), good)
    ok = (ahead + behind >= k) & (start + k <= end)
    starts.append(start[ok])
    periods.append(k[ok])
    return np.concatenate(starts), np.concatenate(periods)


def _counts(sizes: np.ndarray) -> np.ndarray:
    """1 ... size for each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1


def primitive(s: Sequence, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the k items from start on are no power of a shorter stretch."""
    out, rest = np.ones(len(k), bool), k.copy()
    factor = np.arange(int(k.max(initial=0)) + 1)
    for p in range(2, math.isqrt(len(factor)) + 1):
        if factor[p] == p:
            multiples = factor[p * p :: p]
            multiples[multiples == np.arange(p * p, len(factor), p)] = p
    while (open_ := np.flatnonzero(out & (rest > 1))).size:
        p = factor[rest[open_]]
        d = k[open_] // p
        out[open_] &= ~s.same(start[open_], start[open_] + d, k[open_] - d)
        rest[open_] //= p
    return out


class SuffixTree:
    """The loci of a suffix tree as intervals of the suffix array: edge by edge they are the same, and suffix links are ranks of the next place."""

    def __init__(self, s: Sequence, sa: np.ndarray):
        self.s, self.sa = s, sa
        self.rank = np.empty(s.n, np.int64)
        self.rank[sa] = np.arange(s.n)

    def _side(self, place: np.ndarray, length: np.ndarray, sign: int) -> np.ndarray:
        """How many suffixes beside that of `place`, in one direction, begin with the same `length` items."""
        rank, s = self.rank[place], self.s

        def holds(k, m):
            other = self.sa[rank[k] + sign * m]
            fits = other + length[k] <= s.n
            out = np.zeros(len(k), bool)
            out[fits] = s.same(place[k][fits], other[fits], length[k][fits])
            return out

        return s._longest(rank if sign < 0 else s.n - 1 - rank, holds)

    def locus(self, place: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The first rank of the suffixes that begin as that of `place`, over `length` items."""
        return self.rank[place] - self._side(place, length, -1)

    def last(self, place: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.rank[place] + self._side(place, length, 1)

    def rotate(self, place: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The suffix link of the square of length 2k at `place`, then the edge that begins with its first item: a place of the next rotation, or -1."""
        s, first = self.s, self.s.x[place]
        inner, length = place + 1, 2 * k - 1
        low, high = self.locus(inner, length), self.last(inner, length)
        end = high.copy()
        while (open_ := np.flatnonzero(low < high)).size:  # the first suffix whose next item is not smaller
            mid = (low[open_] + high[open_]) >> 1
            after = self.sa[mid] + length[open_]
            less = np.where(after < s.n, s.x[np.minimum(after, s.n - 1)], -1) < first[open_]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        at = self.sa[np.minimum(low, end)]
        after = at + length
        return np.where((after < s.n) & (s.x[np.minimum(after, s.n - 1)] == first), at, -1)


def vocabulary(s: Sequence, tree: SuffixTree, start: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, k) of one square of every primitive kind in the sequence: from the leftmost ones by suffix-link walks.

    A walk goes from a square to its next rotation. While the item after the square is its first one the rotation stands one
    place on, and all such steps are made at once; then the rotation is looked up in the tree. It ends where
    no such rotation is in the tree, after k rotations, or at one that another walk has marked and goes on from.
    """
    ok = primitive(s, start, k)
    start, k = start[ok], k[ok]
    marked, places, periods = np.empty(0, np.int64), [], []
    while len(start):
        more = s.ahead(start, start + k, 2 * k - 1) - k  # k - 1 steps lead round all rotations
        count = more + 1
        at = np.repeat(start, count) + _counts(count) - 1
        of, period = np.repeat(np.arange(len(start)), count), np.repeat(k, count)
        key = tree.locus(at, 2 * period) * (s.n + 1) + period
        key, index = np.unique(key, return_index=True)
        new = index[~np.isin(key, marked, assume_unique=True)]
        marked = np.union1d(marked, key)
        places.append(at[new])
        periods.append(period[new])
        goes = np.zeros(len(start), bool)  # whose last rotation is marked only now
        ends = (at == (start + more)[of])[new]
        goes[of[new][ends]] = True
        goes &= more < k - 1
        ahead = tree.rotate((start + more)[goes], k[goes])
        start, k = ahead[ahead >= 0], k[goes][ahead >= 0]
    return (np.concatenate(places), np.concatenate(periods)) if places else (np.empty(0, np.int64),) * 2


def runs_of(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of all runs of a sequence with length >= max(least, times * period), by start, then period."""
    if len(x) < 2:
        return np.empty((0, 3), np.int64)
    s, sa = Sequence(x), suffix_array(x)
    place, k = vocabulary(s, tree := SuffixTree(s, sa), *leftmost_squares(s, lz_blocks(s, sa)))
    low = tree.locus(place, 2 * k)
    count = tree.last(place, 2 * k) - low + 1
    at = sa[np.repeat(low, count) + _counts(count) - 1]  # every occurrence of every kind: the leaves below its locus
    k = np.repeat(k, count)
    order = np.lexsort((at, k))
    at, k = at[order], k[order]
    first = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(k) != 0))) if len(at) else np.empty(0, np.int64)
    final = np.append(first[1:], len(at))[: len(first)] - 1
    out = np.stack([at[first], at[final] - at[first] + 2 * k[first], k[first]], 1)
    out = out[out[:, 1] >= np.maximum(least, times * out[:, 2])]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def stretches(words: np.ndarray, off: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Stretches [a, b) of the texts' words that between them hold every run; usually few.

    In a run of period q each gram of words but those of its first q places was last seen at most q places earlier in the text:
    so many grams in a row. For each power of two the rows of grams seen at most so far back that are long enough
    for a period over its half are taken, with the words around them that such a run may add.
    """
    n = len(words) - GRAM + 1
    grams = lambda q: max(least, times * q) - q - GRAM + 1  # noqa: E731  of them a run has so many at least; the fewest by q near least / times
    turn = (least // times, least // times + 1)
    if n <= 0 or min(map(grams, (1, *(q for q in turn if q)))) < 1:
        return [(int(a), int(b)) for a, b in zip(off[:-1], off[1:], strict=True) if b > a]
    gram = words[:n].copy()
    for j in range(1, GRAM):
        gram = C.mix(gram * _ODD + words[j : n + j])
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    gram = C.mix(gram + text[:n].astype(np.uint64) * _ODD)  # grams over the end of a text only add candidates
    order = np.argsort(gram, kind="stable")
    far = np.full(n, n + 1, np.int64)
    again = gram[order[1:]] == gram[order[:-1]]
    far[order[1:][again]] = (order[1:] - order[:-1])[again]
    found, scale = [], 1
    while True:
        near = far <= scale
        need = min(map(grams, (scale // 2 + 1, scale, *(q for q in turn if scale // 2 < q <= scale))))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]])))
        a, b = edge[::2], edge[1::2]
        long = b - a >= need
        if len(a):
            a, b = a[long], b[long]
            first = off[text[a]]
            found += zip(np.maximum(a - scale, first).tolist(), np.minimum(b + GRAM - 1, len(words)).tolist(), strict=True)
        scale *= 2
        if scale > 2 * len(words):
            break
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    bounds = off[1:-1]
    cut = []
    for a, b in out:  # a run is in one text
        inner = bounds[np.searchsorted(bounds, a, "right") : np.searchsorted(bounds, b, "left")].tolist()
        cut += [(p, q) for p, q in zip([a, *inner], [*inner, b], strict=True) if q - p >= least]
    return cut


def runs_of_texts(words: np.ndarray, off: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """(text, start in the text, length, period) of all runs of all texts, and where each text's runs begin (n + 1 places)."""
    parts = stretches(words, off, least, times)
    if not parts:
        return np.empty((0, 4), np.int64), np.zeros(len(off), np.int64)
    a, b = np.array(parts, np.int64).T
    size = b - a + 1
    place = np.repeat(a, size) + _counts(size) - 1
    stop = np.cumsum(size) - 1  # after each stretch an item that is nowhere else, so that nothing repeats across it
    place[stop] = 0
    _, x = np.unique(words[place], return_inverse=True)
    x = x.astype(np.int64)
    x[stop] = x.max() + 1 + np.arange(len(stop))
    runs = runs_of(x, least, times)
    part = np.searchsorted(stop, runs[:, 0])
    begin = runs[:, 0] - (stop[part] - size[part] + 1) + a[part]
    text = np.searchsorted(off, begin, "right") - 1
    out = np.stack([text, begin - off[text], runs[:, 1], runs[:, 2]], 1)
    out = out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]
    return out, np.searchsorted(out[:, 0], np.arange(len(off)))


def collapse_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """`docs` with n_words, runs (of words: start, length, smallest period; by start, then period) and collapsed, the text without what runs repeat.

    A run is a stretch of words, `[^\\x20\\x09-\\x0D]+` numbered from 0, with words of one smallest period q apart equal, that no neighbouring
    word extends, and of at least max(least, times * q) words (times at least 2). A word goes that any run contains after that run's first q words; `collapsed` is
    the others, joined by one space. A null or empty text has no words, no runs and an empty `collapsed`. Rows are judged one by one, so repeated
    rows, ties and null ids make no difference; all columns of `docs` stay, but those of the three names above, which are replaced.

    Nothing is shuffled and nothing outlives a batch. Texts are taken about 8 MB at a time, a longer one alone (a stretch
    takes some 250 bytes a word while it is searched, and up to 700 where it is dense with squares). Only `stretches` that can hold a run are searched; those of a batch are laid end to
    end as one sequence, so that short texts share the steps of numpy.
    """
    if least < 2 or times < 2:
        raise ValueError("runs hold at least two periods")
    kept = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    if text not in kept:
        raise ValueError(f"no column {text}")
    others = [c for c in kept if c != text] or [text]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = f"row {packed.schema['row'].dataType.simpleString()}, text string, n_words bigint, runs {RUNS}, collapsed string"

    def found(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("start", "length", "period")
        for batch in C.batches(rows, "text"):
            data, ends = C.bytes_of(batch.column(1))
            words, off = C.word_hashes(data, ends)
            got, first = runs_of_texts(words, off, least, times)
            raw, out = data.tobytes(), []
            for i in range(batch.num_rows):
                own = raw[ends[i] : ends[i + 1]].split()
                if first[i] < first[i + 1]:
                    mine = got[first[i] : first[i + 1]]
                    edge = np.zeros(len(own) + 1, np.int64)
                    np.add.at(edge, mine[:, 1] + mine[:, 3], 1)
                    np.add.at(edge, mine[:, 1] + mine[:, 2], -1)
                    own = [own[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                out.append(b" ".join(own).decode())
            values = pa.StructArray.from_arrays([pa.array(got[:, k + 1]) for k in range(3)], fields)
            runs = pa.ListArray.from_arrays(pa.array(first, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(off)), runs, pa.array(out, pa.string())], ["row", "text", "n_words", "runs", "collapsed"])

    return packed.mapInArrow(found, kind).select(*[F.col("text" if c == text else f"row.`{c}`").alias(c) for c in kept], "n_words", "runs", "collapsed")


def made_periodic(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) as the query judges them: where h = crc32(doc_id as text) is divisible by ten, the words from a on repeat p words, as the contract says."""
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1))
    bare = F.btrim(F.coalesce("text", F.lit("")), F.lit(C.SPACES))
    docs = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when((h % 10 == 0) & (bare != ""), F.split(bare, r"[\x20\x09-\x0D]+")).alias("w"))
    docs = docs.withColumn("a", (F.col("g") % F.size("w")).cast("int")).withColumn("p", (1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    places = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    words = F.transform(places, lambda i: F.get(F.col("w"), i))
    return docs.select("doc_id", F.when(F.col("w").isNull(), F.col("text")).otherwise(F.array_join(words, " ")).alias("text"))


def greatest(runs: Column) -> Column:
    """The run with the greatest length over period, compared exactly; ties go to the smallest start, then period, which come first."""
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, b: F.when(better(a, b), b).otherwise(a))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(made_periodic(C.read(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = found.withColumns({"best": greatest(F.col("runs")), "listed": F.array_join(lines, "")})
    best = F.col("best")
    exponent = F.floor(1000 * best["length"] / best["period"]).cast("long")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), exponent.alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )

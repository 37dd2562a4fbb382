import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from aperture.llm import repeats

W = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(x, least=6, times=4):
    """Every run by trying all periods."""
    out = []
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, times * q) and not any(x[i + d : i + n] == x[i : i + n - d] for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for i, n, q in runs for k in range(i + q, i + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def numbers(rng, longest):
    n, letters = rng.randrange(longest), rng.choice([1, 2, 2, 3, 4, 30])
    x = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 4:
            s, p = rng.randrange(n), rng.randrange(1, 9)
            for i in range(s + p, min(n, s + p * rng.randrange(2, 9))):
                x[i] = x[i - p]
    return x


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (5, 3), (20, 4)])
def test_runs_against_all_periods(least, times):
    rng, seen = random.Random(least), 0
    for _ in range(250):
        texts = [numbers(rng, 80) for _ in range(rng.randrange(1, 6))]
        off = np.cumsum([0, *map(len, texts)])
        got, first = repeats.runs_of_texts(np.array([v for x in texts for v in x], np.uint64), off, least, times)
        for i, x in enumerate(texts):
            want = all_runs(x, least, times)
            assert [tuple(r) for r in got[first[i] : first[i + 1], 1:].tolist()] == want, x
            seen += len(want)
    assert seen > 100


def test_vocabulary_is_complete():
    """Each kind of primitive square once, with leftmost squares, LZ blocks and the array behind it."""
    rng = random.Random(5)
    for _ in range(120):
        x = numbers(rng, 60) + [99]
        values, dense = np.unique(x, return_inverse=True)
        s, sa = repeats.Sequence(dense.astype(np.int64)), repeats.suffix_array(dense.astype(np.int64))
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        blocks = repeats.lz_blocks(s, sa).tolist()
        for a, b in zip(blocks, [*blocks[1:], len(x)], strict=True):
            earlier = lambda m, a=a: any(x[p : p + m] == x[a : a + m] for p in range(a))
            assert (b - a == 1 or earlier(b - a)) and not (a + b - a < len(x) and earlier(b - a + 1))
        place, k = repeats.vocabulary(s, repeats.SuffixTree(s, sa), *repeats.leftmost_squares(s, np.array(blocks)))
        got = [tuple(x[p : p + 2 * q]) for p, q in zip(place.tolist(), k.tolist(), strict=True)]
        square = lambda t: len(t) % 2 == 0 and t[: len(t) // 2] == t[len(t) // 2 :]
        power = lambda t: any(len(t) % d == 0 and t == t[:d] * (len(t) // d) for d in range(1, len(t)))
        want = {t for i in range(len(x)) for m in range(2, len(x) - i + 1, 2) if square(t := tuple(x[i : i + m])) and not power(t[: m // 2])}
        assert sorted(got) == sorted(want)


def test_long_texts_and_periods():
    rng = random.Random(8)
    unit = [rng.randrange(50) for _ in range(3000)]
    x = [rng.randrange(50) for _ in range(5000)] + unit * 5 + [1] * 4000 + [2, 3] * 300 + unit[:100]
    got, _ = repeats.runs_of_texts(np.array(x, np.uint64), np.array([0, len(x)]))
    found = {q: (i, n) for _, i, n, q in got.tolist() if n > 400}
    assert set(found) == {3000, 1, 2} and found[1][1] >= 4000
    for q, (i, n) in found.items():
        assert x[i : i + n - q] == x[i + q : i + n] and (i == 0 or x[i - 1] != x[i - 1 + q]) and x[i + n] != x[i + n - q]
    thue = [bin(i).count("1") & 1 for i in range(1 << 13)]  # no power over 2, and the worst case of many hashes
    assert not len(repeats.runs_of(np.array(thue, np.int64), 6, 4)) and len(repeats.runs_of(np.array(thue, np.int64), 2, 2)) > 100


DOCS = [
    (1, "a b " * 10 + "c"), (2, None), (3, ""), (4, " \n\t "), (5, "x x x x x x"), (6, "x x x x x"), (7, "one\ntwo\u00a0three " * 6), (8, "é " * 9 + "ü " * 9), (8, "é " * 9 + "ü " * 9),
    (None, "n o " * 8), (9, "a a b " * 7 + "a a a a a a"), (10, "word"), (11, ("p " * 6 + "q ") * 5), (12, " lead  double   " * 5),
]


def expected(i, text):
    words = W.findall(text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = all_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(collapsed(words, runs)), n)


def test_operator_keeps_columns(spark):
    docs = spark.createDataFrame([(i, t, 7, "r", [1]) for i, t in DOCS], "doc_id long, text string, n_words int, row string, `runs` array<int>").withColumnRenamed("row", "kept")
    out = repeats.collapse_runs(docs)
    assert out.columns == ["doc_id", "text", "kept", "n_words", "runs", "collapsed"]
    rows = out.collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        words = W.findall(r.text or "")
        runs = all_runs(words)
        assert [tuple(x) for x in r.runs] == runs and r.collapsed == collapsed(words, runs) and r.n_words == len(words)
    assert sorted(str(r.text) for r in rows) == sorted(str(t) for _, t in DOCS)
    assert [tuple(x) for x in repeats.collapse_runs(docs.where("doc_id = 5"), least=2, times=2).first().runs] == [(0, 6, 1)]
    assert repeats.collapse_runs(docs.select("text")).columns == ["text", "n_words", "runs", "collapsed"] and repeats.collapse_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        repeats.collapse_runs(docs, times=1)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    words = ["a", "b", "cc", "é", "#x", "d"]
    rows = [*DOCS, *((i, " ".join(rng.choice(words) for _ in range(rng.randrange(120)))) for i in range(100, 400))]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if t) > 20
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", repeats.F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, repeats.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t in rows), key=str) and sum(r[1] for r in got) > 20

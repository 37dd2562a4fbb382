import math
import re
import zlib
from collections import Counter, defaultdict

from aperture.llm import common as C
from aperture.llm import lm


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


def brute(rows):
    train = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    pairs, uni = Counter(), Counter()
    for x in train:
        pairs.update(zip(["</s>", *x[:-1]], x))
        uni.update(x)
    before, after = Counter(w for _, w in pairs), defaultdict(Counter)
    for (v, _), c in pairs.items():
        after[v][min(c, 3)] += 1
    by = lambda cs: lm.discounts(*(sum(c == k for c in cs) for k in (1, 2, 3, 4)))
    d, e = (0, *by(pairs.values())), (0, *by(before.values()))
    n, types, v_all = sum(uni.values()), len(pairs), len(uni)
    left = sum(e[min(c, 3)] for c in before.values()) / types
    out = {}
    for i, t in rows:
        x, s, b = tokens(t), 0.0, 0.0
        for v, w in zip(["</s>", *x[:-1]], x):
            low = max(before[w] - e[min(before[w], 3)], 0) / types + left / (v_all + 1)
            if uni[v]:
                c = pairs[v, w]
                p = max(c - d[min(c, 3)], 0) / uni[v] + sum(d[k] * m for k, m in after[v].items()) / uni[v] * low
            else:
                p = low
            s, b = s + math.log10(p), b + math.log10((uni[w] + 1) / (n + v_all + 1))
        out[i] = (zlib.crc32(str(i).encode()) % 7 == 2, len(x), sum(uni[w] > 0 for w in x), n, b, s)
    return out


def check(spark, rows, tmp_path):
    spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, bucket string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in lm.op3_lm_scoring(spark, str(tmp_path)).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, w in want.items():
        assert tuple(got[i])[1:5] == w[:4]
        assert math.isclose(got[i].base_score, w[4], rel_tol=1e-9) and math.isclose(got[i].score, w[5], rel_tol=1e-9)


def test_against_brute_force(spark, tmp_path):
    words = ["The", "the", "cat", "sat", "on", "a", "mat", "é", "ÀB", "x" * 90]
    rows = [(i, " ".join(words[(i * k * k + k) % (3 + i % 8)] for k in range(5 + i % 40))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "never seen words here"), (104, "the cat " * 3000)]
    check(spark, rows, tmp_path)


def test_probabilities_sum_to_one(spark):
    """Whatever the context, the words of the vocabulary, the end and one unknown word have probability one together."""
    docs = spark.createDataFrame([("a b a c",), ("b a",), ("a b b b",)], "text string")
    words, last = ["a", "b", "c", "zz"], [None, "a", "b", "c", "zz"]  # zz stands for the unknown word; None for the beginning
    texts = {(v, w): " ".join(x for x in (v, w) if x) for v in last for w in (*words, None)}
    ask = spark.createDataFrame([(k, True, t) for k, t in enumerate(texts.values())], "doc_id long, held_out boolean, text string")
    got = dict(zip(texts, (r.score for r in sorted(lm.score(ask, docs, C.Scratch(spark, "t")).collect(), key=lambda r: r.doc_id))))
    end = {v: 10 ** got[v, None] for v in last}  # P(v) P(end | v), or P(end)
    first = {w: 10 ** got[None, w] for w in words}  # P(w) P(end | w)
    # P(end | w) from one more word: P(v, w) / P(w) is the same whatever v was the word before w but for P(w | v)
    close = {w: first[w] / (x := _first(spark, docs, w)) for w in words}
    for v in last:
        begun = 1.0 if v is None else first[v] / close[v]
        total = sum(10 ** got[v, w] / close[w] for w in words) / begun + (end[v] / begun if v is None else close[v])
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def _first(spark, docs, word):
    """P(word | beginning), from the definition."""
    train = [tokens(r.text) for r in docs.collect()]
    pairs = Counter(p for x in train for p in zip(["</s>", *x[:-1]], x))
    before = Counter(w for _, w in pairs)
    by = lambda cs: (0, *lm.discounts(*(sum(c == k for c in cs) for k in (1, 2, 3, 4))))
    d, e = by(pairs.values()), by(before.values())
    uni = Counter(w for x in train for w in x)
    low = max(before[word] - e[min(before[word], 3)], 0) / len(pairs) + sum(e[min(c, 3)] for c in before.values()) / len(pairs) / (len(uni) + 1)
    after = [c for (v, _), c in pairs.items() if v == "</s>"]
    return max(pairs["</s>", word] - d[min(pairs["</s>", word], 3)], 0) / uni["</s>"] + sum(d[min(c, 3)] for c in after) / uni["</s>"] * low


def test_counts_and_buckets():
    assert lm.bucket_bits(0) == lm.bucket_bits(10**9) == lm.BITS and lm.bucket_bits(10**13) == 22
    import numpy as np

    x = np.arange(10**5, dtype=np.uint64)
    assert np.bincount(lm._bucket(x, 12)).min() > 0 and lm._bucket(x, 12).max() < 2**12


def test_counts_over_32_bits(tmp_path):
    """A bucket in which one count needs 64 bits is stored in 64 bits, and read so."""
    import numpy as np

    np.array([3, 9], "<u8").tofile(tmp_path / "pair-0")
    np.array([5, 2**33], "<i8").tofile(tmp_path / "count-0")
    got = lm._find(np.array([9, 4, 3], np.uint64), np.zeros(3, np.int64), f"file://{tmp_path}", "pair", "count", "<u4")
    assert got[:, 0].tolist() == [2**33, 0, 5]


def test_no_training_rows(spark):
    docs = spark.createDataFrame([], "text string")
    ask = spark.createDataFrame([(1, True, "a b"), (2, True, None)], "doc_id long, held_out boolean, text string")
    got = {r.doc_id: r for r in lm.score(ask, docs, C.Scratch(spark, "t")).collect()}
    assert got[1].score == 0 and got[1].n_known == 0 and got[2].n_tokens == 1


def test_no_rows_to_score(spark):
    docs = spark.createDataFrame([("a b",)], "text string")
    none = spark.createDataFrame([], "doc_id long, held_out boolean, text string")
    assert lm.score(none, docs, C.Scratch(spark, "t")).count() == 0

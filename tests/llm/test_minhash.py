import random
import re

import numpy as np

from aperture.llm import common as C
from aperture.llm import minhash


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    have = [(i, sets(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in have}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(have):
        for j, b in have[:k]:
            if a and b and len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in have}


def make(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(60, 300))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = [*make(3), (900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "two\twords"), (905, "three words here"), (906, "word " * 40), (907, "word " * 900), (908, "x" * 50000)]
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, n int, key string")
    got = minhash.near_duplicates(docs, C.Scratch(spark, "t")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows) and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_edges_of_input(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "a b  c d e f g"), (None, "p q r s t u v"), (None, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), C.Scratch(spark, "t")).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == sorted([("1", "1"), ("1", "1"), ("None", "1"), ("2", "1"), ("None", "None"), ("None", "None")])
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), C.Scratch(spark, "t")).count() == 0


def test_buckets_of_copies_that_mostly_are_not_similar(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, rows = [word() for _ in range(90)], []
    for n in range(70):
        copy = list(base)
        for _ in range(rng.randrange(0, 7)):
            if rng.random() < 0.5:
                del copy[rng.randrange(len(copy))]
            else:
                copy[rng.randrange(len(copy))] = word()
        rows.append((n, " ".join(copy)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), C.Scratch(spark, "t")).collect()
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in got} == want and 10 < len(set(want.values())) < 70


def test_a_doc_id_with_two_texts_links_by_both(spark):
    one, two = ("".join(f"{a}{k} " for k in range(40)) for a in "ab")
    rows = [(5, one), (5, two), (6, one + "c"), (7, two + "d"), (8, one + "e f"), (9, "g " + two)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), C.Scratch(spark, "t")).collect()
    assert {(r.doc_id, r.class_id) for r in got} == {(k, 5) for k in range(5, 10)} and len(got) == 6


def test_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    a, b = np.arange(1, 121, dtype=np.uint64), np.arange(41, 161, dtype=np.uint64)
    wa, wb = rng.uniform(0.5, 4, 120), rng.uniform(0.5, 4, 120)
    m = 4096
    sig = minhash.probminhash(np.repeat([0, 1], 120), C.mix(np.concatenate([a, b])), np.concatenate([wa, wb]), 2, m)
    x, y = np.zeros(161), np.zeros(161)
    x[a.astype(int)], y[b.astype(int)] = wa, wb
    want = sum(1 / np.maximum(x / x[d], y / y[d]).sum() for d in range(41, 121))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_repeated_lines_do_not_hide_copies(spark):
    """Texts whose sets are alike but whose weights are far apart, as one repeats a line very often, are linked."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for k in range(12):
        base = [word() for _ in range(124)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + base[-10:] * 60))]
    want = brute(rows)
    assert all(want[2 * k + 1] == 2 * k for k in range(12))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), C.Scratch(spark, "t")).collect()
    assert {r.doc_id: r.class_id for r in got} == want


def test_batches_are_bounded_in_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 100)], ["text"])
    assert [b.num_rows for b in C.batches(iter([batch]), "text", rows_most=30)] == [30, 30, 30, 10]

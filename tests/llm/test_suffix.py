import hashlib
import random
from collections import Counter

from aperture.llm import common as C
from aperture.llm import suffix


def brute(rows, n=200):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i : i + n] for x in data for i in range(len(x) - n + 1))
    out = []
    for (d, _), x in zip(rows, data):
        gone = bytearray(len(x))
        for i in range(len(x) - n + 1):
            if seen[x[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        left = bytes(b for b, g in zip(x, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((str(d), len(x), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghé ") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(rng.randrange(20, 120)) for _ in range(12)]
    rows = []
    for i in range(70):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            if rng.random() < 0.5:
                k = rng.randrange(len(s))
                s = s[:k] + rng.choice(["x", "", "yy"]) + s[k + 1 :]
            if rng.random() < 0.3:
                s = s[rng.randrange(40) : len(s) - rng.randrange(40)]
            parts += [s, text(rng.randrange(0, 30))]
        rows.append((i, " ".join(parts)))
    rows += [(200, None), (201, ""), (202, "a" * 199), (203, "a" * 700), (204, "ab" * 150), (205, rows[3][1]), (206, rows[3][1]), (3, rows[3][1]), (None, rows[4][1][:230]), (None, "q" * 150)]
    rows += [(300, "z" + rows[5][1] + "-"), (301, "".join(rng.choice("xyz") for _ in range(200)))]
    docs = spark.createDataFrame([(i, t, 1, "g") for i, t in rows], "doc_id long, text string, row int, state string")
    got = suffix.cut_repeats(docs, C.Scratch(spark, "t")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)


def test_empty_table(spark):
    assert suffix.cut_repeats(spark.createDataFrame([], "doc_id long, text string"), C.Scratch(spark, "t")).count() == 0


def passages(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [text(rng.randrange(210, 900)) for _ in range(6)]
    return [(i, text(rng.randrange(0, 300)) + (s := rng.choice(shared))[rng.randrange(0, 60) :] + text(rng.randrange(0, 300))) for i in range(60)]


def indexed(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "id long, text string").withColumn("row", F.xxhash64("text"))


def test_runs_halve():
    import numpy as np

    family = suffix.Runs()
    rng = np.random.default_rng(0)
    for _ in range(33):
        g = rng.integers(0, 50, 100)
        family.add(g >> 3, g, rng.integers(0, 50, 100), np.ones(100, np.int64))
        sizes = [len(x[0]) for x in family.runs]
        assert all(b * 2 < a for a, b in zip(sizes, sizes[1:]))
    k, g, f, c = family.whole()
    assert c.sum() == 3300 and sorted(zip(k, g, f)) == list(zip(k, g, f)) and len(set(zip(g, f))) == len(g)


def test_added_batches(spark):
    """Levels written earlier are in the shared folder, a new batch meets them, and the family as a whole is that of one batch."""
    rows = passages(3)
    index = suffix.SuffixIndex(C.Scratch(spark, "t"))
    for k in range(0, 48, 8):
        index.add(indexed(spark, rows[k : k + 8]))
        sizes = [n for n, _, _ in index.levels]
        assert all(b * 2 < a for a, b in zip(sizes, sizes[1:]))
    new, old = rows[48:] + [(99, rows[3][1])], [t for _, t in rows[:48]]
    for r in index.matches(indexed(spark, new)).where("whole").collect():
        assert any(dict(new)[r.id][r.a : r.e] in t for t in old) and r.e - r.a >= 200
    got = {(r.id, p) for r in index.matches(indexed(spark, new)).collect() for p in range(r.a, r.e - 199)}
    grams = {t[p : p + 200] for t in old for p in range(len(t) - 199)}
    assert {(i, p) for i, t in new for p in range(len(t) - 199) if t[p : p + 200] in grams} <= got  # no long match is missed
    index.add(indexed(spark, new))
    one = suffix.SuffixIndex(C.Scratch(spark, "t"))
    one.add(indexed(spark, rows[:48] + new))
    assert sorted(index.whole().collect()) == sorted(one.whole().collect())
    level = index.levels[0][2].collect()
    assert [r.k for r in level] and sum(r.c for r in index.whole().collect()) > len(level)


def test_result_comes_from_the_scan(spark, monkeypatch):
    """op1 scans its last batch against the levels of those before, and what the scan does not tell is not removed."""
    rows, seen = passages(6), []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scan = suffix.SuffixIndex.scan

    def watched(self, docs, name="scan"):
        seen.append((len(self.levels), sum(n for n, _, _ in self.levels)))
        return scan(self, docs, name)

    monkeypatch.setattr(suffix.SuffixIndex, "scan", watched)
    got = suffix.cut_repeats(docs, C.Scratch(spark, "t")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)
    assert len(seen) == 1 and seen[0][0] == 1 and seen[0][1] > 0
    monkeypatch.setattr(suffix.SuffixIndex, "scan", lambda self, docs, name="scan": scan(self, docs, name).where("false"))
    assert sum(r.n_removed for r in suffix.cut_repeats(docs, C.Scratch(spark, "t")).collect()) == 0


def test_a_gram_over_many_ranges(spark):
    """Very many contexts after one header: they cover several ranges, none of which holds most of them, and the result is exact."""
    rng = random.Random(7)
    head = "".join(rng.choice("abcdefgh") for _ in range(150))
    rows = [(i, head + "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60, 120)))) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + "!") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix.cut_repeats(docs, C.Scratch(spark, "t")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)
    index = suffix.SuffixIndex(C.Scratch(spark, "t"), parts=12)
    index.add(docs.select("text"))
    ranges = [r["count"] for r in index.levels[0][2].groupBy("part").count().collect()]
    assert len(ranges) > 4 and max(ranges) < 0.5 * sum(ranges)
    found = {(r.g, r.f): (r.c, r.single) for r in index.scan(spark.createDataFrame([("zzz",)], "text string")).collect()}
    whole = index.whole().collect()
    assert found == {(r.g, r.f): (r.c, sum(x.c == 1 for x in whole if x.g == r.g)) for r in whole if sum(x.c for x in whole if x.g == r.g) > 1}


def test_texts_over_the_chunk_of_anchors(spark):
    """Texts of several chunks, with repeats across their borders."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    same = text(3000)
    rows = [(0, text(130_000) + same + text(140_000)), (1, text(131_072 - 1500) + same + text(5000)), (2, same[500:2500] + text(262_144 - 2000) + same[:900]), (3, text(1000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix.cut_repeats(docs, C.Scratch(spark, "t")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)


def test_suffixes_depend_on_their_text_alone():
    """Whatever stands before a text in its batch, and wherever a border of chunks cuts it."""
    import numpy as np

    rng = np.random.default_rng(2)
    text = rng.integers(97, 123, 5000, np.uint8)

    def found(before, chunk):
        data = np.concatenate([rng.integers(97, 123, before, np.uint8), text])
        return [(anchor - before, a - before, b - before, g) for part in suffix.anchors(data, np.array([0, before, len(data)]), chunk=chunk) for t, anchor, a, b, g in zip(*map(np.ndarray.tolist, part)) if t == 1]

    want = found(0, 1 << 17)
    assert len(want) > 20 and all(x[2] + 1 == y[1] for x, y in zip(want, want[1:]))
    assert all(found(before, chunk) == want for before in (0, 150, 777, 2048) for chunk in (50, 512, 1000))


def test_one_partition_of_several_chunks(spark):
    """Passages hardly over the length, on all borders of chunks: the index is of a batch, the places are of all texts, so the borders differ."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = [text(rng.randrange(205, 260)) for _ in range(900)]
    rows = [(i, "".join(rng.choice(shared) + text(rng.randrange(0, 5)) for _ in range(40))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = suffix.cut_repeats(docs, C.Scratch(spark, "t")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)


def test_batches_do_not_matter(spark):
    rows = passages(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 3):
        got = suffix.cut_repeats(docs, C.Scratch(spark, "t"), batches=n).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)


CLASH = ["id", "row", "spans", "more", "a", "b", "d", "r", "i2", "r2", "n_bytes", "left_bytes", "k1", "g"]


def test_stage_keeps_rows_and_clashing_columns(spark):
    rows = passages(5)[:20]
    rows += [(None, rows[2][1]), (None, None), (7, ""), (7, None), (None, "q" * 150), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, 0 if t is None else len(t), *range(len(CLASH))) for i, t in rows], "doc_id long, text string, n_chars int, " + ", ".join(f"`{c}` int" for c in CLASH))
    got = suffix.without_repeats(docs, C.Scratch(spark, "t"))
    assert got.schema == docs.schema
    want = []
    gone = {(d, sha) for d, *_, sha in brute(rows)}
    for i, t in rows:
        x, data = [r for r in brute(rows) if r[0] == str(i) and r[1] == len((t or "").encode())], (t or "").encode()
        if t is None or not data or x[0][2] < len(data):
            want.append((str(i), x[0][4]))
    got = got.collect()
    assert sorted((str(r.doc_id), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got) == sorted(want) and {x for x in want} <= gone
    assert sum(r.text is None for r in got) == 2 and all(r.n_chars == len(r.text or "") or r.text is None for r in got) and all([r[c] for c in CLASH] == list(range(len(CLASH))) for r in got)

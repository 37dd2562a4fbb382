"""Stages decide by row, not by doc_id: ids may be null or used again, rows may be repeated."""

import random
from collections import Counter

import corpus_pipeline
from aperture.llm import common as C
from aperture.llm import quality
from tests.llm.test_minhash import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def rows_of(texts):
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]


def words(seed, n=120):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def make():
    a, b, c, d = (words(s) for s in range(4))
    near = lambda w: " ".join(w[:60] + ["other"] + w[61:])
    a, b, c, d, na, nb, nd = " ".join(a), " ".join(b), " ".join(c), " ".join(d), near(a), near(b), near(d)
    return rows_of([(None, a), (None, b), (None, nb), (7, c), (7, d), (3, c), (9, nd), (9, nd), (None, na), (5, a), (None, None), (8, ""), (6, "\n")])


def by_rows(rows):
    """The rows kept of each class, rows being documents of their own."""
    cls = brute([(i, r[1]) for i, r in enumerate(rows)])
    return {k: {i for i in cls if cls[i] == k} for k in set(cls.values())}


def test_near_dedup_by_row(spark):
    rows = make()
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    classes = by_rows(rows)
    want = Counter(min(((rows[i][0] is None, rows[i][0] or 0, str(rows[i][1])), rows[i]) for i in c)[1] if len(c) == 1 else sorted((rows[i] for i in c), key=lambda r: (r[0] is None, r[0] or 0))[0] for c in classes.values())
    open_ = [c for c in classes.values() if len(c) > 1 and all(rows[i][0] is None for i in c)]  # any row of these
    assert len(open_) == 1
    free = {rows[i] for i in open_[0]}
    got = Counter(map(tuple, got))
    assert sum(got[r] for r in free) == 1 and sum(want[r] for r in free) == 1
    assert {r: n for r, n in got.items() if r not in free} == {r: n for r, n in want.items() if r not in free}


def test_quality_by_row(spark):
    good = [" ".join(words(s)) for s in range(10, 16)]
    bad = ["a b c " * 60, "short text", None, ""]
    rows = rows_of([(None, good[0]), (None, bad[0]), (None, bad[2]), (1, good[1]), (1, bad[1]), (2, bad[3]), (2, good[2]), (3, good[3]), (3, good[3]), (4, bad[0])])
    docs = spark.createDataFrame(rows, SCHEMA)
    verdict = quality.quality(docs.withColumn("doc_id", docs.text), C.Scratch(spark, "t")).collect()
    kept = {r.doc_id for r in verdict if r.kept}
    assert kept == set(good[:4])
    got = Counter(map(tuple, corpus_pipeline.quality_rules(spark, docs, "").collect()))
    assert got == Counter(r for r in rows if r[1] in kept)


def test_rows_that_differ_in_microseconds_or_nulls(spark):
    """Columns keep all they hold in the comparison of whole rows."""
    import datetime

    at = lambda us: datetime.datetime(2024, 1, 1, 0, 0, 0, us)
    rows = [(1, "", at(1), 0.5, None, {"a": 1}), (1, "", at(2), 0.5, None, {"a": 1}), (1, "", at(2), float("nan"), None, {"a": 1}), (1, "", at(2), 0.5, "x", None), (1, "", at(2), 0.5, "x", None), (1, "", at(2), 0.5, None, {"a": 2})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, seen timestamp, score double, note string, tags map<string,int>").repartition(3)
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 5
    assert corpus_pipeline.near_dedup(spark, docs.withColumn("seen", docs.seen.cast("timestamp_ntz")), "").count() == 5

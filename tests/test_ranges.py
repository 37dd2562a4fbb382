"""Sums, ranks and quantiles over sampled ranges: an outlier and a key of most rows do not gather in a task."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from aperture.operators import curves as K
from aperture.operators import metrics as M
from aperture.operators import ranges as R
from aperture.operators import resample as B


@pytest.fixture
def many(spark):
    """So many ranges that the largest can be told from the rest."""
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in keep.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_an_outlier_and_a_key_of_most_rows_are_spread(many):
    many.conf.set("spark.sql.shuffle.partitions", "200")
    score = F.when(F.col("id") == 0, 1e9).otherwise(F.rand(3))
    df = many.range(20001).select(F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("hot").alias("k"), score.alias("score"), (F.col("id") % 3 == 0).cast("int").alias("gt"))
    t = K.rising(df, ["k"])
    parts = [r["count"] for r in t.groupBy(R.PART).count().collect()]
    assert sum(parts) == 20001 and max(parts) < 0.02 * 20001
    hot = [r["count"] for r in t.where("k = 'hot'").groupBy(R.PART).count().collect()]
    assert max(hot) < 0.01 * 20001
    whole = K.rising(df)
    assert max(r["count"] for r in whole.groupBy(R.PART).count().collect()) < 0.01 * 20001
    assert whole.agg(F.max("tps"), F.max("fps")).first() == df.agg(F.sum("gt").cast("double"), F.sum(1 - F.col("gt")).cast("double")).first()


def test_curves_over_borders_of_ranges(many):
    rng = random.Random(1)
    rows = [(g, round(rng.random() ** 3, 2), int(rng.random() < 0.4)) for g in ("a", "b", None) for _ in range(300)]
    df = many.createDataFrame(rows, "k string, score double, gt int")

    def plain(rows):
        p, n = sum(g for _, g in rows), sum(1 - g for _, g in rows)
        u = sum((s > t) + 0.5 * (s == t) for s, g in rows if g for t, h in rows if not h)
        points, tps, fps = [], 0, 0
        for s in sorted({s for s, _ in rows}, reverse=True):
            tps, fps = tps + sum(g for x, g in rows if x == s), fps + sum(1 - g for x, g in rows if x == s)
            points.append((s, tps, fps))
        kept = [x for i, x in enumerate(points) if i in (0, len(points) - 1) or any(points[i + 1][j] - 2 * x[j] + points[i - 1][j] for j in (1, 2))]
        return u / (p * n), points, kept

    want = {g: plain([(s, t) for k, s, t in rows if k == g]) for g in ("a", "b", None)}
    for r in K.auroc(df, ["k"]).collect():
        assert abs(r.auroc - want[r.k][0]) < 1e-12
    for drop, at in ((False, 1), (True, 2)):
        got = {}
        for r in K.roc(df, ["k"], drop).where("threshold < 2").collect():
            got.setdefault(r.k, []).append((r.threshold, int(r.tps), int(r.fps)))
        assert {k: sorted(v, reverse=True) for k, v in got.items()} == {k: w[at] for k, w in want.items()}
    both = plain([(s, t) for _, s, t in rows])
    assert sorted([(r.threshold, int(r.tps), int(r.fps)) for r in K.roc(df, drop_intermediate=True).where("threshold < 2").collect()], reverse=True) == both[2]


def test_exact_quantiles_with_a_hot_key(many):
    rng = random.Random(2)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(3000)] + [("tied", 1.0)] * 500 + [("one", 7.0), ("none", None), (None, 2.0), (None, 4.0)]
    df = many.createDataFrame(rows, "k string, x double")
    shares = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.975, "e": 1.0}
    got = {r.k: r for r in R.quantiles(df, "x", shares, ["k"]).collect()}
    assert set(got) == {"hot", "tied", "one", None}
    for k, r in got.items():
        values = [x for g, x in rows if g == k]
        for name, q in shares.items():
            assert abs(r[name] - np.percentile(values, 100 * q)) < 1e-12
    whole = R.quantiles(df, "x", {"m": 0.5}).first()
    assert abs(whole.m - statistics.median(x for _, x in rows if x is not None)) < 1e-12
    assert R.quantiles(df.where("k = 'none'"), "x", shares, ["k"]).count() == 0 and R.quantiles(df.limit(0), "x", shares).count() == 0
    s = M.score_summary(df, "x").first()
    assert abs(s.median - whole.m) < 1e-12 and s.max == 7.0
    assert {r.k: r.p25 for r in M.score_summary(df, "x", "k").collect()}["none"] is None


def test_numbers_in_order(many):
    df = many.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), F.lit("k").alias("k"))
    assert all(r.at == r.x for r in R.numbered(df, ["k"], ["x"], "at").collect())
    draws = B.cluster_draws(df, "x", 2)
    assert draws.agg(F.sum("weight")).first()[0] == 10000
    plan = R.numbered(df, [], ["x"], "at").where("at > 0")._jdf.queryExecution().executedPlan().toString()
    sources = plan.split("SinglePartition")
    assert len(sources) <= 2  # the sums of ranges alone, a row each


def test_wilcoxon(spark):
    rng = random.Random(0)
    pairs = [(rng.gauss(0.3, 1), 0.0) for _ in range(40)]
    df = spark.createDataFrame([("u", *p) for p in pairs] + [("t", 1.0, 0.0), ("t", 2.0, 1.0), ("t", 0.0, 3.0)] + [("z", 1.0, 1.0)] * 3 + [("n", None, 1.0)] + [("big", rng.gauss(0.1, 1), 0.0) for _ in range(60)], "k string, a double, b double")
    got = {r.k: r for r in B.wilcoxon_test(df, "a", "b", "k").collect()}
    u = got["u"]
    assert (u.n, round(u.p_value, 4)) == (40, 0.4845) and abs(u.p_value - B.wilcoxon_p(40, u.w)) < 1e-12
    d = sorted((abs(a - b), a - b) for a, b in pairs)
    assert u.w == min(sum(i for i, (_, x) in enumerate(d, 1) if x > 0), sum(i for i, (_, x) in enumerate(d, 1) if x < 0))
    assert (got["t"].n, got["t"].w, got["t"].p_value) == (3, 3.0, 1.0)
    assert (got["z"].n, got["z"].w, got["z"].p_value) == (0, None, None) and "n" not in got
    big = got["big"]
    var = 60 * 61 * 121 / 24
    import math

    assert abs(big.p_value - math.erfc(abs(big.w - 60 * 61 / 4) / math.sqrt(2 * var))) < 1e-12
    one = B.wilcoxon_test(df.where("k = 'u'"), "a", "b").first()
    assert one.p_value == u.p_value
    six = [(k, float(2**k), 0.0) for k in range(1, 7)]
    assert B.wilcoxon_test(spark.createDataFrame(six, "k int, a double, b double"), "a", "b").first().p_value == 2 / 64

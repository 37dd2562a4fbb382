import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from aperture.operators import callables as C
from aperture.operators import resample as B


def letters(folder=None):
    """A factory of an encoder that counts letters by their code modulo 8; it leaves a file for each time it is built."""

    def build():
        if folder:
            import uuid

            with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w"):
                pass
        return lambda texts: np.array([[sum(ord(c) % 8 == k for c in t) for k in range(8)] for t in texts], float)

    return build


def test_encoder_is_built_once_in_a_worker(spark, tmp_path):
    texts = spark.range(4000, numPartitions=16).select("id", F.concat(F.lit("t"), (F.col("id") % 900).cast("string")).alias("text"))
    encoder = C.Encoder(letters(str(tmp_path)), batch=7)
    for _ in range(3):
        assert encoder.encode(texts, "text").where("vec is not null").count() == 4000
        encoder.encode(texts, "text").agg(F.sum(F.element_at("vec", 1))).collect()
    pids = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert 0 < len(pids) == len(set(pids)) <= 8  # a file a process, over many tasks, batches and queries


def test_each_text_is_encoded_once(spark, tmp_path):
    def build():
        def encode(texts):
            with open(f"{tmp_path}/{os.getpid()}", "a") as f:
                f.writelines(t + "\n" for t in texts)
            return np.ones((len(texts), 2))

        return encode

    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("",)], "text string").repartition(3)
    got = C.Encoder(build).encode(df, "text").collect()
    assert sorted((str(r.text), r.vec is None) for r in got) == [("", False), ("None", True), ("a", False), ("a", False), ("b", False)]
    assert sorted(x for p in tmp_path.iterdir() for x in p.read_text().split("\n")[:-1]) == ["", "a", "b"]


@pytest.mark.parametrize("bad", [lambda t: np.ones((len(t) + 1, 2)), lambda t: np.ones(len(t)), lambda t: np.full((len(t), 2), np.nan)])
def test_a_wrong_encoder_fails(spark, bad):
    with pytest.raises(Exception, match="the encoder gave"):
        C.Encoder(lambda: bad).encode(spark.createDataFrame([("a",)], "text string"), "text").collect()


def test_zero_shot_with_an_injected_encoder(spark):
    encode = letters()()
    prompts = [(0, "aaa bb"), (0, "ab"), (1, "ccc"), (2, "ddd e")]
    items = [(k, encode([t])[0]) for k, t in enumerate(["aab", "ccd", "ede"])]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in items], "item_id long, embedding array<double>")
    texts = spark.createDataFrame(prompts, "class_id int, text string")
    got = {(r.item_id, r.class_id): r for r in C.zero_shot(df, texts, C.Encoder(letters()), temperature=0.5).collect()}
    mat = []
    for c in range(3):
        m = encode([t for k, t in prompts if k == c]).mean(0)
        mat.append(m / (np.linalg.norm(m) + 1e-8))
    for k, v in items:
        z = np.array([v @ m for m in mat])
        p = np.exp(0.5 * z - (0.5 * z).max())
        for c in range(3):
            assert abs(got[k, c].logit - z[c]) < 1e-9 and abs(got[k, c].prob - p[c] / p.sum()) < 1e-9
    one = C.zero_shot(df, texts.where("class_id = 1"), C.Encoder(letters())).collect()
    assert len(one) == 3 and all(abs(r.prob - 1 / (1 + np.exp(-r.logit / 0.07))) < 1e-9 for r in one)


def rows(spark):
    rng = np.random.default_rng(1)
    data = [(k, f"c{k % 9}", "x" if k % 3 else "y", float(rng.normal()), int(rng.integers(0, 2))) for k in range(120)]
    return spark.createDataFrame(data, "id long, patient string, grp string, score double, gt int"), data


def expected(spark, df, data, key):
    """Weighted means and medians of each replicate, from the same draws."""
    out = {}
    for r in B.cluster_draws(df, "patient", 12).collect():
        out.setdefault(r.rep, {})[r.cluster] = r.weight
    means, medians = {}, {}
    for rep, w in out.items():
        for g in {key(d) for d in data}:
            x = [(d[3], w.get(d[1], 0)) for d in data if key(d) == g]
            n = sum(k for _, k in x)
            means[g, rep] = sum(v * k for v, k in x) / n if n else None
            medians[g, rep] = float(np.median(np.repeat([v for v, _ in x], [k for _, k in x]))) if n else None
    return means, medians


@pytest.mark.parametrize("keys", [[], ["grp"]])
def test_custom_statistics_through_the_bootstrap(spark, keys):
    df, data = rows(spark)
    means, medians = expected(spark, df, data, (lambda d: d[2]) if keys else (lambda d: None))
    parts = lambda c: np.stack([c["score"], np.ones(len(c["score"]))], 1)
    final = lambda s: {"mean": s[0] / s[1] if s[1] else None}
    got = C.bootstrap_sums(df, "patient", 12, parts, final, ["mean"], keys, ["score"]).collect()
    assert len(got) == len(means)
    for r in got:
        assert abs(r["mean"] - means[r.grp if keys else None, r.rep]) < 1e-9
    median = lambda c, w: {"median": np.median(np.repeat(c["score"], w))}
    got = C.bootstrap_any(df, "patient", 12, median, ["median"], 200, keys, ["score"]).collect()
    assert len(got) == len(medians)
    for r in got:
        assert abs(r["median"] - medians[r.grp if keys else None, r.rep]) < 1e-12
    with pytest.raises(Exception, match="may gather"):
        C.bootstrap_any(df, "patient", 2, median, ["median"], 30, keys, ["score"]).collect()

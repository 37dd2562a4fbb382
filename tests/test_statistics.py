import math

import pytest
from pyspark.sql import functions as F

from aperture.operators import bundles as U
from aperture.operators import curves as K
from aperture.operators import prompts as W
from aperture.operators import resample as B
from aperture.operators import retrieval as R
from aperture.operators import tables as J

FOUR = [("crc", 0, 0, 0.1), ("crc", 0, 1, 0.8), ("crc", 1, 1, 0.9), ("crc", 1, 0, 0.4)]


def scores(spark, rows=FOUR):
    return spark.createDataFrame(rows, "grp string, gt int, pred int, score double")


def test_paired_p_leaves_out_undefined_replicates(spark):
    t = spark.createDataFrame([(-0.1,)] * 50 + [(float("nan"),)] * 50 + [(None,)] * 3 + [(float("inf"),)], "d double")
    r = B.paired_p(t, "d").first()
    assert r.n_valid == 50 and r.p_value == pytest.approx(2 / 51) and r.lo == r.hi == -0.1
    none = B.paired_p(t.where("isnan(d)"), "d").first()
    assert none.n_valid == 0 and none.p_value is None


def test_intervals_with_a_gate(spark):
    t = spark.createDataFrame([(float(i), None if i % 2 else 1.0) for i in range(101)], "a double, b double")
    r = B.intervals(t, ["a"]).first()
    assert (r.a_lo, r.a_hi, r.n_valid) == (2.5, 97.5, 101)
    assert B.intervals(t, ["a"], require="b").first().n_valid == 51
    assert B.intervals(t.where("b is null"), ["a", "b"], require="b").first().a_lo is None


def test_bundle_of_four_slides(spark):
    r = U.probability_metrics(scores(spark), ["grp"], "pred").first()
    assert (r.tp, r.tn, r.fp, r.fn, r.accuracy, r.auroc) == (1, 1, 1, 1, 0.5, 0.75)
    assert r.mean_prob_pos == pytest.approx(0.65) and r.mean_prob_neg == pytest.approx(0.45)
    assert (r.youden_thresh, r.youden_sens, r.youden_spec) == (0.9, 0.5, 1.0)
    one = U.probability_metrics(scores(spark, [x for x in FOUR if x[1]]), ["grp"]).first()
    assert one.auroc is None and one.aupr is None and one.youden_thresh is None and one.sens90_sens is None and one.n_pos == 2
    t = U.grouped_tables(scores(spark, [*FOUR, ("breast", 0, 0, 0.2), ("breast", 1, 1, 0.7)]), "grp", {"max": "score"})
    assert sorted(r.grp for r in t.collect()) == ["__overall__", "breast", "crc"]


def test_binary_bundle(spark):
    t = spark.createDataFrame([(0, 0.1), (0, 0.3), (1, 0.4), (1, 0.8)], "gt int, score double")
    r = U.binary_thresholds(t, 2).first()
    assert (r.binary_0p5_precision, r.binary_0p5_sensitivity, r.binary_auroc, r.binary_youden_threshold, r.binary_youden_j) == (1.0, 0.5, 1.0, 0.4, 1.0)
    assert r.binary_0p5_f1 == pytest.approx(2 / 3) and r.binary_youden_fp == 0
    three = U.binary_thresholds(t, 3).first()
    assert three.binary_auroc is None and three.binary_youden_threshold is None
    assert U.binary_thresholds(t.withColumn("gt", F.col("gt") + 1), 2).first().binary_auroc is None


def test_macro_auroc_is_undefined_with_a_missing_class(spark):
    rows = [(i % 2, c, 0.1 * ((i * 7 + c * 3) % 10)) for i in range(20) for c in range(3)]
    t = spark.createDataFrame(rows, "label int, class_id int, prob double")
    r = K.macro_ovr_auroc(t, 3).first()
    assert r.macro_auroc is None and r.classes == 2
    assert K.macro_ovr_auroc(t.where("class_id < 2"), 2).first().macro_auroc == K.auroc(t.where("class_id = 1").select(F.col("label").alias("gt"), F.col("prob").alias("score"))).first().auroc


def test_curves_over_all_rows_do_not_depend_on_ranges(spark):
    t = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("gt"), F.when(F.col("id") == 7, float("inf")).otherwise((F.col("id") * 7919 % 4999) / 13.0 - 100).alias("score"))
    flat, by = K.roc(t, [], True), K.roc(t.withColumn("k", F.lit(1)), ["k"], True).drop("k")
    assert sorted(flat.collect()) == sorted(by.collect())
    assert K.auroc(t).first().auroc == pytest.approx(K.auroc(t.withColumn("k", F.lit(1)), ["k"]).first().auroc)
    pr = K.precision_recall(spark.createDataFrame([(0, 0.1), (1, 0.2)], "gt int, score double")).collect()
    assert sorted((r.recall, r.precision) for r in pr) == [(0.0, 1.0), (1.0, 0.5), (1.0, 1.0)]


def test_strata(spark):
    rows = [(f"p{o}{p}{i}", o, p) for o in "ab" for p in ("mixed", "negative_only", "positive_only") for i in range(10)]
    t = spark.createDataFrame(rows, "patient_id string, grp string, pattern string")
    n = {(r.grp, r.pattern, r.split): r["count"] for r in B.stratified(t, "patient_id", ["grp", "pattern"], 0.2).groupBy("grp", "pattern", "split").count().collect()}
    assert set(v for k, v in n.items() if k[2] == "calibration") == {2} and len(n) == 12
    uneven = spark.createDataFrame([(i, "x" if i < 13 else "y") for i in range(25)], "id int, s string")
    k = {r.s: r["count"] for r in B.stratified(uneven, "id", ["s"], 0.2).where("split = 'calibration'").groupBy("s").count().collect()}
    assert k == {"x": 3, "y": 2}
    with pytest.raises(Exception, match="too small"):
        B.stratified(spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "id int, s string"), "id", ["s"], 0.5).collect()
    with pytest.raises(Exception, match="too small"):
        J.strata(spark.createDataFrame([("a", "b")], "grp string, pattern string"), "grp", "pattern").collect()


def test_flat_split_with_ties(spark):
    t = spark.createDataFrame([(i // 4,) for i in range(400)], "id int")
    got = {r.split: r["count"] for r in B.flat_split(t, "id", 0.1).groupBy("split").count().collect()}
    assert got == {"val": 40, "train": 360}
    assert B.flat_split(t, "id", 0.0).where("split = 'val'").isEmpty() and B.flat_split(t, "id", 1.0).where("split = 'train'").isEmpty()
    assert B.flat_split(t.limit(0), "id", 0.5).count() == 0


def test_last_patient_counts(spark):
    slides = spark.createDataFrame([("g 1", "s"), ("g", "t")], "group string, slide string")
    known = spark.createDataFrame([("g 1", "s", "P9", 1), ("g_1", "s", "P1", 2)], "group string, slide string, patient_id string, n int")
    got = {r.slide: r.patient_id for r in J.join_patients(slides, known, "ext", "n").collect()}
    assert got == {"s": "P1", "t": "ext::g::SLIDE::t"}


def test_wilcoxon(spark):
    t = spark.createDataFrame([(float(i), 0.0) for i in (1, 2, 3, 4, -5, 6)], "a double, b double")
    r = B.wilcoxon_test(t, "a", "b").first()
    assert (r.n, r.w) == (6, 5.0) and r.p_value == B.wilcoxon_p(6, 5.0)
    many = spark.range(60).select((F.col("id") % 7 - 2).cast("double").alias("a"), F.lit(0.0).alias("b"))
    r = B.wilcoxon_test(many, "a", "b").first()
    assert 0 < r.p_value < 0.01 and math.isfinite(r.w)
    assert B.wilcoxon_test(t.withColumn("b", F.col("a")), "a", "b").first().p_value is None


def test_retrieval_holds_few_similarities(tmp_path):
    """What a task holds at once does not grow with the candidates, nor with the rows of a batch."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    v = rng.normal(size=(20_000, 8))
    vec, ids = pa.array(list(v)), pa.array(np.arange(len(v)))
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, pa.array(np.arange(len(v)) % 7), vec], ["query_id", "cand_id", "pos", "grp", "vec"])
    files = [b.column(0).to_pylist() for b in R._store(f"file://{tmp_path}")(iter([batch.slice(0, 3000), batch.slice(3000)]))]
    paths = [p for f in files for p in f]
    sizes = [len(b["id"]) for b in R._blocks(paths)]
    assert sum(sizes) == len(v) and max(sizes) <= R.BLOCK
    assert sorted(i for b in R._blocks(paths) for i in b["id"].tolist()) == list(range(len(v)))
    got = []
    for run in (R._best(paths, 10), R._ranks(paths, True)):
        tracemalloc.start()
        got.append(pa.Table.from_batches(run(iter([batch.slice(0, 700), batch.slice(700, 400)]))))
        assert tracemalloc.get_traced_memory()[1] < 150 << 20
        tracemalloc.stop()
    sim = v[:1100] @ v.T
    assert got[0]["cand_id"].to_pylist() == np.argsort(-sim, 1)[:, :10].ravel().tolist()
    assert got[1]["rank"].to_pylist() == (1 + (sim > (sim[np.arange(1100), np.arange(1100)] + R.EPS)[:, None]).sum(1)).tolist()


def test_retrieval(spark):
    eye = [[1.0 if i == j else 0.0 for j in range(4)] for i in range(4)]
    rows = [(i, eye[i], eye[i], g, m, str(i)) for i, (g, m) in enumerate(zip("ggxy", "aabb"))]
    pairs = spark.createDataFrame(rows, "pair_index long, image_emb array<double>, text_emb array<double>, group_id string, image_id string, caption_id string")
    found = R.both_directions(pairs)
    pools = found["pools"].first()
    assert (pools.n_images, pools.n_texts, pools.deduplicated) == (2, 4, True)
    assert [r.t2i_rank for r in found["pairs"].collect()] == [1] * 4
    lone = R.ranks(pairs.select(F.col("pair_index").alias("query_id"), F.col("image_emb").alias("vec"), F.lit(99).alias("pos")), pairs.select(F.col("pair_index").alias("cand_id"), F.col("text_emb").alias("vec")))
    assert all(r["rank"] is None for r in lone.collect())
    non = R.nonmatches(pairs, 50, F.col("s") * 7, F.col("s") * 3)
    assert {r.sim for r in non.collect()} == {0.0} and non.where("i = j").isEmpty()
    slides = R.pool_pairs(pairs.withColumn("slide", F.when(F.col("pair_index") < 2, "a").otherwise("b")), "slide").orderBy("pair_index").collect()
    assert [r.n_patches for r in slides] == [2, 2] and all(abs(sum(x * x for x in r.image_emb) - 1) < 1e-12 for r in slides)
    assert R.sampled_queries(pairs, 3).count() == 3


def test_prompts(spark):
    assert W.prompt_pairs(W.vocabulary(spark), W.short_templates(spark)).count() == 18
    with pytest.raises(KeyError):
        W.vocabulary(spark, "none")
    names = spark.createDataFrame([("d", "canonical", 0, "a", 0), ("d", "short", 0, "a", 1), ("d", "canonical", 1, "b", 0), ("d", "short", 1, "c", 1)], "dataset string, variant string, class_id int, name string, v_ord long")
    n = {r.class_id: r["count"] for r in W.rich_bank(names).groupBy("class_id").count().collect()}
    assert n == {0: 22, 1: 44} and W.canonical_bank(names).count() == 12 and W.rich_canonical_bank(names).count() == 44
    pairs = W.prompt_pairs(W.vocabulary(spark, {"v": ("n", "p")}), W.short_templates(spark).limit(1))
    with pytest.raises(Exception, match="no vector"):
        W.text_matrix(pairs, spark.createDataFrame([("n", [1.0])], "prompt string, vec array<double>")).collect()


def test_checked_lookups(spark):
    t = spark.createDataFrame([("p", "m")], "patient_id string, model string")
    with pytest.raises(Exception, match="no split"):
        J.with_split(t, spark.createDataFrame([("q", "val")], "patient_id string, split string")).collect()
    with pytest.raises(Exception, match="two thresholds"):
        J.with_threshold(t, spark.createDataFrame([("m", 0.1), ("m", 0.2)], "model string, threshold double")).collect()
    assert J.only_groups(t, None, "model").count() == 1 and J.only_groups(t, ["x"], "model").count() == 0

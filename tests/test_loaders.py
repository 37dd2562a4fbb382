import json

import pytest
from pyspark.sql import functions as F

from aperture.sources import loaders as L


def touch(root, *names):
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_bytes(b"x")


def names(df):
    return sorted((r.id.rsplit("/", 1)[1], r.label) for r in df.collect())


def test_rows_without_paths_are_numbered(spark, tmp_path):
    rows = [((None if i % 3 else f"p{i}", b"x"), i % 2) for i in range(50)]
    spark.createDataFrame(rows, "image struct<path:string,bytes:binary>, label int").coalesce(1).write.parquet(f"{tmp_path}/d.parquet")
    got = [r.id for r in L.image_rows(spark.read.parquet(f"{tmp_path}/d.parquet")).orderBy(F.length("id"), "id").collect()]
    assert set(got) == {f"row{i}" if i % 3 else f"p{i}" for i in range(50)}
    many = L.numbered(spark.range(1000).repartition(7).sortWithinPartitions("id"))
    assert sorted(r.row for r in many.collect()) == list(range(1000))


def test_registry(spark, tmp_path):
    touch(tmp_path, "db/BC_IDC_Grade_1/40x/a.jpg", "db/BC_IDC_Grade_2/40x/b.PNG", "db/BC_IDC_Grade_3/40x/c.jpeg", "db/BC_IDC_Grade_1/10x/d.jpg", "db/BC_IDC_Grade_1/40x/e.txt")
    touch(tmp_path, "bach/In Situ/x1.tif", "bach/other/iv_2.tif", "bach/other/is3.tif", "bach/other/zzz.tif", "crc/val/ADI-1.tif", "crc/val/TUM-2.tif", "crc/train/NORM-3.tif", "crc/val/QQQ-4.tif")
    registry = {
        "db": {"loader": "graded_folders", "split": "40x", "class_names": ["g1", "g2", "g3"]},
        "bach": {"loader": "parent_or_prefix", "class_names": list("nbis"), "options": {"parents": {"in_situ": 2}, "prefixes": [("is", 2), ("iv", 3), ("b", 1), ("n", 0)]}},
        "crc": {"loader": "prefix_codes", "split": "val", "class_names": list("123456789")},
        "crc_all": {"loader": "prefix_codes", "split": "all", "dir": "crc", "class_names": list("12345678")},
        "odd": {"loader": "none", "class_names": ["a"]},
    }
    load = lambda k: L.load(spark, registry, k, str(tmp_path))
    assert names(load("db")) == [("a.jpg", 0), ("b.PNG", 1), ("c.jpeg", 2)]
    assert names(load("bach")) == [("is3.tif", 2), ("iv_2.tif", 3), ("x1.tif", 2)]
    assert names(load("crc")) == [("ADI-1.tif", 0), ("TUM-2.tif", 8)]
    with pytest.raises(Exception, match="out of range"):
        load("crc_all").collect()
    for k in ("odd", "none"):
        with pytest.raises(KeyError):
            load(k)
    with pytest.raises(FileNotFoundError):
        L.graded_files(spark, f"{tmp_path}/db", "20x")
    dims = {r.key: r for r in L.dataset_dimension(spark, registry).collect()}
    assert dims["db"].num_classes == 3 and dims["crc_all"].dir == "crc" and dims["bach"].dir == "bach"
    models = L.model_dimension(spark, {"m": {"family": "f", "extra": {"b": 1, "a": 2}}}).first()
    assert (models.key, models.family, models.dir, json.loads(models.extra)) == ("m", "f", "m", {"a": 2, "b": 1})


def test_score_files(spark, tmp_path):
    for n in ("external__a", "external__b", "internal__a", "internal__c", "noname"):
        (tmp_path / f"{n}.csv").write_text("slide,gt,max_prob\ns1,1.0,0.5\n")
    t = L.score_tables(spark, str(tmp_path))
    assert sorted((r.table, r.model) for r in t.collect()) == [("external", "a"), ("external", "b"), ("internal", "a"), ("internal", "c")]
    assert [r.model for r in L.models_of_all(t, ["internal", "external"]).collect()] == ["a"]
    assert sorted((r.table, r.model, r.gt, r.max_prob) for r in L.read_scores(spark, t).collect())[0] == ("external", "a", 1, 0.5)
    assert [L.table_key(F.lit(x)) is not None for x in ("a/internal_x.csv",)] == [True]
    keys = spark.createDataFrame([("/d/My Internal.csv",), ("external2.csv",), ("/d/other one.csv",)], "p string").select(L.table_key(F.col("p")).alias("k")).collect()
    assert [r.k for r in keys] == ["internal", "external", "other_one"]


def test_configs_and_manifests(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": 1, "b": 2}')
    assert L.config(spark, f"{tmp_path}/c.json", b=3, a=None) == {"a": 1, "b": 3}
    assert L.sidecar(spark, f"{tmp_path}/c.json") == {"a": 1, "b": 2} and L.sidecar(spark, f"{tmp_path}/none.json") == {}
    v = spark.createDataFrame([(i, [0.0]) for i in range(4)], "pair_index long, vec array<double>")
    (tmp_path / "m.csv").write_text("pair_index,group_id\n0,a\n1,b\n2,c\n")
    got = L.inputs_with_manifest(spark, v, [f"{tmp_path}/none.csv", f"{tmp_path}/m.csv"], 3).orderBy("pair_index").collect()
    assert [r.group_id for r in got] == ["a", "b", "c"]
    assert L.inputs_with_manifest(spark, v, [f"{tmp_path}/none.csv"]).count() == 4
    with pytest.raises(Exception, match="not in the manifest"):
        L.inputs_with_manifest(spark, v, [f"{tmp_path}/m.csv"]).collect()


def test_caches(spark, tmp_path):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [3.0, None]), (6, [3.0, 4.0])]
    t = spark.createDataFrame(rows, "k int, embedding array<double>")
    assert sorted(r.k for r in L.valid_cache(t).collect()) == [0, 6] and [r.k for r in L.valid_cache(t, dim=1).collect()] == [3]
    t.where("k = 0").write.parquet(f"{tmp_path}/a")
    (tmp_path / "a" / "part-bad.parquet").write_bytes(b"not parquet")
    assert L.readable(spark, [f"{tmp_path}/a", f"{tmp_path}/none"]).count() == 1 and L.readable(spark, [f"{tmp_path}/none"]) is None


def test_lookups_and_files(spark):
    t = spark.createDataFrame([("a", "x", "c"), (None, "y", "c"), ("b", "z", " "), ("c", "w", "d")], "k string, path string, caption string")
    assert [r.k for r in L.lookup_rows(t, ["k"], "caption").collect()] == ["a", "c"]
    assert L.lookup_rows(t, ["k"], "caption", 1).count() == 1
    with pytest.raises(ValueError, match="missing"):
        L.lookup_rows(t, ["nope"], "caption")
    with pytest.raises(ValueError, match="not expected"):
        L.lookup_rows(t, ["k"], "caption", strict=True)
    listing = spark.createDataFrame([("x",), ("x",), ("w",)], "path string")
    assert sorted(r.k for r in L.existing_only(t, "path", listing).collect()) == ["a", "c"]
    with pytest.raises(Exception, match="missing"):
        L.existing_only(t, "path", listing, skip=False).collect()
    parts = [L.shards(t, "path", 3, i).count() for i in range(3)]
    assert sum(parts) == 4


def test_csv_files_are_met_by_name(spark, tmp_path):
    """Files whose columns differ in order and number: each by its own header."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "t__one.csv").write_text("slide,gt,pred,max_prob,avg_prob\ns1,1,0.0,0.9,0.5\ns2,0,,x,0.1\n")
    (tmp_path / "a" / "t__two.csv").write_text("gt,slide,avg_prob,max_prob\n0,s3,0.25,0.75\n1.0,s4,,0.5\n")
    (tmp_path / "a" / "u__two.csv").write_text("gt,slide,avg_prob,max_prob\n1,s5,0.5,0.5\n")
    (tmp_path / "a" / "v__empty.csv").write_text("")
    paths = sorted(str(p) for p in (tmp_path / "a").iterdir())
    got = sorted(tuple(r) for r in L.prediction_records(spark, paths).select("slide", "gt", "pred", "max_prob", "avg_prob").collect())
    assert got == [("s1", 1, 0, 0.9, 0.5), ("s2", 0, None, None, 0.1), ("s3", 0, None, 0.75, 0.25), ("s4", 1, None, 0.5, None), ("s5", 1, None, 0.5, 0.5)]
    scores = L.read_scores(spark, L.score_tables(spark, f"{tmp_path}/a"))
    assert sorted((r.table, r.model, r.slide) for r in scores.collect()) == [("t", "one", "s1"), ("t", "one", "s2"), ("t", "two", "s3"), ("t", "two", "s4"), ("u", "two", "s5")]
    assert L.by_header(spark, [f"{tmp_path}/a/v__empty.csv"]).count() == 0


def test_csv_partition(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,split,class\n1,train,tumor\n2,test,normal\n3,test,other\n")
    one = lambda split: sorted((r.id, r.label) for r in L.csv_partition(spark, f"{tmp_path}/m.csv", split, {"normal": 0, "tumor": 1}, "split", "class").collect())
    assert one("test") == [("2", 0), ("3", None)] and len(one("all")) == 3


def test_files_by_parent_or_prefix_and_code(spark, tmp_path):
    for name in ("set/Invasive Tumor/x.png", "set/other/n12.tif", "set/other/zz.png", "set/other/b1.txt", "codes/train/ADI-1.tif", "codes/train/TUM-2.tif", "codes/test/LYM-9.tif", "codes/test/XXX-1.tif"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    got = L.files_by_parent_or_prefix(spark, [f"{tmp_path}/missing", f"{tmp_path}/set"], {"invasive_tumor": 3}, [("n", 0), ("b", 1)])
    assert sorted((r.id.rsplit("/", 1)[1], r.label) for r in got.collect()) == [("n12.tif", 0), ("x.png", 3)]
    codes = lambda split: sorted((r.id.rsplit("/", 1)[1], r.label) for r in L.prefix_code_files(spark, f"{tmp_path}/codes", split).collect())
    assert codes("train") == [("ADI-1.tif", 0), ("TUM-2.tif", 8)] and codes("all") == [("ADI-1.tif", 0), ("LYM-9.tif", 3), ("TUM-2.tif", 8)]


def test_small_operators(spark, tmp_path):
    """Merged shards, offsets, required columns, strata that are too small."""
    from aperture.functions import scalars as S
    from aperture.operators import resample as B
    from aperture.operators import tables as J
    from aperture.sources import sinks as W

    df = spark.createDataFrame([("1", "a"), (" ", "a"), (None, "b"), ("x", "a")], "o string, g string")
    assert [r[0] for r in df.select(S.offset_or_zero(F.col("o"))).collect()] == [1, 0, 0, 0]
    for k in range(2):
        df.where(F.col("g") == "ab"[k]).coalesce(1).write.mode("append").option("header", True).csv(f"{tmp_path}/shards")
    assert W.merge_shards(spark, f"{tmp_path}/shards").count() == 4
    assert J.require(df, "o", "g") is df
    with pytest.raises(ValueError, match="missing: z"):
        J.require(df, "o", "z")
    p = spark.createDataFrame([(k, "a" if k else "b") for k in range(4)], "k long, s string")
    for small in (lambda: J.strata(p, "s", least=2).collect(), lambda: B.stratified(p, "k", ["s"], 0.5, least=2).collect()):
        with pytest.raises(Exception, match="too small"):
            small()
    pairs = J.same_group_counts(p.select(F.col("k").alias("query_id"), F.col("s").alias("grp")), p.where("s = 'a'").select(F.col("k").alias("cand_id"), F.col("s").alias("grp")))
    assert sorted(map(tuple, pairs.collect())) == [(0, 0), (1, 3), (2, 3), (3, 3)]
    with pytest.raises(Exception, match="too many"):
        J.same_group(p.select(F.col("k").alias("query_id"), F.col("s").alias("grp")), p.select(F.col("k").alias("cand_id"), F.col("s").alias("grp")), most=2).collect()


def test_binary_bundle_without_keys(spark):
    """Undefined is null, not zero: other labels, another number of classes, one class, no rows."""
    from aperture.operators import bundles as U

    t = spark.createDataFrame([(0, 0.2), (1, 0.7), (1, 0.4), (0, 0.6)], "gt int, score double")
    fine = U.binary_thresholds(t, 2).first()
    assert fine.binary_0p5_tp == 1 and fine.binary_0p5_f1 == 0.5 and fine.binary_auroc == 0.75
    for r in (U.binary_thresholds(t, 3).collect(), U.binary_thresholds(t.withColumn("gt", F.col("gt") + 1), 2).collect(), U.binary_thresholds(t.limit(0), 2).collect()):
        assert len(r) == 1 and r[0].binary_0p5_threshold == 0.5 and all(v is None for k, v in r[0].asDict().items() if k != "binary_0p5_threshold")
    one = U.binary_thresholds(t.where("gt = 1"), 2).first()
    assert one.binary_0p5_tp == 1 and one.binary_0p5_fn == 1 and one.binary_0p5_f1 == 2 / 3 and one.binary_auroc is None and one.binary_youden_tp is None

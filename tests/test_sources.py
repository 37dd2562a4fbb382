import json

import pytest
from pyspark.sql import functions as F

from aperture.functions import scalars as S
from aperture.operators import resample as B
from aperture.operators import tables as J
from aperture.sources import loaders as L
from aperture.sources import sinks as W


def test_slide_dialects(spark):
    a = spark.createDataFrame([("o", "/d", "x.svs", "1", "b12.345_B"), (None, "/d", "y.svs", "0", None), ("o", "/d", "z.svs", "itc", "")], "organ string, folder string, file_name string, label string, Bnumber string")
    assert sorted(map(tuple, L.slide_table(a).collect())) == [("/d/x.svs", 1, "o", "x", "B12.345"), ("/d/y.svs", 0, "unknown", "y", "unknown::SLIDE::y")]
    b = spark.createDataFrame([("Src", "c1", "x.a.svs", "/p/x", "macro"), ("Src", " ", "y.svs", "/p/y", "neg"), ("Src", "c", "z", "/p/z", "ask")], "dataset string, case string, file_name string, file_path string, label string")
    assert sorted(r.patient_id for r in L.slide_table(b).collect()) == ["src::C1", "src::SLIDE::y"]
    c = spark.createDataFrame([(None, " Lymphknoten ", 1.0, "/f", "s.svs"), ("Abgelehnt", "Lymphknoten", 1.0, "/f", "t.svs"), ("", "x", 1.0, "/f", "u.svs")], "consent string, Topographie string, class double, Folder string, Filename string")
    assert [r.patient_id for r in L.slide_table(c).collect()] == ["crc::SLIDE::s"]


def test_captions_in_three_shapes(spark):
    rows = [(json.dumps([{"uuid": "a", "caption": "x"}]),), (json.dumps({"b": "y"}),), (json.dumps({"c": {"title": "z"}, "d": {"id": "e", "text": " "}}),)]
    got = L.captions(spark.createDataFrame(rows, "json string")).collect()
    assert sorted((r.uuid, str(r.caption)) for r in got) == [("a", "x"), ("b", "y"), ("c", "z"), ("e", "None")]


def test_polygons(spark):
    ring = [[0, 0], [1, 0], [1, 1]]
    doc = {"features": [{"geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"classification": {"name": "Tumor x"}}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring[:2]]]}, "properties": {}}, {"geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"classification": {"name": "other"}}}]}
    got = L.polygons(spark.createDataFrame([(json.dumps(doc),)], "j string"), "j", "tumor", 10, 20).collect()
    assert len(got) == 2 and got[0].points[0] == [10, 20]


def test_files(spark, tmp_path):
    for c in ("a", "b"):
        (tmp_path / "i" / c).mkdir(parents=True)
        (tmp_path / "i" / c / "1.PNG").write_bytes(b"x")
        (tmp_path / "i" / c / "n.txt").write_bytes(b"x")
    got = L.files_by_class(spark, f"file://{tmp_path}/i", {"a": 0, "b": 1}).collect()
    assert sorted(r.label for r in got) == [0, 1]
    with pytest.raises(FileNotFoundError):
        L.files_by_class(spark, f"file://{tmp_path}/i", {"c": 0})
    spark.range(4).withColumn("x", F.lit(1)).write.parquet(f"{tmp_path}/p/test.parquet")
    assert L.split_files(spark, f"{tmp_path}/p", "test", ["id"]).columns == ["id"]
    (tmp_path / "r.csv").write_text("gt,max_prob,n_tiles\n1.0,0.75,42\n,nan,\n")
    assert [tuple(r) for r in L.prediction_records(spark, [f"{tmp_path}/r.csv"]).collect()] == [(1, 0.75, 42), (None, None, None)]
    assert L.manifest(spark, f"{tmp_path}/none.csv", 5, 3).count() == 3
    with pytest.raises(ValueError):
        L.at_least(spark.range(1))


def test_labels(spark):
    t = spark.createDataFrame([("/x/In Situ/b1.tif",), ("/x/y/iv2.tif",), ("/x/y/q.tif",)], "p string")
    label = L.label_by_parent_or_prefix(F.col("p"), {"in_situ": 2}, [("is", 2), ("iv", 3), ("b", 1)])
    assert [r[0] for r in t.select(label).collect()] == [2, 3, None]
    with pytest.raises(Exception, match="out of range"):
        L.in_range(spark.createDataFrame([(5,)], "label int"), 5).collect()
    assert L.resolve_keys("a, b", ["a", "b", "c"]) == ["a", "b"]
    with pytest.raises(KeyError):
        L.resolve_keys("z", ["a"])


def test_sinks(spark, tmp_path):
    path = f"{tmp_path}/summary"
    a = spark.createDataFrame([("m", "t", 1), ("n", "t", 2)], "model string, table string, v int")
    W.merge_on_write(a, path)
    got = W.merge_on_write(spark.createDataFrame([("m", "t", 3, "x"), ("m", "t", 4, "y")], "model string, table string, v int, more string"), path)
    assert sorted((r.model, r.v) for r in got.collect()) == [("m", 3), ("m", 4), ("n", 2)]
    work = spark.range(6).withColumnRenamed("id", "k")
    assert W.append_unfinished(work.where("k < 4"), f"{tmp_path}/kv", ["k"]) == 4 and W.append_unfinished(work, f"{tmp_path}/kv", ["k"]) == 2
    assert W.flat_metrics({"a": {"b": 1.5, "c": float("nan")}, "d": None, "e": [1]}) == {"a.b": 1.5, "a.c": None, "d": None}
    (tmp_path / "m.json").write_text(json.dumps({"a": {"b": 2}}))
    assert [tuple(r)[1:] for r in W.metrics_table(spark, [f"{tmp_path}/m.json"]).collect()] == [("a.b", "2")]


def test_statistics(spark):
    p = spark.createDataFrame(list(enumerate([0.01, 0.04, 0.03, 0.2])), "k long, p double")
    assert [round(r.p_holm, 9) for r in B.holm(p, "p", order="k").orderBy("k").collect()] == [0.04, 0.09, 0.09, 0.2]
    assert B.wilcoxon_p(5, 0) == 2 / 32 and B.wilcoxon_p(3, 3) == 1.0
    v = spark.createDataFrame([(float(i),) for i in range(101)] + [(float("nan"),), (float("inf"),)], "x double")
    assert tuple(B.interval(v, "x").first()) == (2.5, 97.5, 101)
    m = spark.createDataFrame([(d, o) for d, o in [("0.25", None), ("1000", "40"), ("", "20"), ("NaN", "63"), (None, "5"), ("50", None)]], "d string, o string")
    assert [r[0] for r in m.select(S.base_mpp(F.col("d"), F.col("o"))).collect()] == [0.25, 0.25, 0.5, 0.5, 2.0, 50.0]
    with pytest.raises(Exception, match="not unique"):
        J.one_to_one(spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1,)], "k int"), ["k"]).collect()


def test_stream_upsert(spark, tmp_path):
    from aperture.sources.versions import read_current
    from aperture.streaming.upserts import upsert_stream

    spark.createDataFrame([("m", 1), ("n", 2)], "model string, v int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("model string, v int").parquet(f"{tmp_path}/in")
    for _ in range(2):
        upsert_stream(stream, f"{tmp_path}/out", ["model"], f"{tmp_path}/c").awaitTermination(60)
    assert read_current(spark, f"{tmp_path}/out").count() == 2

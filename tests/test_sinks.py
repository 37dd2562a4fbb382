import threading

import pytest
from pyspark.sql import functions as F

from aperture.sources import loaders as L
from aperture.sources import sinks as S
from aperture.sources import versions as V


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_cache_of_one_model_leaves_others(spark, tmp_path):
    path = f"{tmp_path}/cache"
    one = lambda m, d, x: spark.createDataFrame([(x, m, d)], "x int, model string, dataset string")
    for m, d, x in (("a", "p", 1), ("b", "p", 2), ("a", "q", 3), ("b", "p", 4)):
        S.write_cache(one(m, d, x), path)
    assert rows(spark.read.parquet(path), "model", "dataset", "x") == [("a", "p", 1), ("a", "q", 3), ("b", "p", 4)]
    assert rows(L.cached_pairs(spark, path, ["a", "b"], ["q", "p", "r"]), "model", "dataset") == [("a", "p"), ("a", "q"), ("b", "p")]


def test_a_failed_writer_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    S.replace_table(spark.createDataFrame([(1,)], "x int"), path)
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("stop"))).otherwise(F.lit(1)).cast("int").alias("x"))
    with pytest.raises(Exception, match="stop"):
        S.replace_table(bad, path)
    assert rows(V.read_current(spark, path), "x") == [(1,)] and len(list((tmp_path / "t" / "_versions").iterdir())) == 1
    S.replace_table(spark.createDataFrame([(2,)], "x int"), path)
    assert rows(V.read_current(spark, path), "x") == [(2,)]


def test_readers_keep_their_version_while_writers_swap(spark, tmp_path):
    """A scan under way ends on the files it began with, whatever is committed meanwhile; without grace they are gone."""
    path = f"{tmp_path}/t"
    S.merge_on_write(spark.range(50, numPartitions=5).selectExpr("'a' AS model", "CAST(id AS INT) AS x"), path)
    pinned = V.read_current(spark, path)
    scan = pinned.select("x").toLocalIterator()  # one partition at a time
    next(scan)
    threads = [threading.Thread(target=lambda k=k: S.merge_on_write(spark.createDataFrame([("a", -k)], "model string, x int"), path)) for k in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(list(scan)) == 49 and pinned.count() == 50 and rows(V.read_current(spark, path), "x") in ([(-1,)], [(-2,)])
    S.merge_on_write(spark.createDataFrame([("a", 9)], "model string, x int"), path, grace=-1.0)
    assert len(list((tmp_path / "t" / "_versions").iterdir())) == 1 and rows(V.read_current(spark, path), "x") == [(9,)]


def test_a_dead_writer_stops_nobody(spark, tmp_path):
    path = tmp_path / "t"
    S.merge_on_write(spark.createDataFrame([("a", 1)], "model string, x int"), str(path))
    dead = path / "_versions" / "000000000002-dead"  # built, never committed
    (dead / "data").mkdir(parents=True)
    (path / "_log" / "000000000002.abc.new").write_text("{")  # an entry half written
    S.merge_on_write(spark.createDataFrame([("b", 2)], "model string, x int"), str(path))
    assert rows(V.read_current(spark, str(path)), "model", "x") == [("a", 1), ("b", 2)] and dead.exists()
    assert V.expire(spark, str(path), -1.0) == 2 and not dead.exists() and rows(V.read_current(spark, str(path)), "model") == [("a",), ("b",)]


def test_only_one_makes_an_entry(spark, tmp_path):
    log, won = V.Log(spark, f"file://{tmp_path}/log"), []
    threads = [threading.Thread(target=lambda k=k: log.add(1, {"k": k}) and won.append(k)) for k in range(16)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and log.read(1) == {"k": won[0]} and log.last() == 1 and log.all() == [{"k": won[0]}]


def test_two_writers_lose_nothing(spark, tmp_path):
    path, failed = f"{tmp_path}/t", []
    (tmp_path / "t").mkdir()
    spark.createDataFrame([("old", 7)], "model string, x int").write.mode("append").parquet(path)  # a plain table from before

    def write(k):
        try:
            S.merge_on_write(spark.createDataFrame([(f"m{k}", k)], "model string, x int"), path)
        except Exception as e:  # shown below
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and rows(V.read_current(spark, path), "model", "x") == [*((f"m{k}", k) for k in range(4)), ("old", 7)]


def test_summary_in_both_forms(spark, tmp_path):
    path = f"{tmp_path}/s"
    S.merge_summary(spark.createDataFrame([("a", "t", 1.5), ("b", "t", 2.0)], "model string, table string, x double"), path)
    S.merge_summary(spark.createDataFrame([("a", "t", 3.0), ("a", "t", 4.0)], "model string, table string, x double"), path)
    assert rows(V.read_current(spark, path, "json", "json"), "model", "x") == [("a", 3.0), ("a", 4.0), ("b", 2.0)]
    assert rows(V.read_current(spark, path, "csv", "csv"), "model", "x") == [("a", "3.0"), ("a", "4.0"), ("b", "2.0")]


def test_unfinished_work_and_failures(spark, tmp_path):
    work = spark.range(6).select(F.col("id").alias("k"), F.when(F.col("id") == 4, "unreadable").alias("why"))
    path, log = f"{tmp_path}/out", f"{tmp_path}/log"
    assert S.append_unfinished(work.where("k < 3"), path, ["k"], F.col("why"), log) == 3
    assert S.append_unfinished(work, path, ["k"], F.col("why"), log) == 2
    assert rows(S.appended(spark, path), "k") == [(0,), (1,), (2,), (3,), (5,)]
    assert rows(spark.read.csv(log, header=True), "k", "reason") == [("4", "unreadable")]
    assert S.append_unfinished(work.withColumn("why", F.lit(None).cast("string")), path, ["k"], F.col("why"), log) == 1


def test_two_builders_append_each_row_once(spark, tmp_path):
    path, counts = f"{tmp_path}/out", []
    threads = [threading.Thread(target=lambda: counts.append(S.append_unfinished(spark.range(40).withColumnRenamed("id", "k"), path, ["k"]))) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(counts) == [0, 0, 40] and rows(S.appended(spark, path), "k") == [(k,) for k in range(40)]


def test_metrics(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "metrics.json").write_text('{"x": 1, "in": {"y": 0.5, "z": null, "name": "n"}, "list": [1]}')
    got = S.metrics_table(spark, [f"{tmp_path}/a/metrics.json"])
    want = [("in.name", "n"), ("in.y", "0.5"), ("in.z", None), ("x", "1")]
    assert sorted((r.metric, r.value) for r in got.collect()) == want
    assert [(r.metric, r.value) for r in S.metric_rows(spark, {"x": 1, "in": {"y": 0.5, "z": float("nan"), "name": "n"}}).collect()] == want
    assert "| x | 1 |" in S.markdown({"x": 1})


def test_pooled_cache_and_reports(spark, tmp_path):
    pooled = spark.createDataFrame([(1, "s1", [0.0, 1.0], [1.0, 0.0]), (0, "s0", [1.0, 0.0], [1.0, 0.0])], "pair_index long, slide string, image_emb array<double>, text_emb array<double>")
    S.write_pooled(pooled, f"{tmp_path}/p")
    assert rows(V.read_current(spark, f"{tmp_path}/p", "embeddings"), "pair_index", "slide") == [(0, "s0"), (1, "s1")]
    assert V.read_current(spark, f"{tmp_path}/p", "manifest", "csv").columns == ["pair_index", "slide"]
    S.write_csv(pooled.select("pair_index", "slide"), f"{tmp_path}/r", "pair_index")
    S.append_manifest(pooled.select("slide"), f"{tmp_path}/m")
    S.append_manifest(pooled.select("slide"), f"{tmp_path}/m")
    assert V.read_current(spark, f"{tmp_path}/r", fmt="csv").count() == 2 and spark.read.csv(f"{tmp_path}/m", header=True).count() == 4

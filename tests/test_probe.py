import random
import time

from pyspark.sql import functions as F

from aperture.operators import probe as P
from aperture.sources import loaders as L
from aperture.streaming import upserts


def make(spark, groups):
    rng = random.Random(0)
    rows = []
    for i in range(120):
        y = i % 3
        good = [rng.gauss(0, 0.2) + (4.0 if k == y else 0.0) for k in range(3)]
        rows.append((i, y, f"g{(i // 3 % 12) * 3 + y}" if groups else f"g{i}", good, [rng.gauss(0, 1) for _ in range(3)]))
    return spark.createDataFrame(rows, "id long, label int, grp string, good array<double>, noise array<double>")


def test_folds(spark):
    t, k, kind = P.folds(make(spark, True), "label", 5, "grp")
    assert (k, kind) == (5, "stratified_group") and t.count() == 120
    assert t.groupBy("grp").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    assert all(r.n == 3 for r in t.groupBy("fold").agg(F.count_distinct("label").alias("n")).collect())
    t, k, kind = P.folds(make(spark, False), "label", 5, "grp")
    assert (k, kind) == (5, "stratified") and all(6 <= r["count"] <= 10 for r in t.groupBy("fold", "label").count().collect())
    few = make(spark, False).where("id < 4")
    assert P.folds(few, "label", 5)[1:] == (0, "none") and P.paired_probe(few, "label", "good", "noise").isEmpty()


def test_probe_tells_good_vectors_from_noise(spark):
    got = P.paired_probe(make(spark, True), "label", "good", "noise", 3, "grp").collect()
    assert sorted(r.fold for r in got) == [0, 1, 2]
    assert all(r.a > 0.9 > 0.7 > r.b and r.delta == r.a - r.b and r.cv == "stratified_group" for r in got)


def test_spreadsheet(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(pd, "read_excel", lambda path: pd.DataFrame({"name": ["a", "b"], "NC": [0, 1], "G3": [0, 0], "G4": [0, 0], "G5": [0, 0], "G4C": [1, 0]}))
    t = L.excel(spark, "any.xlsx").select("name", L.one_hot_label(list(L.GRADE_CLASSES), L.GRADE_CLASSES).alias("label"))
    assert sorted(map(tuple, t.collect())) == [("a", 2), ("b", 0)]


def test_late_events_are_counted_within_the_watermark(spark, tmp_path):
    schema = "ts timestamp, k string"
    folder = f"{tmp_path}/in"
    for i, rows in enumerate(([("2024-01-01 10:05:00", "a"), ("2024-01-01 10:50:00", "a"), ("2024-01-01 10:55:00", "b")], [("2024-01-01 10:10:00", "a"), ("2024-01-01 12:30:00", "a")], [("2024-01-01 14:00:00", "b")], [("2024-01-01 10:20:00", "a"), ("2024-01-01 16:00:00", "b")])):
        spark.createDataFrame(rows, "ts string, k string").coalesce(1).write.json(f"{folder}/{i}")
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).json(folder)
    q = upserts.windowed_counts(stream, "ts", "k").writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.window.start.hour, r.k): r.n for r in spark.table("late").collect()}
    assert got[10, "a"] == 3 and got[10, "b"] == 1  # 10:10 came in time, 10:20 after the watermark had passed


def newton(x, y, classes, c=1.0):
    """The same objective by Newton's steps: all second derivatives, in NumPy."""
    import numpy as np

    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    d, own = x.shape[1], np.eye(classes)[y]
    ridge = np.tile(np.append(np.ones(d - 1), 0.0), classes) / c
    w = np.zeros(classes * d)
    for _ in range(60):
        z = x @ w.reshape(classes, d).T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = ((p - own).T @ x).ravel() + ridge * w
        h = np.diag(ridge + 1e-9)
        for a in range(classes):
            for b in range(classes):
                weight = p[:, a] * ((a == b) - p[:, b])
                h[a * d : (a + 1) * d, b * d : (b + 1) * d] += (x * weight[:, None]).T @ x
        w -= np.linalg.solve(h, g)
        if np.linalg.norm(g) < 1e-9:
            break
    return w.reshape(classes, d)


def solved(x, y, f, k):
    """Balanced accuracy of each fold by Newton's solution on the others."""
    import numpy as np

    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    names, y = np.unique(y, return_inverse=True)
    out = {}
    for one in range(k):
        w = newton(x[f != one], y[f != one], len(names))
        hit = (np.concatenate([x[f == one], np.ones(((f == one).sum(), 1))], 1) @ w.T).argmax(1) == y[f == one]
        out[one] = np.mean([hit[y[f == one] == c].mean() for c in set(y[f == one])])
    return out


def test_probe_equals_a_newton_solution(spark):
    import numpy as np

    rng = random.Random(3)
    rows = [(i, i % 4, f"g{i // 2}", [rng.gauss(0, 1) + (1.2 if k == i % 4 else 0.0) for k in range(6)], [rng.gauss(0, 1) + (0.4 if k == i % 4 else 0.0) for k in range(4)]) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, label int, grp string, a array<double>, b array<double>").repartition(5)
    dealt, k, _ = P.folds(df, "label", 4, "grp")
    fold = {r.id: r.fold for r in dealt.select("id", "fold").collect()}
    got = {(r.fold, r.vectors): r.balanced_accuracy for r in P.probe(dealt, k, "label", ["a", "b"]).collect()}
    y, f = np.array([r[1] for r in rows]), np.array([fold[r[0]] for r in rows])
    assert len(got) == 8
    for name, at in (("a", 3), ("b", 4)):
        for one, want in solved(np.array([r[at] for r in rows]), y, f, k).items():
            assert abs(got[one, name] - want) < 1e-9


def test_descent_rests_though_the_loss_is_rounded():
    """Sums over many rows: what a step gains near the end is less than their rounding, which differs from sum to sum."""
    import numpy as np

    for seed in range(20):
        rng = np.random.default_rng(seed)
        scale = rng.uniform(10, 3000, 40)
        d = P._Descent(40, 1e-4)
        for _ in range(300):
            x = d.at - 1
            d.take(2e4 + (scale * (np.sqrt(1 + x * x) - 1)).sum() + rng.normal(0, 1e-9), scale * x / np.sqrt(1 + x * x))
            if d.done:
                break
        assert d.done and np.abs(d.x - 1).max() < 1e-4


def test_query_equals_a_newton_solution(spark):
    import numpy as np

    from aperture.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    fold = {r.id: r.fold for r in QUERIES["probe_folds"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    x, y, f = np.array([r.embedding for r in rows]), np.array([r.label for r in rows]), np.array([fold[r.vec_id] for r in rows])
    got = QUERIES["paired_probe"](spark, folder).collect()
    a, b = solved(x, y, f, 5), solved(x[:, :8], y, f, 5)
    assert sorted(r.fold for r in got) == [0, 1, 2, 3, 4]
    assert all(abs(r.a - a[r.fold]) < 1e-9 and abs(r.b - b[r.fold]) < 1e-9 and abs(r.delta - (r.a - r.b)) < 1e-12 for r in got)

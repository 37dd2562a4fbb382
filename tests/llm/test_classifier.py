import random

from aperture.llm import classifier
from aperture.llm import common as C


def test_held_out_accuracy(spark):
    spark_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark_docs.selectExpr("doc_id", "source host", "lang path", "text")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = classifier.classify(docs, train, C.Scratch(spark, "t")).join(test, "doc_id").select("kept", "quality").collect()
    good = [r for r in got if r.quality == 1]
    bad = [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.95 * len(good) and sum(not r.kept for r in bad) >= 0.8 * len(bad)


def test_shrinks_sparse_groups(spark):
    rng = random.Random(1)
    text = lambda good: " ".join(rng.choice(["fine", "nice", "prose"] if good else ["###", "&&&", "$$"]) for _ in range(30))
    rows = [(i, f"h{i % 5}", "p", text(i % 5 != 0)) for i in range(200)] + [(500, "rare", "p", text(False)), (501, None, None, None), (None, "h1", None, ""), (1, "h1", "p", text(True))]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, host string, path string, text string, n int")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(100)] + [(7, None), (None, 1)], "doc_id long, quality int")
    got = classifier.classify(docs, labels, C.Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[0].host_score < 0.3 < by[500].host_score and by[1].host_score > 0.7
    assert not by[500].kept and by[3].kept and not by[5].kept
    again = classifier.classify(docs, labels, C.Scratch(spark, "t")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "h", "p", "a b")], "doc_id long, host string, path string, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert classifier.classify(docs, none, C.Scratch(spark, "t")).first().doc_score == 0.5
    assert classifier.classify(docs.limit(0), none, C.Scratch(spark, "t")).count() == 0


def brute(rows, labels, scored):
    """Scores of (doc_id, host, path, text) rows in plain Python, from the documents' own scores."""
    import math
    from collections import defaultdict

    def strength(groups):  # (n, s, prior)
        n = sum(g[0] for g in groups)
        v = sum(p * (1 - p) for *_, p in groups) / len(groups)
        between = max((sum(k * (s / k - p) ** 2 for k, s, p in groups) - sum(p * (1 - p) for *_, p in groups)) / n, 1e-6)
        return min(max(v / between - 1, 1.0), 1e6)

    hosts, paths = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for _, h, p, s in scored:
        for d, k in ((hosts, h), (paths, (h, p))):
            d[k][0] += 1
            d[k][1] += s
    mean = sum(x[3] for x in scored) / len(scored)
    a = strength([(n, s, mean) for n, s in hosts.values()])
    host = {h: (s + a * mean) / (n + a) for h, (n, s) in hosts.items()}
    b = strength([(n, s, host[h]) for (h, _), (n, s) in paths.items()])
    odds = lambda p: math.log(max(p, 1e-9) / max(1 - p, 1e-9))
    out = []
    for i, h, p, s in scored:
        hs = (hosts[h][1] - s + a * mean) / (hosts[h][0] - 1 + a)
        ps = (paths[h, p][1] - s + b * hs) / (paths[h, p][0] - 1 + b)
        score = 1 / (1 + math.exp(-(odds(s) + odds(ps) - odds(mean))))
        out.append((str(i), str(h), str(p), round(s, 9), round(hs, 9), round(ps, 9), round(score, 9), score >= 0.5))
    return sorted(out)


def evidence(rows, labels, sample=classifier.SAMPLE):
    """The documents' own scores by a dense logistic regression on features made word by word."""
    import hashlib
    import re

    import numpy as np
    import pyarrow as pa

    def features(text):
        text = text or ""
        x = np.zeros((1 << classifier.BITS) + classifier.EXTRA + 1)
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        h = [int(C.word_hashes(*C.bytes_of(pa.array([w])))[0][0] >> np.uint64(64 - classifier.BITS)) for w in words]
        for k in set(h):
            x[k] = 1 / len(set(h)) ** 0.5
        data = text.encode()
        for c in data:
            x[(1 << classifier.BITS) + int(classifier._KINDS[c])] += 4 / len(data)
        x[(1 << classifier.BITS) + 8] = 4 * len(set(h)) / max(len(words), 1)
        x[(1 << classifier.BITS) + 9] = 4 * min(np.log1p(len(words)) / 8, 1)
        x[-1] = 1
        return x

    y = {}
    for i, q in labels:
        if i is not None and q is not None:
            y[i] = max(q, y.get(i, 0))
    first = {}
    for i, _, _, t in rows:
        if i in y:
            first[i] = min((hashlib.md5((t or "").encode()).hexdigest(), t or ""), first.get(i, ("g", "")))
    assert len(y) <= sample
    if not first or len({y[i] for i in first}) < 2:
        return [(i, h, p, 0.5) for i, h, p, _ in rows]
    x, target = np.stack([features(first[i][1]) for i in sorted(first)]), np.array([y[i] for i in sorted(first)], float)
    w = m = v = np.zeros(x.shape[1])
    for k in range(1, 401):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - target) / len(target) + 1e-4 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return [(i, h, p, float(1 / (1 + np.exp(-np.clip(features(t) @ w, -30, 30))))) for i, h, p, t in rows]


def test_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda good: "".join(rng.choice("abcdefgh" if good else "#&XZ01é") for _ in range(rng.randrange(1, 7)))
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None]), " ".join(word(rng.random() < (0.9 if i % 4 else 0.2)) for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    rows += [(200, "lone", "x", None), (201, "lone2", None, ""), (None, "a", "x", "abc def"), (3, "a", "y", "another text of id 3"), (3, "a", "y", "another text of id 3"), (202, "b", "x", "word " * 30_000)]
    labels = [(i, int(i % 4 != 0)) for i in range(80)] + [(3, 0), (5, None), (None, 1), (999, 1)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, host string, path string, text string, n int, score string").repartition(3)
    got = classifier.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int"), C.Scratch(spark, "t")).collect()
    mine = evidence(rows, labels)
    assert len(got) == len(rows)
    own = sorted((str(r.doc_id), str(r.host), str(r.path), r.doc_score) for r in got)
    for a, b in zip(own, sorted((str(i), str(h), str(p), s) for i, h, p, s in mine)):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 2e-3  # single precision in the operator's fit
    want = brute(rows, labels, [(r.doc_id, r.host, r.path, r.doc_score) for r in got])
    have = sorted((str(r.doc_id), str(r.host), str(r.path), round(r.doc_score, 9), round(r.host_score, 9), round(r.path_score, 9), round(r.score, 9), r.kept) for r in got)
    for a, b in zip(have, want):
        assert a[:3] == b[:3] and a[7] == b[7] and all(abs(x - y) < 1e-6 for x, y in zip(a[3:7], b[3:7]))


def test_examples_are_bounded(spark):
    """Rows that repeat a labelled doc_id give one example, whatever their number and order."""
    rows = [(i % 3, "h", "p", f"text {i % 6} of {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, host string, path string, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)] * 5, "doc_id long, quality int")
    a = classifier.classify(docs, labels, C.Scratch(spark, "t"), sample=3).collect()
    b = classifier.classify(docs.repartition(5), labels, C.Scratch(spark, "t"), sample=3).collect()
    key = lambda r: (r.doc_id, round(r.doc_score, 9), round(r.score, 9))
    assert sorted(map(key, a)) == sorted(map(key, b))

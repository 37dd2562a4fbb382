import numpy as np

from aperture.llm import common as C
from aperture.llm import hnsw


def brute(rows, least=0.95):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root, links = {i: i for i, _ in rows if i is not None}, {i: 0 for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(good):
        for j, b in good[:k]:
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in links}


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = []
    for n in range(700):
        c = 0 if n % 3 == 0 else rng.integers(40)
        rows.append((n, (base[c] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.3])).astype(np.float32).tolist()))
    rows += [(800, None), (801, []), (802, [0.0] * 16), (803, [None] + [1.0] * 15), (804, [float("nan")] * 16), (805, [float("inf")] + [1.0] * 15), (806, rows[5][1]), (807, rows[5][1]), (808, [1.0, 2.0]), (809, [2.0, 4.0]), (None, rows[5][1])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, n int")
    got = hnsw.link_vectors(df, C.Scratch(spark, "t")).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    have = {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None}
    total = sum(n for n, _ in want.values())
    assert sum(min(have[i][0], want[i][0]) for i in want) >= 0.99 * total and all(have[i][0] <= want[i][0] for i in want)
    assert sum(have[i][1] == want[i][1] for i in want) >= 0.99 * len(want)
    assert all(have[i] == want[i] for i in range(800, 810))
    assert all(r.audit_recall >= 0.99 and r.audit_links > 0 for r in got if r.n_links and r.vec_id not in (808, 809))


def test_a_link_counts_for_both_ends(spark):
    """Whatever is missed is missing from both counts: their sum is twice the links, and no vector of a larger class is without one."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(30, 24))
    rows = [(n, (base[rng.integers(30)] + rng.normal(size=24) * 0.2).astype(np.float32).tolist()) for n in range(900)]
    got = {r.vec_id: r for r in hnsw.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), C.Scratch(spark, "t"), shard_bytes=10_000).collect()}
    want = brute(rows)
    assert sum(r.n_links for r in got.values()) % 2 == 0
    assert all(got[i].n_links <= want[i][0] for i in want) and sum(r.n_links for r in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    size = {}
    for r in got.values():
        size[r.component_id] = size.get(r.component_id, 0) + 1
    assert all((r.n_links > 0) == (size[r.component_id] > 1) for r in got.values())


def test_audit_counts_no_match_with_itself(spark, tmp_path):
    """Of vectors without links there is nothing to measure; with few links more vectors are audited."""
    rng = np.random.default_rng(2)
    rows = [(n, rng.normal(size=32).tolist()) for n in range(600)]
    got = hnsw.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), C.Scratch(spark, "t")).collect()
    assert all(r.audit_recall is None and r.audit_links == 0 and r.n_links == 0 for r in got)
    twin = rows + [(1000 + n, (np.array(v) + 0.01).tolist()) for n, v in rows[:40]]
    got = hnsw.link_vectors(spark.createDataFrame(twin, "vec_id long, embedding array<double>"), C.Scratch(spark, "t"), audit=8).collect()
    assert sum(r.n_links for r in got) == 80 and max(r.audit_links for r in got) > 0


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph.build(x)
    q = x[:200] + rng.normal(size=(200, 32)).astype(np.float32) * 0.05
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    a, b = g.within(q, 0.45)
    want = {(i, j) for i, j in zip(*np.nonzero(q @ x.T >= 0.45))}
    assert len(set(zip(a.tolist(), b.tolist())) & want) >= 0.95 * len(want)


def test_doubles_stay_doubles(spark):
    """Components beyond single precision, and a cosine that only doubles tell from the limit."""
    edge = lambda c: [c, (1 - c * c) ** 0.5]
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [2.0, 2.0]), (4, [-1e300, 1e300]), (10, [1.0, 0.0]), (11, edge(0.95 + 1e-12)), (12, edge(0.95 - 1e-12))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), C.Scratch(spark, "t")).collect()}
    assert got[1] == got[2] == got[3] == (2, 1) and got[4] == (0, 4)
    assert got[10] == (1, 10) and got[11] == (2, 10) and got[12] == (1, 10)


def test_empty_table(spark):
    assert hnsw.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), C.Scratch(spark, "t")).count() == 0

"""Operators over whole tables against plain Python."""

import math
from collections import defaultdict

from aperture.plans import inputs as I
from aperture.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_info_nce_of_every_batch(spark):
    pairs = sorted(I.pairs(spark, SF).select("pair_index", "image_emb", "text_emb").collect())
    batches = defaultdict(list)
    for i, im, tx in pairs:
        batches[i // 64].append((im, tx))
    want = {}
    for b, rows in batches.items():
        sim = [[sum(x * y for x, y in zip(im, tx)) for _, tx in rows] for im, _ in rows]
        loss, top, n = 0.0, 0.0, len(rows)
        for m in (sim, list(zip(*sim))):
            loss += sum(math.log(sum(math.exp(10 * x) for x in m[k])) - 10 * m[k][k] for k in range(n)) / n / 2
            top += sum(m[k][k] >= max(m[k]) for k in range(n)) / n / 2
        want[b] = (loss, top)
    got = {r.batch: (r.loss, r.top1) for r in QUERIES["info_nce"](spark, SF).collect()}
    assert set(got) == set(want) and len(want) > 1
    assert all(abs(x - y) < 2e-6 for b in want for x, y in zip(got[b], want[b]))


def test_holm_of_all_parts(spark):
    parts = I.read(spark, SF, "part").select("p_partkey", "p_size").collect()
    groups = defaultdict(list)
    for k, size in parts:
        groups[size % 4].append((k * 37 % 1000 / 1000, k))
    want = {}
    for g in groups.values():
        top = 0.0
        for at, (p, k) in enumerate(sorted(g)):
            top = max(top, (len(g) - at) * p)
            want[k] = round(min(1.0, top), 6)
    got = {r.k: r.p_holm for r in QUERIES["holm_correction"](spark, SF).collect()}
    assert got == want and len(got) == len(parts)


def test_tile_grid_of_all_parts(spark):
    parts = I.read(spark, SF, "part").select("p_partkey", "p_size").collect()
    want = {(k, y, x) for k, size in parts for y in range(0, size * 100 - 255, 256) for x in range(0, 1000 - 255, 256)}
    got = [tuple(r) for r in QUERIES["tile_grid"](spark, SF).select("k", "y", "x").collect()]
    assert len(got) == len(want) and set(got) == want and len({k for k, _, _ in want}) > 20


def test_tiles_of_a_region(spark):
    """Against plain Python, also where tiles are larger than cells; no tile is copied or grouped, and the mask is not broadcast."""
    import random

    from aperture.operators import tables as J

    rng = random.Random(4)
    tiles = [(k, y, x) for k in range(6) for y in range(0, 900, 37) for x in range(0, 700, 53)]
    cells = [(k, rng.randrange(12), rng.randrange(12)) for k in range(5) for _ in range(6)]
    t, c = spark.createDataFrame(tiles, "k long, y long, x long"), spark.createDataFrame(cells, "k long, cy int, cx int")
    for size, cell in ((64, 100), (101, 100), (102, 100), (1, 50), (300, 90)):
        want = {(k, y, x) for k, y, x in tiles if any(k == m and y < (cy + 1) * cell and y + size > cy * cell and x < (cx + 1) * cell and x + size > cx * cell for m, cy, cx in cells)}
        got = [tuple(r) for r in J.in_region(t, c, size, cell, "k").collect()]
        assert len(got) == len(want) and set(got) == want and 0 < len(want) < len(tiles)
    plan = QUERIES["region_tiles"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "Aggregate" not in plan and "Broadcast" not in plan

import random
import re

from aperture.llm import common as C
from aperture.llm import mixing
from tests.llm.oracle import canon, run_sql


def make():
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([0, 1, 5, 300, 900]), rng.choice(["a", "b", "c", "d", None, "é"] + ["hot"] * 5)) for i in range(200)]
    return [*rows, (300, None, "a"), (301, " \n", "a"), (302, None, "empty"), (303, "x\ty\x0bz", "b"), (304, "q " * 20000, "c"), (305, "r " * 30000, "d"), *[(400 + i, "z " * 700, "c") for i in range(40)]]


def test_against_sql(spark, tmp_path):
    rows = make()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op7_mixing(spark, str(tmp_path))
    names, want = run_sql(mixing.OP7_SQL, documents=docs.toArrow())
    got_rows = got.collect()
    assert canon(got.columns, got_rows) == canon(names, want)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    assert all(r.taken <= 2 * r["size"] and r["size"] == size[r.doc_id] for r in got_rows)
    by = {}
    for r, s in zip(got_rows, (dict((i, s) for i, _, s in rows)[r.doc_id] for r in got_rows)):
        by.setdefault(s, [0, r.target])[0] += r.taken
    assert all(abs(a - b) <= 1 for a, b in by.values())
    assert abs(sum(b for _, b in by.values()) - 1.5 * sum(size.values())) < 1e-6
    assert sorted(map(tuple, mixing.op7_mixing(spark, str(tmp_path)).collect()), key=str) == sorted(map(tuple, got_rows), key=str)


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([("a", 1, 100_000, 100_000.0), ("b", 2, 50_000, 100_000.0), ("c", 3, 20_000, 1_000.0)], "source string, sid int, source_size long, target double")
    slots = mixing.schedule(sources, C.Scratch(spark, "t"), 100).collect()
    assert sum(r.take for r in slots) == 201_000
    order = [r.sid for r in sorted(slots, key=lambda r: r.slot)]
    for n in (100, 500, 1000):
        assert abs(order[:n].count(1) / n - 100 / 201) < 6 / n
    assert sorted((r["pass"], r.block) for r in slots if r.sid == 2) == [(p, b) for p in range(2) for b in range(500)]


def test_repeated_rows_and_texts(spark):
    rows = [(1, "a b c d", "s", 7), (1, "a b c d", "s", 7), (None, "e f", "s", 3), (2, "g  h\ti", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = mixing.mixed_documents(docs, C.Scratch(spark, "t"))
    assert got.columns == docs.columns
    words = sum(len(r.text.split()) for r in got.collect())
    assert words in (19, 20)  # 1.5 times 13, each source rounded
    assert mixing.mixed_documents(docs.limit(0), C.Scratch(spark, "t")).count() == 0


def test_documents_in_order_of_slots_with_clashing_columns(spark):
    """Partition after partition the documents come in the order of their slots; extra columns go along."""
    names = ["row", "id", "size", "first", "slot", "place", "words", "new", "pass", "d", "r", "key"]
    rows = [r for r in make() if r[1]]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in names))
    mixed = mixing.mixed_documents(docs, C.Scratch(spark, "t"))
    assert mixed.schema == docs.schema
    got = mixed.collect()
    assert all([r[c] for c in names] == list(range(len(names))) for r in got)
    sized = mixing._sized(docs, mixing.F.xxhash64("text", "doc_id"))
    plan = sorted((r.slot, r.place, r.doc_id, r.words) for r in mixing.mix(sized, C.Scratch(spark, "t")).where("words > 0").collect())
    assert [(d, w) for _, _, d, w in plan] == [(r.doc_id, len(r.text.split())) for r in got]
    hot = [r.source == "hot" for r in got]
    assert 0.3 < sum(hot[: len(hot) // 2]) / sum(hot) < 0.7  # sources alternate


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.op7_mixing(spark, str(tmp_path)).count() == 0

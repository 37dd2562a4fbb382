import random
import re
from collections import Counter
from itertools import permutations

import pytest

from aperture.llm import audit
from aperture.llm import common as C
from tests.llm.oracle import canon, run_sql


def brute(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    rows, parts = [], {}
    for i, text, lang in docs:
        t = text or ""
        w = words(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        parts.setdefault(lang or "", []).append((fails, i in good and i is not None, i in toxic and i is not None))
    for part, all_ in parts.items():
        own, shapley = [], Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                left = [d for d in all_ if not any(d[0][e] for e in order[: step - 1])]
                out = [d for d in left if d[0][f]]
                redundant = sum(d[0][f] for d in all_) - len(out)
                unique = sum(d[0][f] and sum(d[0].values()) == 1 for d in all_)
                own.append((part, "".join(order), step, f, len(left) - len(out), len(out), redundant, unique, sum(d[1] for d in out), sum(d[2] for d in out)))
                shapley[f] += len(out)
        rows += [(*r, shapley[r[3]]) for r in own]
    return rows


def make():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(120):
        t = " ".join(rng.sample(words, rng.choice([20, 110, 140])) * rng.choice([1, 1, 2]))
        rows.append((i, t.upper() if rng.random() < 0.2 else t + rng.choice(["", "", " #", "|"]), rng.choice(["en", "de", None, ""])))
    rows += [(500 + k, rows[k % 9][1], rng.choice(["en", "xx", "de"])) for k in range(150)]  # copies, some in other parts
    rows += [(1000 + k, None if k % 2 else "", "en") for k in range(6)] + [(None, rows[0][1], "en"), (None, None, None), (None, "x", "de"), (3, rows[3][1], rows[3][2]), (3, rows[3][1], "de"), (-5, rows[1][1], "fr"), (7, "É" * 50, "en"), (2000, "ok " * 40000, "en")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 700, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (8, None, None)]
    return rows, [(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in labels]


def tables(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n int, mask string")
    return docs, spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, part int")


def test_against_brute_force_and_sql(spark):
    rows, labels = make()
    docs, marks = tables(spark, rows, labels)
    got = audit.interaction_audit(audit.document_masks(docs, marks), list("ABCDE"))
    want = brute(rows, labels)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 600 * len({r[2] or "" for r in rows})
    names, sql = run_sql(audit.OP11_SQL, documents=docs.toArrow(), labels=marks.toArrow())
    assert canon(got.columns, got.collect()) == canon(names, sql)


def test_empty_tables(spark):
    docs, marks = tables(spark, [], [])
    assert audit.interaction_audit(audit.document_masks(docs, marks), list("ABCDE")).count() == 0
    docs, marks = tables(spark, [(1, "#", None)], [])
    got = audit.interaction_audit(audit.document_masks(docs, marks), list("ABCDE")).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and sum(r.removed for r in got) == 120


def test_sums_invert_exactly(spark):
    """Any counts of sets come back, and for three named filters too."""
    rng = random.Random(1)
    rows = [("p", g, t, m, rng.randrange(2**40)) for m in range(8) for g in (True, False) for t in (True, None)]
    masked = spark.createDataFrame(rows, "part string, good boolean, toxic boolean, mask int, n long")
    cells = audit.mask_cells(audit.parity_sums(masked.fillna(False), 3), 3).collect()
    assert {r.mask: (r.every, r.good, r.toxic) for r in cells} == {m: tuple(sum(r[4] for r in rows if r[3] == m and f(r)) for f in (lambda r: True, lambda r: r[1], lambda r: r[2])) for m in range(8)}
    got = audit.interaction_audit(masked, ["x", "y", "z"]).collect()
    assert len(got) == 18 and {r.filter_order for r in got} == {"".join(p) for p in permutations("xyz")}
    total = {r.filter: r.shapley for r in got}
    assert sum(total.values()) == 6 * sum(r[4] for r in rows if r[3])  # every failing document is removed once in each order
    with pytest.raises(ValueError, match="1 to 6"):
        audit.interaction_audit(masked, list("ABCDEFG"))


def test_hot_text_is_counted_before_the_shuffle(spark):
    """A text of most rows, and rows without an id, leave a task as a few rows."""
    docs = spark.range(20000).select(audit.F.when(audit.F.col("id") % 3 > 0, audit.F.col("id")).alias("doc_id"), audit.F.lit("same").alias("text"), audit.F.lit("en").alias("lang"))
    got = audit.document_masks(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.where("n > 0").collect()) == [("en", False, False, 1, 6667), ("en", False, False, 17, 13332), ("en", True, False, 1, 1)]

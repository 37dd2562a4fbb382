from aperture.llm import chat
from aperture.llm import common as C
from tests.llm.oracle import canon, run_sql


def test_against_sql(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé\nthere"), (1, 3, "cy", None), (1, 3, "cy", None), (1, 4, "ann", "x" * 5000), (2, 0, "system", "alone"), (None, 0, "ann", "q"), (None, None, "ann", "r"), (3, 0, None, "who"), (3, 1, 'a"|>', "z"), (4, 0, "ann", "")]
    rows += [(9, k, "u" if k % 2 else "v", f"t{k}") for k in range(300)]
    rows += [(10, 5, "ann" if k % 3 else "bob", "same" if k % 2 else None) for k in range(200)] + [(11, None, "x", "n")] * 70  # one range holds them all
    turns = spark.createDataFrame([(*r, *range(7)) for r in rows], "conv_id long, turn long, role string, text string, seq int, part int, at int, own int, long int, ours int, c2 int")
    got = chat.rotate(turns, C.Scratch(spark, "t"))
    names, want = run_sql(chat.OP10_SQL, conversations=turns.toArrow())
    assert canon(got.columns, got.collect()) == canon(names, want)
    views = {}
    for r in got.collect():
        views.setdefault((r.conv_id, r.perspective), []).append(r)
    for (_, who), turns in views.items():
        turns.sort(key=lambda r: r.seq)
        whole = "".join(r.segment for r in turns)
        for r in turns:
            assert whole[r.start :].startswith(r.segment) and (r.mask_start is not None) == (r.speaker == who)
            if r.mask_start is not None:
                assert whole[r.mask_start : r.mask_end].endswith("<|end|>") and whole[r.start : r.mask_start] == "<|assistant|>\n"
    assert (2, "system") not in views and chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), C.Scratch(spark, "t")).count() == 0

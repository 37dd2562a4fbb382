import itertools
import random
import zlib
from collections import defaultdict

import numpy as np

from aperture.llm import packing


def test_best_fill_is_optimal():
    rng = random.Random(0)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(1, 60)
        got = packing.best_fill(counts, room)
        assert all(n <= counts[x] for x, n in got.items())
        best = max(s for c in itertools.product(*(range(n + 1) for n in counts.values())) if (s := sum(a * b for a, b in zip(c, counts))) <= room)
        assert sum(x * n for x, n in got.items()) == best


def test_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    odd = ["it's", "don'tx", "É", "éa", "a b", "\x1c", "12ab", "...", "日本", "<|endoftext|>", "<|", " "]
    rows = [(i, " ".join(rng.choice([*odd, "word", "other", "x\ty", "l\nm"]) for _ in range(rng.choice([0, 3, 40, 900, 3000])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "  \n "), (5, rows[5][1]), (None, "null id"), (104, "a" * 3000), (105, "́x ́y")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length long")
    got = packing.pack(docs, packing.tokenizer_path()).collect()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        ids = np.array(want[i][0], "<u4")
        assert sum(p.length for p in pieces) == sum(map(len, want[i]))
        for p in pieces:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    waste = total = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048
        total += at
        waste += 0 if at & (at - 1) == 0 else 2048 - at
    assert waste <= 0.01 * total


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), packing.tokenizer_path()).count() == 0


def test_words_agree_with_the_tokenizer():
    from tokenizers import Tokenizer

    rng, tok = random.Random(2), Tokenizer.from_file(packing.tokenizer_path())
    chars = [chr(c) for c in range(1, 0x180)] + ["İ", "ǅ", "́", "日", "ﬁ", " "]
    texts = chars + ["".join(rng.choices(chars, k=rng.randrange(2, 30))) for _ in range(300)] + ["ÀÉß×÷ÿ", "a×b÷c", "'S'll", "1²3"]
    texts += [" ".join(rng.choices(texts, k=40)) for _ in range(50)]
    got = packing.Words(packing.tokenizer_path()).ids(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_tokenizers_are_not_divided(spark, tmp_path):
    """With other settings than those that the words' way was made for, whole texts are encoded."""
    import json

    from tokenizers import Tokenizer

    with open(packing.tokenizer_path(), encoding="utf-8") as f:
        made = json.load(f)
    made["normalizer"] = {"type": "NFC"}  # no lower case, and spaces stay
    path = f"{tmp_path}/other.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(made, f)
    texts = ["It's A Test", "a  b\nC", "", "x1 Y2"]
    tok = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.Words(path).ids(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert packing.Words(packing.tokenizer_path()).divides and not packing.Words(path).divides

"""run() against plain Python, stage by stage and as a whole."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from aperture.llm import common as C
from aperture.llm import mixing, packing
from tests.llm import test_minhash, test_quality, test_suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, size int, key string"


def make():
    rng = random.Random(8)
    common = ["the", "of", "and", "to", "is", "in", "a"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghij") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = [text(70) for _ in range(3)]
    rows = [(i, text(rng.randrange(60, 300)), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(60)]
    rows += [(100 + i, f"{text(90)} {passage[i % 3]} {text(80)}", "en", "b") for i in range(9)]
    rows += [(200 + i, " ".join([*rows[i][1].split()[:50], word(), *rows[i][1].split()[51:]]), "en", "c") for i in range(4)]  # near copies
    rows += [(300, rows[7][1], "en", "c"), (None, rows[8][1], "en", "c"), (301, "a b c " * 60, "en", "a"), (302, "too short", "en", "a"), (303, None, "en", "a"), (304, "", None, None), (305, text(80), "xx", "a")]
    rows += [(306, " ".join(f"{w}&&& ###" for w in rows[0][1].split()), "en", "b"), (0, rows[0][1], "en", rows[0][3])]
    return [(i, t, g, s, None if t is None else len(t), 1, 2, "k") for i, t, g, s in rows]


def quality(rows):
    W, js, kind = test_quality.W, test_quality.js, test_quality.kind
    langs = {r[2] for r in rows}
    words = {g: Counter(w for r in rows if r[2] == g for w in W.findall(r[1] or "")) for g in langs}
    chars = {g: Counter() for g in langs}
    for g in langs:
        for w, n in words[g].items():
            for c in w:
                chars[g][kind(c)] += n
    share = lambda c, top: {**{k: c[k] / sum(c.values()) for k in top if c[k]}, -1: sum(n for k, n in c.items() if k not in top) / sum(c.values())}
    out = []
    for r in rows:
        b, g = test_quality.base(r[1]), r[2]
        ok = not b[5]
        if ok and sum(words[g].values()) >= 2000:
            own = Counter(kind(c) for x in W.findall(r[1]) for c in x)
            ok = js({k: v / b[1] for k, v in own.items()}, {k: v / sum(chars[g].values()) for k, v in chars[g].items()}) <= 0.33
            if b[0] >= 100:
                mine, ref = test_quality.classes(Counter(W.findall(r[1]))), test_quality.classes(words[g])
                top = sorted(ref, key=lambda k: (-ref[k], k))[:64]
                ok = ok and js(share(mine, top), share(ref, top)) <= 0.385
        if ok:
            out.append(r)
    return out


def near(rows):
    rows = list(dict.fromkeys(rows))
    classes = test_minhash.brute([(i, r[1]) for i, r in enumerate(rows)])
    by = defaultdict(list)
    for i, k in classes.items():
        by[k].append(rows[i])
    return [min(c, key=lambda r: (r[0] is None, r[0] or 0)) for c in by.values()]


def cut(rows, n=200):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(x[i : i + n] for x in data for i in range(len(x) - n + 1))
    out = []
    for r, x in zip(rows, data):
        gone = bytearray(len(x))
        for i in range(len(x) - n + 1):
            if seen[x[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        left = bytes(b for b, g in zip(x, gone) if not g).decode()
        if left or not x:
            out.append((r[0], left if r[1] is not None else None, r[2], r[3], len(left), *r[5:]))
    return out


def mix(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(test_quality.W.findall(r[1] or "")) for _, r in by[s]) for s in names}
    weight, full = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}, set()
    while True:  # those that the level fills are full, the excess goes to the others by weight
        open_ = [s for s in names if s not in full]
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not over:
            break
        full |= over
    out = []
    for s in names:
        want = math.floor((2 * size[s] if s in full else weight[s] * level) + 0.5)
        place = 0
        for _, r in sorted(by[s], key=lambda x: x[0]):
            words = test_quality.W.findall(r[1] or "")
            parts = [len(words)] * (want // size[s]) + [max(0, min(place + len(words), want % size[s]) - place)]
            place += len(words)
            for n in parts:
                if n:
                    t = r[1] if n == len(words) else " ".join(words[:n])
                    out.append((r[0], t, r[2], r[3], len(t), *r[5:]))
    return out


def test_run_against_plain_python(spark, tmp_path):
    rows = make()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want, before = rows, docs
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (quality, near, cut, mix)):
        want = plain(want)
        before = C.Scratch(spark, "t").table(stage(spark, before, ""), name)
        assert before.columns == docs.columns
        got = Counter(map(tuple, before.collect()))
        assert got == Counter(want), name
    assert {r[0] for r in want} >= {0, 1, 2, 3, 100, 108} and not {r[0] for r in want} & {200, 201, 202, 203, 300, None, 301, 302, 303, 304, 306}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    from tokenizers import Tokenizer

    tok, pieces = Tokenizer.from_file(packing.tokenizer_path()), corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [(r[0], [*tok.encode(r[1], add_special_tokens=False).ids, 1]) for r in want]
    have, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        have[p.doc_id].append(p)
        seqs[p.sequence_id].append(p)
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(i for i, _ in ids)
    crc = lambda x: zlib.crc32(b"".join(k.to_bytes(4, "little") for k in x))
    known = {(i, crc(x[a : a + n])) for i, x in ids for a, n in {(p.start, p.length) for p in have[i]}}
    assert all((p.doc_id, p.ids_crc32) in known for p in pieces) and sum(p.length for p in pieces) == sum(len(x) for _, x in ids)
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty, "")
        assert got.count() == 0 and (got.columns == empty.columns or "sequence_id" in got.columns)


def test_repeat_stage_is_op1(spark):
    """What the third stage keeps of each text is what the operator's digest says."""
    rows = make()[60:72]
    assert sorted((str(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in cut(rows)) == sorted((d, sha) for d, n, gone, _, sha in test_suffix.brute([(r[0], r[1]) for r in rows]) if gone < n or not n)

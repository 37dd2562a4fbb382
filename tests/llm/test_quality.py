import math
import random
import re
from collections import Counter

from aperture.llm import common as C
from aperture.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = W.findall(text)
    lines = [x for x in text.split("\n") if W.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, hit = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            hit |= {i, i + 1, i + 2}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def js(p, q):
    keys = {*p, *q}
    part = lambda a, m: a * math.log2(a / m) if a else 0.0
    return math.sqrt(max(0.0, sum(part(p.get(k, 0), (p.get(k, 0) + q.get(k, 0)) / 2) / 2 + part(q.get(k, 0), (p.get(k, 0) + q.get(k, 0)) / 2) / 2 for k in keys)))


def kind(c):
    for name, pattern in quality.CLASSES.items():
        if re.match(pattern, c):
            return name
    return "beyond"


def classes(words):
    """Counts by the 16 bits of a word's hash that stand for it."""
    import xxhash

    out = Counter()
    for w, n in words.items():
        out[xxhash.xxh64_intdigest(w.encode(), 42) & (quality.BUCKETS - 1)] += n
    return out


def make():
    rng = random.Random(3)
    common = ["the", "of", "and", "to", "is", "é"]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(30, 400))), "en" if i % 3 else None) for i in range(90)]
    rows += [(200, None, "en"), (201, "", "en"), (202, " \n\t", "en"), (203, "one", "xx"), (204, "a b c " * 40, "en"), (205, "\n".join(["same line"] * 30 + [" ", ""]), "en")]
    rows += [(206, " ".join(f"{w}&&& ###" for w in rows[0][1].split()), "en"), (207, rows[1][1].upper(), "en"), (208, rows[2][1] * 60, "en"), (1, rows[1][1], "en"), (None, rows[4][1], "en")]
    return rows


def test_against_brute_force(spark):
    rows = make()
    docs = spark.createDataFrame([(i, t, g, 1, "x") for i, t, g in rows], "doc_id long, text string, lang string, n_words int, id string")
    got = sorted(map(tuple, quality.quality(docs, C.Scratch(spark, "t")).collect()), key=str)
    want = []
    langs = {g for _, _, g in rows}
    words = {g: Counter(w for _, t, x in rows if x == g for w in W.findall(t or "")) for g in langs}
    chars = {g: Counter() for g in langs}
    for g in langs:
        for w, n in words[g].items():
            for c in w:
                chars[g][kind(c)] += n
    for i, t, g in rows:
        b = base(t)
        w, total = Counter(W.findall(t or "")), sum(words[g].values())
        cd = wd = None
        if total >= 2000 and b[0] >= 50:
            own = Counter(kind(c) for x in W.findall(t) for c in x)
            cd = js({k: v / b[1] for k, v in own.items()}, {k: v / sum(chars[g].values()) for k, v in chars[g].items()})
        want.append((i, *b, cd, total, w, g))
    by = {}
    for r in want:
        by.setdefault(str(r[:6]), []).append(r)
    assert len(got) == len(rows)
    for r in got:
        x = by[str((r[0], *r[1:6]))][0]
        assert r[6] == x[6]
        assert (r[8] is None) == (x[7] is None) and (r[8] is None or abs(r[8] - x[7]) < 1e-6)
        assert (r[9] is not None) == (r[1] >= 100 and x[8] >= 2000)
        assert r[7] == (not r[6] and (r[8] is None or r[8] <= 0.33) and (r[9] is None or r[9] <= 0.385))  # as documented
        if r[9] is not None:
            own, ref = classes(x[9]), classes(words[x[10]])
            top = sorted(ref, key=lambda k: (-ref[k], k))[:64]
            share = lambda c: {**{k: c[k] / sum(c.values()) for k in top if c[k]}, -1: sum(n for k, n in c.items() if k not in top) / sum(c.values())}
            assert abs(r[9] - js(share(own), share(ref))) < 1e-6
    kept = {r[0]: r[7] for r in got}
    assert not kept[206] and not kept[207] and not kept[204]
    assert all(kept[i] for i in range(90) if base(rows[i][1])[0] >= 50)


def test_word_distance(spark):
    text = "a a a b b c " * 400
    docs = spark.createDataFrame([(1, text, "z"), (2, "a b " * 100, "z")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.word_distance for r in quality.quality(docs, C.Scratch(spark, "t")).collect()}
    q = {"a": 1300 / 2600, "b": 900 / 2600, "c": 400 / 2600}
    assert abs(got[2] - js({"a": 0.5, "b": 0.5}, q)) < 1e-9 and abs(got[1] - js({"a": 3 / 6, "b": 2 / 6, "c": 1 / 6}, q)) < 1e-9


def test_empty_table(spark):
    assert quality.quality(spark.createDataFrame([], "doc_id long, text string, lang string"), C.Scratch(spark, "t")).count() == 0

"""How filters overlap: signed parity sums over the sets of filters that documents fail, inverted to counts of each set."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aperture.llm import common as C

MOST = 6
LABELS = ("every", "good", "toxic")
SPREAD = 1024


def parity_sums(masked: DataFrame, k: int) -> DataFrame:
    """Per part and label of `masked` (part, good, toxic, mask, n): `sums`, of which sum j adds n for the rows that fail an even number of the filters in set j, and takes it away for the others.

    They are summed within each task before the shuffle: a row for each task, part and label.
    """
    sign = lambda j: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(j))) % 2)
    sums = masked.groupBy("part", "good", "toxic").agg(*[F.sum(F.col("n") * sign(j)).alias(f"s{j}") for j in range(2**k)])
    return sums.select("part", "good", "toxic", F.array(*[f"s{j}" for j in range(2**k)]).alias("sums"))


def walsh_hadamard(x: Column, k: int) -> Column:
    """The transform of an array of 2^k numbers in k rounds of sums and differences; twice it gives 2^k times the array."""
    places = F.sequence(F.lit(0), F.lit(2**k - 1))

    def step(bit: int):
        other = lambda a, i: F.get(a, i.bitwiseXOR(F.lit(bit)))
        return lambda a: F.transform(places, lambda i: F.when(i.bitwiseAND(F.lit(bit)) == 0, F.get(a, i) + other(a, i)).otherwise(other(a, i) - F.get(a, i)))

    for b in range(k):
        x = F.get(F.transform(F.array(x), step(1 << b)), F.lit(0))  # an array of one: binds the round before, so that it is computed once
    return x


def mask_cells(sums: DataFrame, k: int) -> DataFrame:
    """(part, mask, every, good, toxic): how many documents fail exactly the filters in `mask` (bit b: filter b), all, good and toxic ones; 2^k rows a part."""
    exact = sums.select("part", "good", "toxic", walsh_hadamard(F.col("sums"), k).alias("t")).select("part", "good", "toxic", F.posexplode("t").alias("mask", "c")).withColumn("c", F.expr(f"c div {2**k}"))
    return exact.groupBy("part", "mask").agg(F.sum("c").alias("every"), *[F.sum(F.when(F.col(c), F.col("c")).otherwise(0)).alias(c) for c in ("good", "toxic")])


def interaction_audit(masked: DataFrame, names: list[str]) -> DataFrame:
    """What each filter does at each step of every order of the filters, per part.

    `masked` has part, good and toxic (booleans), mask (bit b is set where filter names[b] is failed) and n, how
    many documents the row stands for. A result row is a part, an order (the names in a row) and a step (from 1): filter, kept
    (left after this step), removed (by it), redundant (failing it, but removed before), unique_fails (failing it alone), good_lost
    and toxic_lost (of those removed), shapley (what it removes, summed over all orders: a document that fails c filters is removed by
    each of them in k!/c of the k! orders). A part with no failures has its rows too, with zeros. Null parts are the part ''; null flags are
    false; an empty table gives no rows. At most MOST filters, for there are k! orders.

    The table is read once, for 2^k parity sums per part and label; all the rest is made of them.
    """
    k = len(names)
    if not 1 <= k <= MOST:
        raise ValueError(f"1 to {MOST} filters can be audited")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    cells = mask_cells(parity_sums(masked.select(F.coalesce("part", F.lit("")).alias("part"), *flags, "mask", "n"), k), k)
    parts = cells.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", *LABELS))).alias("cells"))  # 2^k of them
    has = lambda mask, f: F.call_function("shiftright", mask, f).bitwiseAND(F.lit(1)) == 1
    three = lambda of: F.named_struct(*[x for c in LABELS for x in (F.lit(c), of(c))])
    none = three(lambda c: F.lit(0).cast("bigint"))
    free = F.transform(F.sequence(F.lit(0), F.lit(2**k - 1)), lambda p: F.aggregate("cells", none, lambda a, x: F.when(x["mask"].bitwiseAND(p) == 0, three(lambda c: a[c] + x[c])).otherwise(a)))
    each = F.sequence(F.lit(0), F.lit(k - 1))
    share = lambda x: F.call_function("div", x["every"] * factorial(k), F.bit_count(x["mask"]))
    shares = F.transform(each, lambda f: F.aggregate("cells", F.lit(0).cast("bigint"), lambda a, x: a + F.when(has(x["mask"], f), share(x)).otherwise(F.lit(0).cast("bigint"))))
    alone = F.transform(each, lambda f: F.get("cells", F.call_function("shiftleft", F.lit(1), f))["every"])
    rows = parts.select("part", free.alias("free"), shares.alias("shares"), alone.alias("alone"), F.explode(F.lit([list(p) for p in permutations(range(k))])).alias("order")).select("*", F.posexplode("order").alias("pos", "f"))
    bit = lambda f: F.call_function("shiftleft", F.lit(1), f)
    rows = rows.withColumn("before", F.aggregate(F.slice("order", F.lit(1), F.col("pos")), F.lit(0), lambda a, f: a.bitwiseOR(bit(f)))).withColumn("after", F.col("before").bitwiseOR(bit(F.col("f"))))
    left = lambda at, c="every": F.get("free", at)[c]
    lost = lambda c: left(F.col("before"), c) - left(F.col("after"), c)
    name = lambda f: F.get(F.lit(names), f)
    failing = left(F.lit(0)) - left(bit(F.col("f")))
    return rows.select(
        "part", F.array_join(F.transform("order", name), "").alias("filter_order"), (F.col("pos") + 1).alias("step"), name(F.col("f")).alias("filter"), left(F.col("after")).alias("kept"), lost("every").alias("removed"),
        (failing - lost("every")).alias("redundant"), F.get("alone", "f").alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shares", "f").alias("shapley"),
    )


def text_failures(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, lang) as (doc_id, part, digest, mask): what each whole text fails of A to D (bits 0 to 3), and its SHA-256."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.btrim(text, F.lit(C.SPACES))
    df = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, rf"{C.SPACE_CLASS}+")).alias("words"))
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = [F.size("words") < 100, 100 * F.size(F.array_distinct("words")) < 80 * F.size("words"), 100 * upper > 10 * F.length("text"), F.col("text").rlike("[#$%&*|]")]
    return df.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum((c.cast("int") * (1 << b) for b, c in enumerate(fails)), F.lit(0)).alias("mask"))


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, mask, n) of `docs` (doc_id, text, lang) and `labels` (doc_id, quality, toxic) by the five filters: bit 4 is E, text that a smaller doc_id has too.

    A null text is empty and a null lang the part ''. A null doc_id has no label, and neither fails E nor makes another fail
    it. Repeated rows of the smallest doc_id of a text do not fail E. Several labels of a doc_id: good or toxic if any says so. Other columns are
    ignored.

    Texts stay in the task that reads them: what is shuffled is a digest, an id and a mask. Copies are counted by text, part and label, within
    each task first, so the rows of a text that very many documents share meet as a handful. Rows without an id are spread over keys that no label has.
    """
    narrow = text_failures(docs)
    spread = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).otherwise(0)
    narrow = narrow.withColumn("spread", spread).groupBy("doc_id", "spread", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    known = narrow.join(marks.withColumn("zero", F.lit(0).cast("bigint")), (F.coalesce("doc_id", F.lit(0)) == F.col("id")) & (F.col("spread") == F.col("zero")), "left")
    known = known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    copies = known.groupBy("digest", "part", "good", "toxic", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without"), first.alias("first"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    copies = copies.withColumn("spared", F.col("without") + F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0))
    both = F.array(F.struct(F.col("mask"), F.col("spared").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("spared")).alias("n")))
    return copies.select("part", "good", "toxic", F.inline(both))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")
    return interaction_audit(document_masks(docs, labels), list("ABCDE"))


OP11_SQL = r"""
WITH l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT t.doc_id, part, len(words) < 100 AS a, 100 * list_unique(words) < 80 * len(words) AS b,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
  coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS e FROM t),
g AS (SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
o AS (SELECT p.v || q.v || r.v || s.v || u.v AS filter_order FROM x p, x q, x r, x s, x u
  WHERE p.v NOT IN (q.v, r.v, s.v, u.v) AND q.v NOT IN (r.v, s.v, u.v) AND r.v NOT IN (s.v, u.v) AND s.v <> u.v),
z AS (SELECT filter_order, step::INT AS step, filter_order[step] AS filter, string_split(left(filter_order, step - 1), '') AS earlier FROM o, range(1, 6) AS r(step)),
h AS (SELECT part, filter_order, step, filter, n, good, toxic, fails[filter] AS failing, len(list_filter(earlier, lambda v: v <> '' AND fails[v])) > 0 AS gone,
  len(list_filter(map_values(fails), lambda v: v)) AS c FROM g, z),
s AS (SELECT part, filter_order, step, filter, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND failing THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN failing AND c = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN NOT gone AND failing AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN NOT gone AND failing AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM h GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM s
"""

"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aperture.llm import common as C

WEIGHTS, SHARE, REPEAT = (5, 2, 1), 1.5, 2
BLOCK, SPREAD, CELLS = 256, 1024, 4096
GOLDEN = 0.6180339887498949


def n_words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(C.SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, C.SPACE_CLASS + "+"))).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: float = REPEAT) -> DataFrame:
    """Per source of `sized` (source, size): sid (its place by code point, null last), source_size, target.

    The targets are `share` of all sizes by weight, none over `repeat` times its source's size, the
    excess being shared again by weight: the water level at which they add up. A source is full
    if, with those of a smaller size for their weight full, the level is above it.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") - 1) % len(weights) + 1))
    s = s.withColumn("most", F.col("source_size") * float(repeat))
    all_, before = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    full, open_ = F.coalesce(F.sum("most").over(before), F.lit(0.0)), F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", (F.sum("source_size").over(all_) * float(share) - full) / open_)
    s = s.withColumn("level", F.max(F.when(F.col("most") >= F.col("level") * F.col("weight"), F.col("level"))).over(all_))
    return s.select("source", "sid", "source_size", F.least("most", F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def schedule(sources: DataFrame, scratch: C.Scratch, block: int = BLOCK) -> DataFrame:
    """(slot, sid, pass, block, take): slot n goes to the source in whose share of [0, 1) the point frac(n * golden ratio) falls.

    A source's slots, ranked, run through its blocks again and again until they hold its target; take
    is the block's words that the slot takes (all but in the last). A source that the points served a
    few slots short has the rest at the end, one that was served too many drops them.
    """
    per = F.ceil(F.col("source_size") / block)
    s = sources.where("target >= 0.5").withColumns({"want": F.round("target").cast("long"), "blocks": per})
    s = s.withColumn("slots", F.floor(F.col("want") / F.col("source_size")) * F.col("blocks") + F.ceil((F.col("want") % F.col("source_size")) / block))
    s = s.withColumns({"hi": F.sum("slots").over(Window.orderBy("sid")), "all": F.sum("slots").over(Window.partitionBy(F.lit(0)))})
    s = scratch.table(s.withColumns({"lo": (F.col("hi") - F.col("slots")) / F.col("all"), "hi": F.col("hi") / F.col("all")}), "bands")
    n = s.agg(F.max("all")).first()[0] or 0
    cells = s.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    x = F.col("id") * F.lit(GOLDEN)
    points = scratch.spark.range(n).select(F.col("id").alias("slot"), (x - F.floor(x)).alias("x")).withColumn("c", F.floor(F.col("x") * CELLS))
    drawn = points.join(cells, F.col("c") == F.col("cell")).where("x >= lo and x < hi").select("slot", "sid", F.floor(F.col("slot") / SPREAD).alias("part"), F.lit(1).alias("one"))
    drawn = scratch.table(C.running_sum(drawn, ["sid"], "part", ["slot"], "one", "rank").select("slot", "sid", "rank"), "drawn")
    have = drawn.groupBy(F.col("sid").alias("s2")).agg(F.count("*").alias("have"))
    short = s.join(have, F.col("sid") == F.col("s2"), "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < slots")
    short = short.select(F.lit(n).alias("slot"), "sid", F.explode(F.sequence(F.col("have"), F.col("slots") - 1)).alias("rank"))
    out = drawn.union(short.select((F.col("slot") + F.col("rank")).alias("slot"), "sid", "rank")).join(s.select("sid", "source_size", "want", "blocks", "slots"), "sid").where("rank < slots")
    out = out.withColumns({"pass": F.floor(F.col("rank") / F.col("blocks")), "block": F.col("rank") % F.col("blocks")})
    start = F.col("pass") * F.col("source_size") + F.col("block") * block
    own = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    return out.select("slot", "sid", "pass", "block", F.least(own, F.col("want") - start).alias("take"))


def mix(docs: DataFrame, scratch: C.Scratch, weights=WEIGHTS, share: float = SHARE, repeat: float = REPEAT, block: int = BLOCK) -> DataFrame:
    """(doc_id, row, source, size, source_size, target, place, pass, first, words, slot) of the mix of `docs` (doc_id, source, size, row).

    A source's documents, in the order of the MD5 of their ids, are one row of words, cut into blocks of
    `block`; a document has a result row for each pass that takes words of it (`words` from word `first`
    on, the first of them in slot `slot` of the schedule), and one of zero words, null pass and null slot if none does. place tells rows of the same document apart.

    A null source is one of its own and comes last. Documents without words take nothing, and an
    empty table gives an empty one. Repeated rows are documents of their own. Reruns agree.
    Words before a document are summed over SPREAD ranges of the hash first, so a source that holds most
    rows is spread as well; blocks and slots meet by (source, block), at most about `repeat` slots a block.
    """
    sources = scratch.table(targets(docs.select("source", "size"), weights, share, repeat), "sources")
    code = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    df = docs.join(sources.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    df = df.withColumn("code", code).withColumn("part", F.conv(F.substring("code", 1, 3), 16, 10).cast("int"))
    df = C.running_sum(df, ["sid"], "part", ["code", "doc_id", "row"], "size", "place").drop("part", "code")
    last = F.when(F.col("size") > 0, F.col("place") + F.col("size") - 1)
    df = df.withColumn("b", F.explode_outer(F.sequence(F.floor(F.col("place") / block), F.floor(last / block))))
    slots = schedule(sources, scratch, block).withColumnsRenamed({"sid": "s3"})
    spread = F.when(F.col("b").isNull(), -1 - F.pmod(F.xxhash64("doc_id", "row"), F.lit(1 << 40))).otherwise(F.col("b"))  # documents without words have no block; they meet nothing, each in its own place
    df = df.withColumn("at_block", spread)
    df = df.join(slots, (F.col("sid") == F.col("s3")) & (F.col("at_block") == F.col("block")), "left").drop("at_block")
    lo = F.greatest("place", F.col("b") * block)
    hi = F.when(F.col("take").isNotNull(), F.least(F.col("place") + F.col("size"), F.col("b") * block + F.col("take")))  # least() passes over nulls
    df = df.withColumn("n", F.greatest(F.coalesce(hi - lo, F.lit(0)), F.lit(0))).withColumn("at", F.when(F.col("n") > 0, lo - F.col("place")))
    keys = ["doc_id", "row", "source", "size", "source_size", "target", "place"]
    return df.groupBy(*keys, F.when(F.col("n") > 0, F.col("pass")).alias("pass")).agg(F.min("at").alias("first"), F.sum("n").cast("long").alias("words"), F.min(F.when(F.col("n") > 0, F.col("slot"))).alias("slot"))


def _sized(docs: DataFrame, row: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also first_slot: the slot of the schedule in which words of the document are first taken, null if none are."""
    got = mix(_sized(C.read(spark, sf_dir, "documents"), F.xxhash64("text")), C.Scratch(spark, "mix"))
    return got.groupBy("doc_id", "row", "size", "source_size", "target", "source", "place").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def mixed_documents(docs: DataFrame, scratch: C.Scratch) -> DataFrame:
    """The mix as documents in the order of the schedule: a row for each pass that takes words, whole if all, else those words divided by single spaces.

    Rows are told apart by a number, so equal ones are documents of their own; other columns go along as they are.
    Slots are of one size, so equal ranges of them make even partitions, in order.
    """
    part = lambda c: F.col(f"row.`{c}`") if c in docs.columns else F.lit(None).cast("string")
    base = scratch.table(docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "rows")
    sized = _sized(base.select("id", part("doc_id").alias("doc_id"), part("source").alias("source"), "row.text"), F.col("id"))
    got = scratch.table(mix(sized, scratch).where("words > 0").select(F.col("row").alias("id"), "size", "first", "words", "slot", "place"), "taken")
    scratch.only("rows", "taken")
    n = (got.agg(F.max("slot")).first()[0] or 0) + 1
    parts = max(1, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))
    words = F.split(F.btrim("row.text", F.lit(C.SPACES)), C.SPACE_CLASS + "+")
    some = F.array_join(F.slice(words, (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " ")
    both = base.join(got, "id").withColumn("new", F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(some))
    both = both.repartitionById(parts, F.floor(F.col("slot") * parts / n).cast("int")).sortWithinPartitions("slot", "place", "id")
    new = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return both.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(sid - 1) % 3 + 1]::DOUBLE AS w, 2 * n AS most FROM s),
v AS (SELECT *, sum(n) OVER () * 1.5 AS total, sum(w) OVER () AS all_w, coalesce(sum(most) OVER q, 0) AS fm, coalesce(sum(w) OVER q, 0) AS fw FROM w
  WINDOW q AS (ORDER BY most / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((total - fm) / (all_w - fw)) FILTER (most >= (total - fm) / (all_w - fw) * w) AS level FROM v),
t AS (SELECT source, sid, n::BIGINT AS n, least(most, level * w) AS target FROM v, l),
p AS (SELECT d.doc_id, d.size, t.sid, t.n, t.target, round(t.target)::BIGINT AS want, row_number() OVER () AS id,
  (sum(d.size) OVER (PARTITION BY t.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id) - d.size)::BIGINT AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT sid, n, round(target)::BIGINT AS want, (n + 255) // 256 AS blocks, (round(target)::BIGINT // n) * ((n + 255) // 256) + (round(target)::BIGINT % n + 255) // 256 AS slots FROM t WHERE target >= 0.5),
b AS (SELECT *, (sum(slots) OVER (ORDER BY sid))::BIGINT AS hi, (sum(slots) OVER ())::BIGINT AS every FROM e),
x AS (SELECT r.range AS slot, r.range * 0.6180339887498949::DOUBLE - floor(r.range * 0.6180339887498949::DOUBLE) AS x FROM range((SELECT max(every) FROM b)) r),
y AS (SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM x JOIN b ON x.x >= (hi - slots) / every::DOUBLE AND x.x < hi / every::DOUBLE),
h AS (SELECT b.sid, b.every, b.slots, count(y.slot) AS have FROM b LEFT JOIN y ON y.sid = b.sid GROUP BY ALL),
z AS (SELECT * FROM y UNION ALL SELECT every + r, sid, r FROM (SELECT *, unnest(range(have, slots)) AS r FROM h)),
k AS (SELECT z.slot, z.sid, rank % blocks AS block, least(256, n - rank % blocks * 256, want - rank // blocks * n - rank % blocks * 256) AS take FROM z JOIN b ON z.sid = b.sid WHERE rank < slots),
f AS (SELECT p.id, min(k.slot) AS first_slot FROM p JOIN k ON p.sid = k.sid AND p.size > 0 AND k.block BETWEEN p.place // 256 AND (p.place + p.size - 1) // 256
  AND least(p.place + p.size, k.block * 256 + k.take) > greatest(p.place, k.block * 256) GROUP BY p.id)
SELECT doc_id, size, n AS source_size, target,
  (CASE WHEN size = 0 THEN 0 ELSE (want // n) * size + greatest(0, least(place + size, want % n) - place) END)::BIGINT AS taken, first_slot
FROM p LEFT JOIN f ON f.id = p.id
"""

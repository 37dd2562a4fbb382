"""Host and path rules for urls by a sorted sweep over reversed-host keys; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aperture.llm import common as C

START, PAGE, END = 0, 1, 2
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def lowered(text: Column) -> Column:
    """A-Z lowered, no other letter."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    whole = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 0)
    host = F.regexp_extract(whole, r"^[^/]*", 0)
    return lowered(host), F.substr(whole, F.length(host) + 1)


def _key(labels: Column, path: Column) -> Column:
    """Reversed labels, a slash (no host has one), the path: bytes, so that order is that of UTF-8 and 0xFF is above all."""
    return F.encode(F.concat(F.array_join(labels, "."), F.lit("/"), path), "UTF-8")


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def sweep(events: DataFrame, scratch: C.Scratch, name: str = "sweep") -> DataFrame:
    """(id, rule) of the pages among `events` (key, kind, id, rule): the innermost rule whose interval holds the page's key; pages in none are left out.

    A START opens the interval of its rule at a key and an END closes it; intervals nest or are apart. In order
    of key and kind, the number of open intervals is the height of the stack, and its top the last rule that began at
    that height. Events are dealt out by ranges of key, kind and id, so that a key that very many pages have is spread, and each range is
    swept by itself; of the ranges before it needs its height and, for each height, the rule then open: a row per range and height.
    """
    dealt = scratch.table(events.repartitionByRange("key", "kind", "id").withColumn("part", F.spark_partition_id()), name)
    w = Window.partitionBy("part").orderBy("key", "kind", "id")
    step = F.when(F.col("kind") == START, 1).when(F.col("kind") == END, -1).otherwise(0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = dealt.groupBy("part").agg(F.sum(step).alias("up")).select(F.col("part").alias("of"), F.coalesce(F.sum("up").over(before), F.lit(0)).alias("base"))
    stack = dealt.withColumn("own", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))).join(base, F.col("part") == F.col("of")).withColumn("height", F.col("own") + F.col("base")).drop("of", "own", "base")
    slot = Window.partitionBy("part", "height").orderBy("key", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    began = F.when(F.col("kind") == START, F.col("rule"))
    stack = scratch.table(stack.where((F.col("kind") != END) & (F.col("height") > 0)).withColumn("top", F.last(began, True).over(slot)), f"{name}-stack")
    scratch.drop(name)
    # a height that a range has not filled itself: the last rule that any range before it left there
    tops = stack.where(F.col("kind") == START).groupBy("part", "height").agg(F.max_by("rule", F.struct("key", "id")).alias("left"))
    wanted = stack.where((F.col("kind") == PAGE) & F.col("top").isNull()).select("part", "height").distinct().select("part", "height", F.lit(None).cast(stack.schema["rule"].dataType).alias("left"))
    carried = F.last("left", True).over(Window.partitionBy("height").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carry = tops.unionByName(wanted).groupBy("part", "height").agg(F.max("left").alias("left")).select(F.col("part").alias("p2"), F.col("height").alias("h2"), carried.alias("carried"))
    pages = stack.where(F.col("kind") == PAGE).join(carry, (F.col("part") == F.col("p2")) & (F.col("height") == F.col("h2")), "left")
    return pages.select("id", F.coalesce("top", "carried").alias("rule"))


def judge(pages: DataFrame, rules: DataFrame, scratch: C.Scratch, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """`pages` with host, path, rule (host and path of the longest rule that fits, else null) and verdict (the rule's, else `otherwise`).

    `rules` (host, path, verdict) fit a url whose host is theirs or a subdomain of it (whole labels) and whose path
    begins with theirs; the longest host and path together win, of equals the longer host. A rule given twice blocks if
    either does. Null hosts and paths of rules are empty; upper-case A-Z in their hosts is lowered. A url's host is what stands after the first
    `://` up to `/`, `?`, `#` or the end, A-Z lowered; its path what follows up to `?`, `#` or the end; both are empty where the url is null or has no `://`.
    Repeated pages are judged each; no rules: all get `otherwise`. The four result names replace columns of the same name.

    A rule of a host and its subdomains is one interval of keys only among the urls of one host. So each page
    stands once for its host and once for each parent domain (no longer than the longest rule's), as if the url were there: its key is
    that domain reversed, then the path. Prefixes of a key are then exactly the rules that fit, nested intervals, and `sweep`
    finds the innermost; the longest of a page's domains wins. Neither rules nor pages are broadcast or joined by prefix. A key holds a path's beginning
    only as far as the longest rule reaches, for nothing after that can decide; url, host and path are whole everywhere else.
    """
    host, path = split_url(F.col(f"`{url}`"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = scratch.table(pages.select(*([F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")] if kept else []), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("id")), "pages")
    back = ["row.*"] if kept else []
    own = rules.select(lowered(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("blocks"))
    own = scratch.table(own.withColumn("labels", _reversed(F.col("host"))), "rules")
    longest, deepest = own.agg(F.max(F.length("path")), F.max(F.size("labels"))).first()
    if longest is None:
        return rows.select(*back, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    rule = F.struct((F.length("host") + F.length("path")).alias("long"), F.length("host").alias("host_long"), "host", "path", "blocks")
    begin = own.select(_key(F.col("labels"), F.col("path")).alias("key"), rule.alias("rule"))
    kind = begin.schema["rule"].dataType
    event = lambda df, key, kind, id_, rule: df.select(key.alias("key"), F.lit(kind).alias("kind"), id_.alias("id"), rule.alias("rule"))
    none = F.lit(-1).cast("bigint")
    domains = rows.select("id", F.substr("path", F.lit(1), F.lit(longest)).alias("head"), F.split("host", r"\.").alias("l")).select("id", "head", F.reverse("l").alias("labels"))
    domains = domains.select("id", "head", "labels", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(deepest)))).alias("depth"))
    events = event(begin, F.col("key"), START, none, F.col("rule"))
    events = events.unionByName(event(begin, F.concat("key", F.unhex(F.lit("FF"))), END, none, F.col("rule")))
    events = events.unionByName(event(domains, _key(F.slice("labels", F.lit(1), F.col("depth")), F.col("head")), PAGE, F.col("id"), F.lit(None).cast(kind)))
    best = sweep(events, scratch).groupBy("id").agg(F.max("rule").alias("best")).withColumnRenamed("id", "i2")
    out = rows.join(best.hint("merge"), F.col("id") == F.col("i2"), "left")  # a row for each page with a rule: never broadcast, however small its files look
    verdict = F.when(F.col("best").isNull(), F.lit(otherwise)).when(F.col("best.blocks"), "block").otherwise("allow")
    return out.select(*back, "host", "path", F.concat("best.host", "best.path").alias("rule"), verdict.alias("verdict"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(C.read(spark, sf_dir, "pages").select("page_id", "url"), rules, C.Scratch(spark, "urls")).drop("url")


OP12_SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
a AS (SELECT page_id, row_number() OVER () AS k, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
c AS (SELECT b.*, r.host || r.path AS rule, coalesce(r.verdict, 'allow') AS verdict, row_number() OVER (PARTITION BY k ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS n
  FROM b LEFT JOIN r ON (b.host = r.host OR ends_with(b.host, '.' || r.host)) AND starts_with(b.path, r.path))
SELECT page_id, host, path, rule, verdict FROM c WHERE n = 1
"""

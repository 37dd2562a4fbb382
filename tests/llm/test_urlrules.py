import random

from aperture.llm import common as C
from aperture.llm import urlrules
from tests.llm.oracle import canon, run_sql


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda t, marks: t[: min((t.find(m) for m in marks if m in t), default=len(t))]
    host = cut(rest, "/?#")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), cut(rest[len(host) :], "?#")


def brute(url, rules, otherwise="allow"):
    host, path = parts(url)
    fits = [(len(h) + len(p), len(h), h, p, v == "block") for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2] + best[3], otherwise if best is None else "block" if best[4] else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "https://a.NET/x", "https://bnet/x", "http://example.net/en/", "http://www.example.net/en", "http://x.example.net/en/a?b#c", "ftp://Example.ORG/fr/?", "http://org?q=/fr/",
    "http://org/fr/#x", "http://é.org/fr/é", "http://a..net/z", "http://net./z", "http://.net/z", "://net/z", "a://b://net/", "http:///net/", "http://net:80/x", "http://example.com/de/\n/x", "http://example.com/de\n", "http://u.example.com//de/",
    "http://" + "a." * 3000 + "net/" + "p/" * 50000, "http://org/fr/" + "\U0010ffff" * 50, "http://İ.net/", "x" * 100000,
]


def table(spark, urls):
    return spark.createDataFrame([(k, u, "h", "p", 5, "r") for k, u in enumerate(urls)], "page_id long, url string, host string, path string, id int, row string")


def test_against_sql_and_brute_force(spark):
    pages = table(spark, URLS + URLS[:9] + ["http://hot.example.net/en/1"] * 300)
    rules = spark.createDataFrame(urlrules.RULES, "host string, path string, verdict string")
    got = urlrules.judge(pages, rules, C.Scratch(spark, "t"))
    assert got.columns == ["page_id", "url", "id", "row", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, urlrules.RULES), r.url
    names, want = run_sql(urlrules.OP12_SQL, pages=pages.toArrow())
    assert canon(names, [tuple(r[n] for n in names) for r in rows]) == canon(names, want)


def test_many_nested_rules_over_many_ranges(spark):
    """Stacks that ranges hand on: deep nests of paths, hosts within hosts, ties, rules twice."""
    rng = random.Random(6)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "org", "a.org", "", "é.com"]
    path = lambda n: "/" + "".join(rng.choice("ab") for _ in range(n))
    rules = list({(rng.choice(hosts), path(rng.randrange(9)) if rng.random() < 0.9 else "") for _ in range(200)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules] + [("Z.com", "/q", "allow"), ("z.com", "/q", "block"), ("z.com", "/q", "allow")]
    urls = [f"http://{rng.choice(hosts[:6] + ['x.a.com', 'z.com', 'y.z.com', ''])}{path(rng.randrange(12))}" for _ in range(1500)] + ["http://y.z.com/q1", "x"]
    given = [r for r in rules if r[0] != "Z.com"] + [("z.com", "/q", "block")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = urlrules.judge(table(spark, urls), spark.createDataFrame(rules, "host string, path string, verdict string"), C.Scratch(spark, "t"), otherwise="block").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, given, "block"), r.url
    assert len({r.rule for r in rows}) > 80


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    got = urlrules.judge(table(spark, ["http://Net/x"]), rules, C.Scratch(spark, "t")).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [("net", "/x", None, "allow")]
    rules = spark.createDataFrame([(None, None, "block")], "host string, path string, verdict string")
    assert urlrules.judge(table(spark, []), rules, C.Scratch(spark, "t")).count() == 0
    assert [(r.rule, r.verdict) for r in urlrules.judge(table(spark, ["", "http://net/x", "http://net./x"]), rules, C.Scratch(spark, "t")).orderBy("page_id").collect()] == [("", "block"), (None, "allow"), ("", "block")]


def test_native(spark):
    """No Python in the plan, and one key of most rows is spread over ranges."""
    rules = spark.createDataFrame(urlrules.RULES, "host string, path string, verdict string")
    scratch = C.Scratch(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = urlrules.judge(spark.range(4000).select("id", urlrules.F.lit("http://a.example.net/en/1").alias("url")), rules, scratch)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoop"))
    ranges = spark.read.parquet(scratch.folder("sweep-stack")).groupBy("part").count().collect()
    assert max(r["count"] for r in ranges) < 0.6 * sum(r["count"] for r in ranges)
    assert out.groupBy("rule").count().collect() == [("example.net/en/", 4000)]

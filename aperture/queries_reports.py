"""More queries of the library: bundles of figures, both directions of retrieval, prompt banks, small joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from aperture.operators import bundles as U
from aperture.operators import callables as A
from aperture.operators import curves as K
from aperture.operators import metrics as M
from aperture.operators import ranges as G
from aperture.operators import probe as L_probe
from aperture.operators import prompts as W
from aperture.operators import resample as B
from aperture.operators import retrieval as R
from aperture.operators import tables as J
from aperture.plans import inputs as I
from aperture.queries import AUC, BY, CLASSES, CONF, DERIVED, DOCS, PAIRS, PER, PRUNED, SLIDES, _draws, _grid, _patients, _pred, query, rounded
from aperture.sources import loaders as L

# ------------------------------------------------------------------ bundles

AREAS = f"""bl AS (SELECT lang, p, n, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM pt), au AS (SELECT lang, {AUC} AS auroc FROM bl GROUP BY lang),
aq AS (SELECT pt.lang, p, tps, fps, sum(p) OVER (PARTITION BY pt.lang) AS ap FROM pt JOIN ro ON pt.lang = ro.lang AND pt.score = ro.threshold), pp AS (SELECT lang, sum(p * tps / (tps + fps)) / nullif(max(ap), 0)::DOUBLE AS aupr FROM aq GROUP BY lang)"""
FLOOR = "max((tpr >= {f}::DOUBLE, CASE WHEN tpr >= {f}::DOUBLE THEN spec ELSE tpr END, threshold, tpr, spec)) AS {n}"
POINTS_OF = f"op AS (SELECT lang, max((j, threshold, tpr, spec)) AS y, {FLOOR.format(f=0.9, n='a')}, {FLOOR.format(f=0.95, n='b')} FROM kp GROUP BY lang HAVING count(*) FILTER (j IS NULL) = 0)"
OF_OP = ", ".join(f"round({c}[{k}], 6) AS {n}_{x}" for c, n, o in (("y", "youden", 2), ("a", "sens90", 3), ("b", "sens95", 3)) for k, x in ((o, "thresh"), (o + 1, "sens"), (o + 2, "spec")))
SIZES = "count(*) AS n, count(*) FILTER (gt = 1) AS n_pos, count(*) FILTER (gt = 0) AS n_neg"


@query(f"""WITH {DOCS}, {PRUNED}, {AREAS}, {POINTS_OF}, x AS (SELECT lang, gt, score, coalesce(CASE WHEN doc_id % 3 = 0 THEN gt END, (score >= 0.5::DOUBLE)::INT) AS pred FROM s),
c AS (SELECT lang, {CONF}, {SIZES}, round(avg(score) FILTER (gt = 1), 6) AS mean_prob_pos, round(avg(score) FILTER (gt = 0), 6) AS mean_prob_neg FROM x GROUP BY lang)
SELECT c.*, {DERIVED}, round(auroc, 6) AS auroc, CASE WHEN n_pos > 0 AND n_neg > 0 THEN round(aupr, 6) END AS aupr, {OF_OP} FROM c LEFT JOIN au USING (lang) LEFT JOIN pp USING (lang) LEFT JOIN op USING (lang)""")
def probability_metrics(spark, d):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("gt").cast("string"), F.lit(".0"))).otherwise(F.lit(" "))
    return rounded(U.probability_metrics(I.doc_scores(spark, d).withColumn("pred", raw), ["lang"], "pred"))


FIXED = "round(CASE WHEN ok THEN {x} END, 6) AS {n}"
RATES = {
    "auroc": "auroc", "aupr": "aupr", "accuracy": "(tp + tn) / n::DOUBLE", "balanced_accuracy": "(tp / nullif(n_pos, 0)::DOUBLE + tn / nullif(n_neg, 0)::DOUBLE) / 2", "sensitivity": "tp / nullif(n_pos, 0)::DOUBLE",
    "specificity": "tn / nullif(n_neg, 0)::DOUBLE", "precision": "coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)", "f1": "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)",
}
FIXED_COLS = ", ".join(FIXED.format(x=x, n=n) for n, x in RATES.items())


@query(f"""WITH {DOCS}, {BY}, {AREAS}, x AS (SELECT lang, gt, (score >= 0.05::DOUBLE)::INT AS pred FROM s), c AS (SELECT lang, {CONF}, {SIZES}, count(*) FILTER (gt = 1) > 0 AND count(*) FILTER (gt = 0) > 0 AS ok FROM x GROUP BY lang)
SELECT lang, n, n_pos, n_neg, {FIXED_COLS} FROM c LEFT JOIN au USING (lang) LEFT JOIN pp USING (lang)""")
def fixed_threshold_metrics(spark, d):
    return rounded(U.fixed_threshold(I.doc_scores(spark, d), 0.05, ["lang"]))


BINARY = ", ".join(f"round({x}, 6) AS binary_{{n}}_{c}" for c, x in (("accuracy", "(tp + tn) / (tp + tn + fp + fn)::DOUBLE"), ("f1", RATES["f1"]), ("precision", RATES["precision"]), ("sensitivity", "tp / nullif(tp + fn, 0)::DOUBLE"), ("specificity", "tn / nullif(tn + fp, 0)::DOUBLE")))
BINARY += ", " + ", ".join(f"{c} AS binary_{{n}}_{c}" for c in M.COUNTS)


@query(f"""WITH {DOCS}, {PRUNED}, {AREAS}, {POINTS_OF}, f AS (SELECT lang, {CONF} FROM (SELECT lang, gt, (score >= 0.5::DOUBLE)::INT AS pred FROM s) GROUP BY lang), g AS (SELECT lang, {CONF} FROM (SELECT s.lang, gt, (score >= y[2])::INT AS pred FROM s JOIN op ON s.lang = op.lang) GROUP BY lang),
f2 AS (SELECT lang, 0.5::DOUBLE AS binary_0p5_threshold, {BINARY.format(n='0p5')} FROM f), g2 AS (SELECT lang, {BINARY.format(n='youden')} FROM g)
SELECT f2.*, round(auroc, 6) AS binary_auroc, round(y[2], 6) AS binary_youden_threshold, round(y[1], 6) AS binary_youden_j, g2.* EXCLUDE (lang) FROM f2 LEFT JOIN au USING (lang) LEFT JOIN op USING (lang) LEFT JOIN g2 USING (lang)""")
def binary_threshold_bundle(spark, d):
    return rounded(U.binary_thresholds(I.doc_scores(spark, d).select("lang", "gt", "score"), 2, ["lang"]))


@query(f"WITH {DOCS}, {BY}, a AS (SELECT lang, max(tps) AS p FROM ro GROUP BY lang) SELECT ro.lang, round(threshold, 6) AS threshold, round(tps / (tps + fps), 6) AS precision, round(coalesce(tps / nullif(p, 0), 1), 6) AS recall FROM ro JOIN a ON a.lang = ro.lang UNION ALL SELECT lang, NULL, 1.0, 0.0 FROM a")
def precision_recall_curve(spark, d):
    return rounded(K.precision_recall(I.doc_scores(spark, d), ["lang"]))


def _two(spark, d):
    return I.doc_scores(spark, d).withColumn("b", F.floor(F.col("score") * 50) / 50.0)


TWO = DOCS.replace("s AS (", "s0 AS (", 1) + ", s2 AS (SELECT *, floor(score * 50) / 50.0::DOUBLE AS b FROM s0)"


def _tables_sql() -> str:
    parts, more = [], []
    for name, c in (("fine", "score"), ("coarse", "b")):
        for key, tag in (("lang", "g"), ("'__overall__'", "o")):
            t = f"{name}_{tag}"
            more.append(f"""{t} AS (SELECT {key} AS lang, gt, {c} AS score FROM s2), {t}p AS (SELECT lang, score, sum(gt) AS p, sum(1 - gt) AS n FROM {t} GROUP BY ALL),
{t}w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(p) OVER z AS tps, sum(p + n) OVER z AS seen FROM {t}p WINDOW z AS (PARTITION BY lang ORDER BY score DESC)),
{t}a AS (SELECT lang, {AUC} AS auroc, sum(p * tps / seen::DOUBLE) / nullif(sum(p), 0)::DOUBLE AS aupr FROM {t}w GROUP BY lang),
{t}c AS (SELECT lang, {CONF}, {SIZES}, count(*) FILTER (gt = 1) > 0 AND count(*) FILTER (gt = 0) > 0 AS ok FROM (SELECT *, (score >= 0.05::DOUBLE)::INT AS pred FROM {t}) GROUP BY lang)""")
            parts.append(f"SELECT lang, '{name}' AS pooling, n, n_pos, n_neg, {FIXED_COLS} FROM {t}c JOIN {t}a USING (lang)")
    return f"WITH {TWO}, {', '.join(more)} {' UNION ALL '.join(parts)}"


@query(_tables_sql())
def pooling_group_tables(spark, d):
    return rounded(U.grouped_tables(_two(spark, d), "lang", {"fine": "score", "coarse": "b"}, 0.05))


@query(f"WITH {CLASSES}, {PER} SELECT " + ", ".join(f"max({x}) FILTER (class_id = {k}) AS {c}__{k}" for c, x in (("f1", "round(coalesce(2.0 * tp / nullif(support + predicted, 0)::DOUBLE, 0), 6)"), ("predicted", "predicted"), ("support", "support")) for k in range(10)) + " FROM pc")
def wide_class_f1(spark, d):
    return rounded(M.wide_f1(M.per_class(_pred(spark, d), spark.range(10).withColumnRenamed("id", "class_id")), 10))


# ------------------------------------------------------------------ comparisons with intervals


def _draws_sql(of: str, cluster: str, reps: int) -> str:
    return f"""cl AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS ix FROM (SELECT DISTINCT {cluster}::VARCHAR AS c FROM {of})), nc AS (SELECT count(*) AS n FROM cl),
dr AS (SELECT (r // n)::INT AS rep, ('0x' || substr(md5('b' || r), 1, 15))::BIGINT % n AS d FROM (SELECT n, unnest(range({reps} * n)) AS r FROM nc)), w AS (SELECT rep, c, count(*) AS weight FROM dr JOIN cl ON d = ix GROUP BY ALL)"""


@query(f"""WITH {DOCS}, {_draws_sql('s', 'doc_id', 20)}, x AS (SELECT rep, score, sum(CASE WHEN gt = 1 THEN weight ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN gt = 0 THEN weight ELSE 0 END)::DOUBLE AS n FROM s JOIN w ON doc_id::VARCHAR = c GROUP BY ALL),
bl AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY rep ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM x), st AS (SELECT rep, {AUC} AS auroc FROM bl GROUP BY rep)
SELECT round(quantile_cont(auroc, 0.025), 6) AS lo, round(quantile_cont(auroc, 0.975), 6) AS hi, count(auroc) AS n_valid FROM st""")
def row_bootstrap_auroc(spark, d):
    """Rows themselves are the units of resampling."""
    t = I.doc_scores(spark, d)
    w = B.row_draws(t, "doc_id", 20)
    both = t.withColumn("own", F.col("doc_id").cast("string")).join(w, F.col("own") == F.col("cluster"))
    return rounded(B.interval(K.auroc(both, ["rep"], "weight"), "auroc"))


COMPARED = f"""{DOCS}, o AS (SELECT *, 'coarse' AS model, floor(score * 50) / 50.0::DOUBLE AS b, 0.06::DOUBLE AS tb, 0 AS g2 FROM s UNION ALL SELECT *, 'turned', (doc_id * 37 % 100) / 100.0::DOUBLE, 0.5::DOUBLE, 0 FROM s),
both_ AS (SELECT lang AS tab, model, source, gt, score AS a, b, 0.05::DOUBLE AS ta, tb FROM o WHERE NOT (model = 'turned' AND doc_id % 11 = 0)),
{_draws_sql('both_', 'source', 50)}, w1 AS (SELECT rep, c, weight FROM w UNION ALL SELECT -1, c, 1 FROM cl), j AS (SELECT b.*, rep, weight FROM both_ b JOIN w1 ON source::VARCHAR = c)"""


def _side(c: str) -> str:
    return f"""{c}x AS (SELECT tab, model, rep, {c} AS score, sum(CASE WHEN gt = 1 THEN weight ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN gt = 0 THEN weight ELSE 0 END)::DOUBLE AS n FROM j GROUP BY ALL),
{c}b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY tab, model, rep ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {c}x), {c}u AS (SELECT tab, model, rep, {AUC} AS auroc FROM {c}b GROUP BY ALL),
{c}k AS (SELECT tab, model, rep, (sum(CASE WHEN gt = 1 AND {c} >= t{c} THEN weight ELSE 0 END) / nullif(sum(CASE WHEN gt = 1 THEN weight ELSE 0 END), 0)::DOUBLE + sum(CASE WHEN gt = 0 AND {c} < t{c} THEN weight ELSE 0 END) / nullif(sum(CASE WHEN gt = 0 THEN weight ELSE 0 END), 0)::DOUBLE) / 2 AS bal FROM j GROUP BY ALL)"""


@query(f"""WITH {COMPARED}, {_side('a')}, {_side('b')}, m AS (SELECT au.tab, au.model, au.rep, unnest([{{'metric': 'auroc', 'd': au.auroc - bu.auroc}}, {{'metric': 'balanced_accuracy', 'd': ak.bal - bk.bal}}]) AS x FROM au JOIN bu USING (tab, model, rep) JOIN ak USING (tab, model, rep) JOIN bk USING (tab, model, rep)),
z AS (SELECT tab, model, x.metric AS metric, count(x.d) AS n_valid, CASE WHEN count(x.d) > 0 THEN least(1, 2 * least((count(*) FILTER (x.d <= 0) + 1) / (count(x.d) + 1)::DOUBLE, (count(*) FILTER (x.d >= 0) + 1) / (count(x.d) + 1)::DOUBLE)) END AS p_value, quantile_cont(x.d, 0.025) AS lo, quantile_cont(x.d, 0.975) AS hi FROM m WHERE rep >= 0 GROUP BY ALL),
h AS (SELECT *, (count(p_value) OVER (PARTITION BY tab, metric) - row_number() OVER q + 1) * p_value AS step FROM z WINDOW q AS (PARTITION BY tab, metric ORDER BY p_value, model))
SELECT h.tab AS "table", h.model, h.metric, round(x.d, 6) AS delta, round(p_value, 6) AS p_value, n_valid, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN p_value IS NOT NULL THEN round(least(1, max(step) OVER (PARTITION BY h.tab, h.metric ORDER BY p_value, h.model)), 6) END AS p_holm
FROM h JOIN m ON m.rep = -1 AND m.tab = h.tab AND m.model = h.model AND m.x.metric = h.metric""")
def model_comparison(spark, d):
    """A reference model against two others on slides that they share and label alike; a fourth has no threshold."""
    t = I.doc_scores(spark, d).select(F.col("lang").alias("table"), F.lit("g").alias("grp"), F.col("doc_id").alias("slide"), "source", "gt", "score")
    k = F.col("slide")
    other = lambda name, gt, score: t.select("table", F.lit(name).alias("model"), "grp", "slide", gt.alias("gt"), score.alias("score"))
    gt = F.col("gt")
    others = other("coarse", gt, F.floor(F.col("score") * 50) / 50.0)
    others = others.unionByName(other("turned", F.when(k % 11 == 0, 1 - gt).otherwise(gt), (k * 37 % 100) / 100.0)).unionByName(other("unlocked", gt, F.col("score")))
    thresholds = spark.createDataFrame([("own", 0.05), ("coarse", 0.06), ("turned", 0.5)], "model string, threshold double")
    return rounded(U.compare_models(t, others, thresholds, "source", 50, "own"))


# ------------------------------------------------------------------ retrieval


@query(f"""WITH {PAIRS}, b AS (SELECT q.i, max(list_dot_product(q.im, c.tx)) AS best FROM pq q JOIN pq c ON q.label = c.label GROUP BY q.i)
SELECT q.i AS query_id, 1 + count(*) FILTER (list_dot_product(q.im, c.tx) > b.best + 1e-12) AS group_rank FROM pq q JOIN b ON b.i = q.i, pq c GROUP BY q.i""")
def same_group_ranks(spark, d):
    p = I.pairs(spark, d)
    q = p.select(F.col("pair_index").alias("query_id"), F.col("image_emb").alias("vec"), F.col("pair_index").alias("pos"), F.col("group_id").alias("grp"))
    return R.ranks(q, p.select(F.col("pair_index").alias("cand_id"), F.col("text_emb").alias("vec"), F.col("group_id").alias("grp"))).select("query_id", "group_rank")


def _pool_sql(name: str, of: str, key: str, source: str = "pq") -> str:
    return f"""{name}m AS (SELECT {key} AS k, pos, avg({of}[pos]) AS m FROM {source}, range(1, 65) t(pos) GROUP BY ALL), {name}v AS (SELECT k, list(m ORDER BY pos) AS v FROM {name}m GROUP BY k),
{name}f AS (SELECT {key} AS k, min(i) AS cand, arg_min(label, i) AS grp FROM {source} GROUP BY ALL), {name} AS (SELECT k, cand, grp, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM {name}v JOIN {name}f USING (k))"""


def _direction(name: str, own: str, pool: str, key: str, source: str = "pq") -> str:
    return f"""{name}p AS (SELECT q.i, any_value(q.label) AS label, any_value(c.cand) AS pos, any_value(list_dot_product(q.{own}, c.v)) AS at FROM {source} q JOIN {pool} c ON c.k = {key} GROUP BY q.i),
{name}g AS (SELECT q.i, max(list_dot_product(q.{own}, c.v)) AS best FROM {source} q JOIN {pool} c ON q.label = c.grp GROUP BY q.i),
{name} AS (SELECT q.i, any_value(p.at) AS at, 1 + count(*) FILTER (c.cand <> p.pos AND list_dot_product(q.{own}, c.v) > p.at + 1e-12) AS r, CASE WHEN any_value(g.best) IS NOT NULL THEN 1 + count(*) FILTER (list_dot_product(q.{own}, c.v) > g.best + 1e-12) END AS gr
  FROM {source} q JOIN {name}p p ON p.i = q.i LEFT JOIN {name}g g ON g.i = q.i, {pool} c GROUP BY q.i)"""


BOTH = f"""{PAIRS}, {_pool_sql('ip', 'im', 'i // 2')}, {_pool_sql('tp', 'tx', 'i // 5')}, {_direction('i2t', 'im', 'tp', 'q.i // 5')}, {_direction('t2i', 'tx', 'ip', 'q.i // 2')},
rr AS (SELECT a.i, a.r AS i2t, b.r AS t2i, a.gr AS i2t_group, b.gr AS t2i_group, (a.at + b.at) / 2 AS cosine FROM i2t a JOIN t2i b USING (i))"""


def _both(spark, d):
    return R.both_directions(I.pairs(spark, d).withColumn("caption_id", F.floor(F.col("pair_index") / 5).cast("string")))


@query(f"WITH {BOTH} SELECT i AS pair_index, i2t AS i2t_rank, i2t_group AS i2t_group_rank, t2i AS t2i_rank, t2i_group AS t2i_group_rank, round(cosine, 6) AS cosine FROM rr")
def retrieval_both_ways(spark, d):
    return rounded(_both(spark, d)["pairs"])


def _summary_sql(directions: tuple[str, ...]) -> str:
    return ", ".join(f"round(median({x}), 6) AS {x}_median_rank, round(avg({x}), 6) AS {x}_mean_rank, round(avg(1.0::DOUBLE / {x}), 6) AS {x}_mrr, " + ", ".join(f"round(avg(({x} <= {k})::INT), 6) AS {x}_recall_{k}" for k in (1, 5, 10)) for x in directions)


NON = """k AS (SELECT max(i) + 1 AS n FROM pq), sm AS (SELECT range AS s, ('0x' || substr(md5('i' || range), 1, 15))::BIGINT AS x, ('0x' || substr(md5('j' || range), 1, 15))::BIGINT AS y FROM range(2000)),
dd AS (SELECT s, x % n AS i, y % (n - 1) AS j FROM sm, k), ee AS (SELECT s, i, j + (j >= i)::INT AS j FROM dd), nm AS (SELECT avg(list_dot_product(a.im, b.tx)) AS m FROM ee JOIN pq a ON a.i = ee.i JOIN pq b ON b.i = ee.j)"""


@query(f"""WITH {BOTH}, {NON}, s AS (SELECT count(*) AS n_pairs, {_summary_sql(('i2t', 't2i', 'i2t_group', 't2i_group'))}, avg(cosine) AS c, stddev_pop(cosine) AS cs FROM rr)
SELECT (SELECT count(*) FROM ip) AS n_images, (SELECT count(*) FROM tp) AS n_texts, true AS deduplicated, s.* EXCLUDE (c, cs), round(c, 6) AS cosine_mean, round(cs, 6) AS cosine_std, round(m, 6) AS nonmatch_mean, round(c - m, 6) AS matched_minus_nonmatch FROM s, nm""")
def retrieval_report(spark, d):
    return rounded(R.retrieval_summary(_both(spark, d), R.nonmatches(I.pairs(spark, d), 2000, *_draws())))


@query(f"""WITH {PAIRS}, ps AS (SELECT i, list_dot_product(im, tx) AS at FROM pq), q AS (SELECT * FROM pq ORDER BY md5('42' || i), i LIMIT 20),
r AS (SELECT q.i, 1 + count(*) FILTER (c.i <> q.i AND list_dot_product(q.im, c.tx) > ps.at + 1e-12) AS rank FROM q JOIN ps ON ps.i = q.i, pq c GROUP BY q.i),
x AS (SELECT q.i AS query_id, c.i AS cand_id, list_dot_product(q.im, c.tx) AS sim FROM q, pq c), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, cand_id) AS place FROM x)
SELECT query_id, rank AS true_rank, place, cand_id, round(sim, 6) AS score, (query_id = cand_id)::INT AS is_exact_pair, (query_id // 4 = cand_id // 4)::INT AS is_same_file FROM t JOIN r ON r.i = query_id WHERE place <= 5""")
def retrieval_examples(spark, d):
    p = I.pairs(spark, d)
    q = R.sampled_queries(p, 20).select(F.col("pair_index").alias("query_id"), F.col("image_emb").alias("vec"), F.col("pair_index").alias("pos"))
    c = p.select(F.col("pair_index").alias("cand_id"), F.col("text_emb").alias("vec"))
    files = p.select("pair_index", F.floor(F.col("pair_index") / 4).alias("file_id"))
    return rounded(R.top_k_report(q, c, 5, files, R.ranks(q, c)))


@query(f"""WITH {PAIRS}, {_pool_sql('si', 'im', 'i % 40')}, {_pool_sql('st', 'tx', 'i % 40')}, ws AS MATERIALIZED (SELECT si.cand AS i, si.k, si.v AS im, st.v AS tx FROM si JOIN st USING (k)),
a AS (SELECT q.i, any_value(list_dot_product(q.im, q.tx)) AS at, 1 + count(*) FILTER (c.i <> q.i AND list_dot_product(q.im, c.tx) > list_dot_product(q.im, q.tx) + 1e-12) AS i2t_rank, 1 + count(*) FILTER (c.i <> q.i AND list_dot_product(q.tx, c.im) > list_dot_product(q.tx, q.im) + 1e-12) AS t2i_rank FROM ws q, ws c GROUP BY q.i)
SELECT ws.k::VARCHAR AS slide, n AS n_patches, i2t_rank, t2i_rank, round(a.at, 6) AS cosine FROM a JOIN ws ON ws.i = a.i JOIN (SELECT i % 40 AS k, count(*) AS n FROM pq GROUP BY 1) z ON z.k = ws.k""")
def slide_retrieval(spark, d):
    pooled = R.pool_pairs(I.pairs(spark, d).withColumn("slide", (F.col("pair_index") % 40).cast("string")), "slide")
    found = R.both_directions(pooled)["pairs"]
    return rounded(pooled.select("pair_index", "slide", "n_patches").join(found, "pair_index").select("slide", "n_patches", "i2t_rank", "t2i_rank", "cosine"))


# ------------------------------------------------------------------ prompts and vectors

RICH = "rt(o, t) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(W.RICH_TEMPLATES)) + ")"
SHORT = "st(o, key, t) AS (VALUES " + ", ".join(f"({i}, '{k}', '{t}')" for i, (k, t) in enumerate(W.TEMPLATES.items())) + ")"
NAMES = "nm AS (SELECT 'd' || (p_partkey % 2) AS dataset, p_partkey % 7 AS class_id, p_size % 4 AS v_ord, CASE WHEN p_size % 4 = 0 THEN 'canonical' ELSE 'v' || (p_size % 4) END AS variant, min(p_brand) AS name FROM part GROUP BY ALL)"


def _names(spark, d):
    v = F.col("p_size") % 4
    t = I.read(spark, d, "part").groupBy(F.concat(F.lit("d"), (F.col("p_partkey") % 2).cast("string")).alias("dataset"), (F.col("p_partkey") % 7).alias("class_id"), v.cast("long").alias("v_ord"))
    t = t.agg(F.min("p_brand").alias("name"))
    return t.withColumn("variant", F.when(F.col("v_ord") == 0, "canonical").otherwise(F.concat(F.lit("v"), F.col("v_ord").cast("string"))))


@query(f"""WITH {NAMES}, {RICH}, {SHORT}, f AS (SELECT dataset, class_id, name, min(v_ord) AS v FROM nm GROUP BY ALL), y AS (SELECT *, row_number() OVER (PARTITION BY dataset, class_id ORDER BY v, name) - 1 AS s FROM f)
SELECT 'rich' AS bank, dataset, class_id, (s * 22 + o)::BIGINT AS place, replace(t, 'CLASSNAME', name) AS prompt FROM y, rt
UNION ALL SELECT 'rich_canonical', dataset, class_id, o, replace(t, 'CLASSNAME', name) FROM nm, rt WHERE variant = 'canonical' UNION ALL SELECT 'canonical', dataset, class_id, o, replace(t, '{{}}', name) FROM nm, st WHERE variant = 'canonical'""")
def named_banks(spark, d):
    n, out = _names(spark, d), None
    for name, bank in (("rich", W.rich_bank), ("rich_canonical", W.rich_canonical_bank), ("canonical", W.canonical_bank)):
        one = bank(n).withColumn("bank", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {NAMES}, {SHORT} SELECT dataset, key AS template_key, variant, class_id, replace(t, '{{}}', name) AS prompt FROM nm, st")
def prompt_sweep(spark, d):
    return W.prompt_sweep(_names(spark, d), W.short_templates(spark))


WORDS = "wd(o2, variant, neg, pos) AS (VALUES " + ", ".join(f"({i}, '{v}', '{a}', '{b}')" for i, (v, (a, b)) in enumerate(W.VOCABULARIES["melanoma_agnostic"].items())) + ")"


def _pairs(spark):
    return W.prompt_pairs(W.vocabulary(spark, "melanoma_agnostic"), W.short_templates(spark))


@query(f"""WITH {SHORT}, w AS (SELECT *, row_number() OVER (ORDER BY p_name, p_type) - 1 AS o2 FROM (SELECT DISTINCT p_name, p_type FROM part))
SELECT (o2 * 6 + o)::BIGINT AS pair, key AS template_key, p_name AS variant, replace(t, '{{}}', p_type) AS negative, replace(t, '{{}}', p_name) AS positive FROM w, st""")
def slide_prompt_pairs(spark, d):
    """A pair of prompts for each template and each pair of words that the table has: a part's type against its name."""
    words = I.read(spark, d, "part").select("p_name", "p_type").distinct()
    words = G.numbered(words, [], ["p_name", "p_type"], "v_ord").select("v_ord", F.col("p_name").alias("variant"), F.col("p_type").alias("negative"), F.col("p_name").alias("positive"))
    return W.prompt_pairs(words, W.short_templates(spark))


def _matrix(spark, d):
    each = _pairs(spark).select((F.col("pair") * 2).alias("r"), "negative", "positive")
    each = each.select("r", F.col("negative").alias("prompt")).union(each.select(F.col("r") + 1, "positive"))
    vectors = each.join(I.read(spark, d, "embeddings"), F.col("r") == F.col("vec_id")).select("prompt", F.col("embedding").alias("vec"))
    return W.text_matrix(_pairs(spark), vectors)


MATRIX = """e AS (SELECT vec_id AS r, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS v FROM embeddings WHERE vec_id < 36),
em AS (SELECT r % 2 AS side, pos, avg(v[pos]) AS m FROM e, range(1, 65) t(pos) GROUP BY ALL), ev AS (SELECT side, list(m ORDER BY pos) AS v FROM em GROUP BY side),
mx AS (SELECT r AS "row", 'prompt' AS kind, v FROM e UNION ALL SELECT 36 + side, 'ensemble', list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8)) FROM ev)"""


@query(f'WITH {MATRIX} SELECT "row", kind, round(v[1], 6) AS x0, round(v[64], 6) AS x63 FROM mx')
def wide_prompt_matrix(spark, d):
    return rounded(_matrix(spark, d).select("row", "kind", F.col("vec")[0].alias("x0"), F.col("vec")[63].alias("x63")))


@query(f"""WITH {MATRIX} SELECT vec_id AS tile_ix, (a."row" // 2)::BIGINT AS pair, round(1 / (1 + exp(list_dot_product(embedding::DOUBLE[], a.v) - list_dot_product(embedding::DOUBLE[], b.v))), 6) AS prob FROM embeddings, mx a JOIN mx b ON b."row" = a."row" + 1 WHERE a."row" % 2 = 0""")
def tile_prompt_grid(spark, d):
    return rounded(W.pair_grid(I.tiles(spark, d).select("tile_ix", "embedding"), _matrix(spark, d)))


@query("""WITH m AS (SELECT vec_id % 50 AS item, pos, avg(embedding[pos]::DOUBLE) AS m FROM embeddings, range(1, 65) t(pos) GROUP BY ALL), v AS (SELECT item, list(m ORDER BY pos) AS v FROM m GROUP BY item)
SELECT item, n AS n_texts, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS x0, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS x63 FROM v JOIN (SELECT vec_id % 50 AS item, count(*) AS n FROM embeddings GROUP BY 1) USING (item)""")
def pooled_texts(spark, d):
    t = J.pool_texts(I.read(spark, d, "embeddings").withColumn("item", F.col("vec_id") % 50), "item", "embedding")
    return rounded(t.select("item", "n_texts", F.col("vec")[0].alias("x0"), F.col("vec")[63].alias("x63")))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0")
def valid_cache_rows(spark, d):
    e = I.read(spark, d, "embeddings")
    spoilt = F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 3)).when(F.col("vec_id") % 9 == 3, F.array().cast("array<float>")).when(F.col("vec_id") % 9 == 6, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))
    return L.valid_cache(e.withColumn("embedding", spoilt)).select("vec_id")


# ------------------------------------------------------------------ tiles, joins, filters


@query("""WITH t AS (SELECT p_partkey AS k, y, x FROM (SELECT p_partkey, p_size * 100 AS h FROM part), range(0, 100000, 256) a(y), range(0, 1024, 256) b(x) WHERE y + 256 <= h AND x + 256 <= 1000), m AS (SELECT p_partkey AS k, p_size % 5 AS cy, p_partkey % 2 AS cx FROM part)
SELECT t.k, y, x FROM t JOIN m ON m.k = t.k AND y < (cy + 1) * 500 AND y + 256 > cy * 500 AND x < (cx + 1) * 500 AND x + 256 > cx * 500""")
def region_tiles(spark, d):
    p = I.read(spark, d, "part")
    cells = p.select(F.col("p_partkey").alias("k"), (F.col("p_size") % 5).alias("cy"), (F.col("p_partkey") % 2).alias("cx"))
    return J.in_region(_grid(p), cells, 256, 500, "k")


@query("SELECT o_orderkey AS k, CASE WHEN o_custkey % 5 = 0 THEN 'calibration' ELSE 'holdout' END AS split FROM orders")
def split_lookup(spark, d):
    s = I.read(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"), F.when(F.col("c_custkey") % 5 == 0, "calibration").otherwise("holdout").alias("split"))
    return J.with_split(I.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("patient_id")), s).select("k", "split")


@query("SELECT o_orderkey AS k, o_totalprice > 100000 AS hit, 100000::DOUBLE AS threshold FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT o_orderkey, o_totalprice > 200000, 200000 FROM orders WHERE o_orderpriority LIKE '2%'")
def threshold_lookup(spark, d):
    at = spark.createDataFrame([("1", 100000.0), ("2", 200000.0), ("3", None)], "model string, threshold double")
    o = I.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.substring("o_orderpriority", 1, 1).alias("model"), "o_totalprice")
    return J.with_threshold(o, at).select("k", (F.col("o_totalprice") > F.col("threshold")).alias("hit"), "threshold")


@query("SELECT a.s_suppkey AS query_id, b.s_suppkey AS cand_id FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
def same_group_candidates(spark, d):
    s = I.read(spark, d, "supplier")
    return J.same_group(s.select(F.col("s_suppkey").alias("query_id"), F.col("s_nationkey").alias("grp")), s.select(F.col("s_suppkey").alias("cand_id"), F.col("s_nationkey").alias("grp")))


@query("SELECT o_orderkey AS k, md5(o_orderpriority) AS code FROM orders")
def encoded_once(spark, d):
    o = I.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    return J.encoded_once(o, "o_orderpriority", lambda t: t.withColumn("code", F.md5("o_orderpriority"))).select("k", "code")


@query("SELECT c_custkey AS k FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey % 3 = c_custkey % 3 AND c_custkey % 4 <> 1")
def allowed_agreeing_evaluable(spark, d):
    c = I.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("group"), (F.col("c_nationkey") % 3).alias("a"), (F.col("c_custkey") % 3).alias("b"), (F.col("c_custkey") % 4 != 1).alias("evaluable"))
    return J.if_evaluable(J.agreeing(J.only_groups(c, ["BUILDING", "MACHINERY"]), "a", "b")).select("k")


@query(f"""WITH {SLIDES}, p AS (SELECT patient, any_value(grp) AS grp, CASE WHEN sum(gt) = 0 THEN 'negative_only' WHEN sum(gt) = count(*) THEN 'positive_only' ELSE 'mixed' END AS pattern FROM s GROUP BY patient) SELECT grp, pattern, count(*) AS n FROM p GROUP BY ALL""")
def patient_strata(spark, d):
    return J.strata(_patients(spark, d), "grp", "pattern", least=1)


@query("""WITH m AS (SELECT c_mktsegment AS grp, c_name AS slide, arg_max('P' || c_custkey % 9, c_custkey) AS pid FROM customer WHERE c_custkey % 4 <> 0 GROUP BY ALL)
SELECT c_mktsegment AS "group", count(*) AS n, count(*) FILTER (m.pid IS NULL) AS missed FROM customer LEFT JOIN m ON c_mktsegment = m.grp AND c_name = m.slide GROUP BY ALL""")
def missed_patients(spark, d):
    c = I.read(spark, d, "customer")
    slides = c.select(F.col("c_mktsegment").alias("group"), F.col("c_name").alias("slide"))
    known = c.where("c_custkey % 4 <> 0").select(F.col("c_mktsegment").alias("group"), F.col("c_name").alias("slide"), F.concat(F.lit("P"), (F.col("c_custkey") % 9).cast("string")).alias("patient_id"), "c_custkey")
    return J.missed_by_group(J.join_patients(slides, known, "ext", "c_custkey"))


# ------------------------------------------------------------------ functions that users bring


def _letters():
    """An encoder of texts: how many of a text's characters have each code modulo 8."""
    import numpy as np

    return lambda texts: np.array([np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % 8, minlength=8) for t in texts], float)


_CODES = "list_transform(range(8), lambda k: len(list_filter(string_split({}, ''), lambda c: unicode(c) % 8 = k))::DOUBLE)"


@query(f"""WITH c AS (SELECT n_regionkey AS class_id, {_CODES.format('n_name')} AS v FROM nation), m AS (SELECT class_id, i, avg(v[i]) AS m FROM c, range(1, 9) t(i) GROUP BY ALL), w AS (SELECT class_id, list(m ORDER BY i) AS v FROM m GROUP BY class_id),
u AS (SELECT class_id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8)) AS v FROM w), e AS (SELECT DISTINCT p_name AS name, {_CODES.format('p_name')} AS v FROM part),
l AS (SELECT name, class_id, list_dot_product(e.v, u.v) AS z FROM e, u), p AS (SELECT *, exp(0.25::DOUBLE * (z - max(z) OVER q)) AS x FROM l WINDOW q AS (PARTITION BY name))
SELECT name, arg_max(class_id, (z, -class_id)) AS pred, round(max(x) / sum(x), 6) AS prob FROM p GROUP BY name""")
def injected_encoder(spark, d):
    """Part names classified by the regions whose nations' names are nearest, with an encoder that the caller brings."""
    encoder = A.Encoder(_letters)
    names = I.read(spark, d, "part").select(F.col("p_name").alias("item_id")).distinct()
    prompts = I.read(spark, d, "nation").select(F.col("n_regionkey").alias("class_id"), F.col("n_name").alias("text"))
    scores = A.zero_shot(encoder.encode(names, "item_id", "embedding"), prompts, encoder, temperature=0.25)
    best = F.max(F.struct("logit", -F.col("class_id"), "prob")).alias("m")
    return rounded(scores.groupBy(F.col("item_id").alias("name")).agg(best).select("name", (-F.col("m.col2")).cast("int").alias("pred"), F.col("m.prob").alias("prob")))


@query(f"""WITH {DOCS}, {_draws_sql('s', 'source', 100)}, x AS (SELECT lang, rep, sum(weight * (score - gt) ** 2) / sum(weight) AS brier, sum(weight * (score - gt)) / sum(weight) AS bias FROM s JOIN w ON source = c GROUP BY ALL)
SELECT lang, round(quantile_cont(brier, 0.025), 6) AS brier_lo, round(quantile_cont(brier, 0.975), 6) AS brier_hi, round(quantile_cont(bias, 0.025), 6) AS bias_lo, round(quantile_cont(bias, 0.975), 6) AS bias_hi, count(brier) AS n_valid FROM x GROUP BY lang""")
def custom_statistic_intervals(spark, d):
    """Intervals of two statistics that the caller brings as sums over rows: mean squared error and bias, by language."""
    import numpy as np

    parts = lambda c: np.stack([(c["score"] - c["gt"]) ** 2, c["score"] - c["gt"], np.ones(len(c["gt"]))], 1)
    final = lambda s: {"brier": s[0] / s[2], "bias": s[1] / s[2]} if s[2] else {}
    t = A.bootstrap_sums(I.doc_scores(spark, d), "source", 100, parts, final, ["brier", "bias"], ["lang"], ["score", "gt"])
    return rounded(B.intervals(t, ["brier", "bias"], "lang", require="brier"))


@query("SELECT o_orderkey AS query_id, count(c.c_custkey) AS n FROM orders LEFT JOIN customer c ON c_nationkey = o_custkey % 30 GROUP BY 1")
def same_group_counts(spark, d):
    o, c = I.read(spark, d, "orders"), I.read(spark, d, "customer")
    return J.same_group_counts(o.select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 30).alias("grp")), c.select(F.col("c_custkey").alias("cand_id"), F.col("c_nationkey").alias("grp")))


# ------------------------------------------------------------------ linear probes


def _probed(spark, d):
    e = I.read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 3).alias("grp"), "label", F.col("embedding").alias("whole"), F.slice("embedding", 1, 8).alias("part"))


@query("""WITH g AS (SELECT vec_id // 3 AS u, label, count(*) AS n FROM embeddings GROUP BY ALL), m AS (SELECT u, arg_max(label, (n, -label)) AS y FROM g GROUP BY u),
r AS (SELECT u, y, row_number() OVER (PARTITION BY y ORDER BY ('0x' || substr(md5('0' || u), 1, 15))::BIGINT, u) - 1 AS ix FROM m)
SELECT vec_id AS id, label, ((ix + ('0x' || substr(md5('y' || y), 1, 15))::BIGINT % 5) % 5)::INT AS fold FROM embeddings JOIN r ON u = vec_id // 3""")
def probe_folds(spark, d):
    """Groups of three vectors in five stratified folds."""
    return L_probe.folds(_probed(spark, d), "label", 5, "grp")[0].select("id", "label", "fold")


@query()
def paired_probe(spark, d):
    """Balanced accuracy of whole vectors against their first eight components, in each of five folds; held against a NumPy solution by a test."""
    return L_probe.paired_probe(_probed(spark, d), "label", "whole", "part", 5, "grp")

"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from aperture.functions import scalars as S
from aperture.functions import text as T
from aperture.functions import vectors as V
from aperture.operators import curves as K
from aperture.operators import bundles as U
from aperture.operators import metrics as M
from aperture.operators import prompts as W
from aperture.operators import resample as B
from aperture.operators import retrieval as R
from aperture.operators import scoring as P
from aperture.operators import tables as J
from aperture.plans import inputs as I
from aperture.sources import loaders as L

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


rounded = J.rounded


# ------------------------------------------------------------------ common parts of the SQL

CLASSES = """p AS (SELECT label AS class_id, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 10 = 0),
pm AS (SELECT class_id, i, avg(vec[i]) AS m FROM p, range(1, 65) t(i) GROUP BY class_id, i),
pv AS (SELECT class_id, list(m ORDER BY i) AS v FROM pm GROUP BY class_id),
cv AS (SELECT class_id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-8)) AS cvec FROM pv),
it AS (SELECT vec_id AS item_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 10 <> 0),
lg AS (SELECT item_id, label, class_id, list_dot_product(e, cvec) AS logit FROM it, cv),
pr AS (SELECT item_id, any_value(label) AS label, arg_max(class_id, (logit, -class_id)) AS pred FROM lg GROUP BY item_id)"""
DOCS = """s AS (SELECT l.doc_id, d.lang, d.source, l.quality AS gt, floor(d.n_chars / 50) / 1000.0::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id))"""
SLIDES = """s AS (SELECT o_orderkey AS slide, o_custkey AS patient, c_mktsegment AS grp, (o_orderstatus = 'F')::INT AS gt, floor(o_totalprice / 100) / 6000.0::DOUBLE AS score FROM orders JOIN customer ON o_custkey = c_custkey)"""
CONF = "count(*) FILTER (gt = 1 AND pred = 1) AS tp, count(*) FILTER (gt = 0 AND pred = 0) AS tn, count(*) FILTER (gt = 0 AND pred = 1) AS fp, count(*) FILTER (gt = 1 AND pred = 0) AS fn"
DERIVED = """round((tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE, 6) AS accuracy, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS sensitivity,
round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS specificity, round(tn / nullif(tn + fn, 0)::DOUBLE, 6) AS npv, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1, round((tp / nullif(tp + fn, 0)::DOUBLE + tn / nullif(tn + fp, 0)::DOUBLE) / 2, 6) AS balanced_accuracy"""
POINTS = """pt AS (SELECT {k} score, sum(gt) AS p, sum(1 - gt) AS n FROM s GROUP BY {k} score),
rc AS (SELECT {k} score AS threshold, sum(p) OVER w AS tps, sum(n) OVER w AS fps, sum(p) OVER a AS ap, sum(n) OVER a AS an FROM pt WINDOW w AS ({pk} ORDER BY score DESC), a AS ({pk})),
ro AS (SELECT {k} threshold, tps / nullif(ap, 0)::DOUBLE AS tpr, fps / nullif(an, 0)::DOUBLE AS fpr, tps::DOUBLE AS tps, fps::DOUBLE AS fps FROM rc)"""
FLAT = POINTS.format(k="", pk="")
BY = POINTS.format(k="lang,", pk="PARTITION BY lang")
PRUNED = BY + """,
kk AS (SELECT *, lead(tps) OVER w - 2 * tps + lag(tps) OVER w AS a, lead(fps) OVER w - 2 * fps + lag(fps) OVER w AS b FROM ro WINDOW w AS (PARTITION BY lang ORDER BY threshold DESC)),
kp AS (SELECT lang, threshold, tpr, fpr, tpr - fpr AS j, 1 - fpr AS spec FROM kk WHERE a IS NULL OR a <> 0 OR b <> 0 UNION ALL SELECT DISTINCT lang, 'inf'::DOUBLE, 0.0, 0.0, 0.0, 1.0 FROM s)"""
AUC = "sum(p * (below + 0.5::DOUBLE * n)) / nullif(sum(p) * sum(n), 0)::DOUBLE"
PAIRS = """n AS (SELECT count(*) AS n FROM embeddings),
raw AS (SELECT e.vec_id AS i, e.label, e.embedding::DOUBLE[] AS a, list_transform(list_zip(e.embedding, o.embedding), lambda z: z[1]::DOUBLE * 0.2::DOUBLE + z[2]::DOUBLE * 0.8::DOUBLE) AS b
  FROM embeddings e, n JOIN embeddings o ON o.vec_id = (e.vec_id * 7 + 3) % n.n),
pq AS (SELECT i, label, list_transform(a, lambda x: x / greatest(sqrt(list_dot_product(a, a)), 1e-12)) AS im, list_transform(b, lambda x: x / greatest(sqrt(list_dot_product(b, b)), 1e-12)) AS tx FROM raw)"""


# ------------------------------------------------------------------ zero-shot classification


@query(f"WITH {CLASSES} SELECT count(*) AS n, round(avg((label = pred)::INT), 6) AS accuracy, (SELECT round(avg(r), 6) FROM (SELECT avg((label = pred)::INT) AS r FROM pr GROUP BY label)) AS balanced_accuracy FROM pr")
def zeroshot_balanced_accuracy(spark, d):
    pred = P.predict(P.logits(I.items(spark, d), P.class_vectors(I.prompts(spark, d))), "label")
    by = pred.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("pred")).cast("int")).alias("ok"))
    return rounded(by.agg(F.sum("n").alias("n"), (F.sum("ok") / F.sum("n")).alias("accuracy"), F.avg(F.col("ok") / F.col("n")).alias("balanced_accuracy")))


@query(f"WITH {CLASSES} SELECT class_id, i::INT - 1 AS pos, round(cvec[i], 6) AS x FROM cv, range(1, 65) t(i)")
def class_vectors(spark, d):
    return rounded(P.class_vectors(I.prompts(spark, d)).select("class_id", F.posexplode("class_vec").alias("pos", "x")))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)))), 5) AS l1 FROM embeddings")
def l2_normalize(spark, d):
    e = I.read(spark, d, "embeddings").select("vec_id", V.unit(F.col("embedding")).alias("u"))
    return e.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("l1"))


@query(f"WITH {CLASSES}, e AS (SELECT *, exp(logit - max(logit) OVER w) AS e FROM lg WINDOW w AS (PARTITION BY item_id)) SELECT item_id, class_id, round(e / sum(e) OVER (PARTITION BY item_id), 6) AS prob FROM e")
def softmax_probabilities(spark, d):
    return rounded(P.softmax(P.logits(I.items(spark, d), P.class_vectors(I.prompts(spark, d)))).select("item_id", "class_id", "prob"))


@query(f"WITH {CLASSES} SELECT item_id, round(1 / (1 + exp(-logit / 0.07::DOUBLE)), 6) AS prob FROM lg WHERE class_id = 3")
def sigmoid_single_class(spark, d):
    lg = P.logits(I.items(spark, d), P.class_vectors(I.prompts(spark, d)).where("class_id = 3"))
    return rounded(P.probabilities(lg, 1, 1 / 0.07).select("item_id", "prob"))


SPINE = "sp AS (SELECT range AS class_id FROM range(10))"
PER = f"""{SPINE}, pc AS (SELECT class_id, (SELECT count(*) FROM pr WHERE label = class_id) AS support, (SELECT count(*) FROM pr WHERE pred = class_id) AS predicted, (SELECT count(*) FROM pr WHERE pred = class_id AND label = class_id) AS tp FROM sp)"""


def _pred(spark, d):
    return P.predict(P.logits(I.items(spark, d), P.class_vectors(I.prompts(spark, d))), "label")


@query(f"WITH {CLASSES}, {PER} SELECT class_id, tp, support, predicted, round(tp / nullif(support, 0)::DOUBLE, 6) AS recall, round(tp / nullif(predicted, 0)::DOUBLE, 6) AS precision, round(coalesce(2.0 * tp / nullif(support + predicted, 0)::DOUBLE, 0), 6) AS f1 FROM pc")
def per_class_metrics(spark, d):
    return rounded(M.per_class(_pred(spark, d), spark.range(10).withColumnRenamed("id", "class_id")))


@query(f"""WITH {CLASSES}, {PER} SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(tp / nullif(support, 0)::DOUBLE), 6) AS balanced_accuracy, round(avg(coalesce(tp / nullif(predicted, 0)::DOUBLE, 0)), 6) AS macro_precision,
round(avg(coalesce(tp / nullif(support, 0)::DOUBLE, 0)), 6) AS macro_recall, round(avg(coalesce(2.0 * tp / nullif(support + predicted, 0)::DOUBLE, 0)), 6) AS macro_f1, count(*) FILTER (tp = 0) AS dead_classes, sum(support)::BIGINT AS n, count(*) AS n_classes FROM pc""")
def multiclass_metrics(spark, d):
    return rounded(M.macro(M.per_class(_pred(spark, d), spark.range(10).withColumnRenamed("id", "class_id"))))


@query(f"""WITH {CLASSES}, {SPINE}, g AS (SELECT a.class_id AS i, b.class_id AS j FROM sp a, sp b), o AS (SELECT i, j, (SELECT count(*) FROM pr WHERE label = i AND pred = j) AS o, (SELECT count(*) FROM pr WHERE label = i)::DOUBLE * (SELECT count(*) FROM pr WHERE pred = j) / (SELECT count(*) FROM pr) AS e FROM g)
SELECT round(1 - sum((i - j) * (i - j) * o) / sum((i - j) * (i - j) * e), 6) AS kappa FROM o""")
def quadratic_kappa(spark, d):
    return rounded(M.quadratic_kappa(_pred(spark, d)))


@query(f"""WITH {CLASSES}, e AS (SELECT *, exp(logit - max(logit) OVER w) AS e FROM lg WINDOW w AS (PARTITION BY item_id)), sm AS (SELECT *, round(e / sum(e) OVER (PARTITION BY item_id), 9) AS score FROM e),
b AS (SELECT class_id AS c, score, sum((label = class_id)::INT) AS p, sum((label <> class_id)::INT) AS n FROM sm GROUP BY ALL),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY c ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b), a AS (SELECT c, {AUC} AS auc FROM w GROUP BY c)
SELECT CASE WHEN count(auc) = 10 THEN round(avg(auc), 6) END AS macro_auroc, count(auc) AS classes FROM a""")
def macro_ovr_auroc(spark, d):
    p = P.softmax(P.logits(I.items(spark, d), P.class_vectors(I.prompts(spark, d)))).withColumn("prob", F.round("prob", 9))
    return rounded(K.macro_ovr_auroc(p, 10))


@query("""WITH g AS (SELECT source, 1 + count(DISTINCT lang) AS c, avg((n_chars > 2000)::INT) AS x FROM documents GROUP BY source)
SELECT source, c, round(1.0::DOUBLE / c, 6) AS chance, round((x - 1.0::DOUBLE / c) / (1 - 1.0::DOUBLE / c), 6) AS corrected FROM g""")
def chance_correction(spark, d):
    """The share of long documents of each source, corrected for a chance of one in its number of languages and one more."""
    t = I.read(spark, d, "documents").groupBy("source").agg((1 + F.count_distinct("lang")).alias("c"), F.avg((F.col("n_chars") > 2000).cast("int")).alias("x"))
    return rounded(t.select("source", "c", S.chance_level(F.col("c")).alias("chance"), S.chance_corrected(F.col("x"), F.col("c")).alias("corrected")))


@query("SELECT c_custkey AS k, round(coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END, nullif(CASE WHEN c_custkey % 3 = 1 THEN c_nationkey::DOUBLE END, 0), 1 / 0.07::DOUBLE), 6) AS scale FROM customer")
def scale_resolution(spark, d):
    c = I.read(spark, d, "customer")
    m = F.col("c_custkey") % 3
    return rounded(c.select(F.col("c_custkey").alias("k"), S.resolve_scale(F.when(m == 0, F.col("c_acctbal")), F.when(m == 1, F.col("c_nationkey"))).alias("scale")))


# ------------------------------------------------------------------ tiles, pooling, slides


@query("""WITH t AS (SELECT vec_id % 50 AS slide, vec_id % 5 AS grp, vec_id AS tile_ix, 1 / (1 + exp(e[1] - e[2])) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, slide ORDER BY score DESC, tile_ix) AS r FROM t)
SELECT grp, slide, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score, count(*) AS n_tiles, round(avg(score) FILTER (r <= 5), 6) AS top_mean FROM r GROUP BY grp, slide""")
def tile_pooling(spark, d):
    t = I.tiles(spark, d).withColumns({"neg": F.col("embedding")[0].cast("double"), "pos": F.col("embedding")[1].cast("double")})
    return rounded(J.top_mean(t.withColumn("score", P.pair_scores("neg", "pos")), ["grp", "slide"], "score", 5))


@query(f"WITH {DOCS}, x AS (SELECT lang, gt, (score >= 0.05::DOUBLE)::INT AS pred FROM s), c AS (SELECT lang, {CONF} FROM x GROUP BY lang) SELECT *, {DERIVED} FROM c")
def confusion_by_group(spark, d):
    t = I.doc_scores(spark, d).withColumn("pred", (F.col("score") >= 0.05).cast("int"))
    return rounded(M.derived(t.groupBy("lang").agg(*M.confusion(F.col("gt"), F.col("pred")))))


@query(f"WITH {DOCS}, x AS (SELECT lang, gt, score, (score >= 0.05::DOUBLE)::INT AS pred FROM s) SELECT CASE WHEN grouping(lang) = 1 THEN '__overall__' ELSE lang END AS lang, {CONF}, count(*) AS n, round(avg(score) FILTER (gt = 1), 6) AS mean_pos, round(avg(score) FILTER (gt = 0), 6) AS mean_neg FROM x GROUP BY GROUPING SETS ((lang), ())")
def groups_and_overall(spark, d):
    t = I.doc_scores(spark, d).withColumn("pred", (F.col("score") >= 0.05).cast("int"))
    aggs = [*M.confusion(F.col("gt"), F.col("pred")), F.count("*").alias("n"), F.avg(F.when(F.col("gt") == 1, F.col("score"))).alias("mean_pos"), F.avg(F.when(F.col("gt") == 0, F.col("score"))).alias("mean_neg")]
    return rounded(M.grouped_and_overall(t, "lang", aggs))


@query(f"WITH {SLIDES}, q AS (SELECT grp, quantile_cont(score, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS min, round(max(score), 6) AS max FROM s GROUP BY grp) SELECT grp, mean, std, min, max, round(q[1], 6) AS p01, round(q[2], 6) AS p05, round(q[3], 6) AS p25, round(q[4], 6) AS median, round(q[5], 6) AS p75, round(q[6], 6) AS p95, round(q[7], 6) AS p99 FROM q")
def score_summary(spark, d):
    return rounded(M.score_summary(I.slide_scores(spark, d), "score", "grp"))


@query("""WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT label, vec_id, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS u FROM e),
m AS (SELECT label, i, avg(u[i]) AS m FROM u, range(1, 65) t(i) GROUP BY label, i), v AS (SELECT label, list(m ORDER BY i) AS v FROM m GROUP BY label),
g AS (SELECT label, min(vec_id) AS f, count(*) AS n FROM e GROUP BY label)
SELECT row_number() OVER (ORDER BY f) - 1 AS new_id, label::VARCHAR AS group_key, 'c' || f AS caption, n AS n_patches, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS x0, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS x63 FROM g JOIN v USING (label)""")
def pooled_groups(spark, d):
    e = I.read(spark, d, "embeddings").select(F.col("vec_id").alias("pair_index"), F.col("label").cast("string").alias("g"), "embedding", F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("caption"))
    return rounded(J.pool_groups(e, "g", "embedding").select("new_id", "group_key", "caption", "n_patches", F.col("vec")[0].alias("x0"), F.col("vec")[63].alias("x63")))


@query("SELECT label, min(n)::BIGINT AS min_n, max(n)::BIGINT AS max_n, round(avg(n), 6) AS mean_n, round(median(n), 6) AS median_n FROM (SELECT label, vec_id % 20 AS g, count(*) AS n FROM embeddings GROUP BY ALL) GROUP BY label")
def patches_per_group(spark, d):
    n = I.read(spark, d, "embeddings").groupBy("label", (F.col("vec_id") % 20).alias("g")).agg(F.count("*").alias("n"))
    return rounded(n.groupBy("label").agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.avg("n").alias("mean_n"), F.percentile("n", F.lit(0.5)).alias("median_n")))


@query("SELECT class_id, coalesce(n, 0) AS n FROM (SELECT range AS class_id FROM range(12)) LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) ON label = class_id")
def label_distribution(spark, d):
    n = I.read(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return spark.range(12).select(F.col("id").alias("class_id")).join(n, F.col("label") == F.col("class_id"), "left").select("class_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {SLIDES}, p AS (SELECT patient, count(DISTINCT grp) AS organs, any_value(grp) AS grp, count(*) AS n_slides, sum(gt)::BIGINT AS n_pos FROM s GROUP BY patient)
SELECT patient, grp, n_slides, n_pos, CASE WHEN n_pos = 0 THEN 'negative_only' WHEN n_pos = n_slides THEN 'positive_only' ELSE 'mixed' END AS pattern FROM p""")
def patient_rollup(spark, d):
    return _patients(spark, d)


def _patients(spark, d):
    return J.patient_rollup(I.slide_scores(spark, d))


@query(f"SELECT 0 AS z, (SELECT count(DISTINCT o_custkey) FROM orders) AS patients, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS groups")
def distinct_clusters(spark, d):
    o, c = I.read(spark, d, "orders"), I.read(spark, d, "customer")
    return o.agg(F.countDistinct("o_custkey").alias("patients")).join(F.broadcast(c.agg(F.countDistinct("c_mktsegment").alias("groups")))).select(F.lit(0).alias("z"), "patients", "groups")


@query("SELECT user_id, count(*) AS n, list(event_id ORDER BY event_id) AS events FROM events GROUP BY user_id")
def grouped_in_order(spark, d):
    m = J.members(I.read(spark, d, "events").withColumn("id", F.col("event_id")), "user_id", "event_id", "id")
    return m.select("user_id", "n", F.transform("members", lambda x: x["id"]).alias("events"))


@query("SELECT event_type, round(sum(value * (user_id % 7)) / greatest(1, sum(user_id % 7)), 6) AS weighted FROM events GROUP BY event_type")
def weighted_means(spark, d):
    w = F.col("user_id") % 7
    return rounded(I.read(spark, d, "events").groupBy("event_type").agg((F.sum(F.col("value") * w) / F.greatest(F.lit(1), F.sum(w))).alias("weighted")))


# ------------------------------------------------------------------ curves


@query(f"WITH {DOCS}, {BY}, b AS (SELECT lang, p, n, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM pt) SELECT lang, round({AUC}, 6) AS auroc FROM b GROUP BY lang")
def auroc_by_group(spark, d):
    return rounded(K.auroc(I.doc_scores(spark, d), ["lang"]))


@query(f"WITH {DOCS}, {BY} SELECT lang, round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM ro UNION ALL SELECT DISTINCT lang, 'inf'::DOUBLE, 0.0, 0.0 FROM s")
def roc_curve(spark, d):
    return rounded(K.roc(I.doc_scores(spark, d), ["lang"]).select("lang", "threshold", "tpr", "fpr"))


@query(f"""WITH {DOCS}, {FLAT}, k AS (SELECT *, lead(tps) OVER w - 2 * tps + lag(tps) OVER w AS a, lead(fps) OVER w - 2 * fps + lag(fps) OVER w AS b FROM ro WINDOW w AS (ORDER BY threshold DESC))
SELECT round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM k WHERE a IS NULL OR a <> 0 OR b <> 0 UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0""")
def roc_without_collinear(spark, d):
    return rounded(K.roc(I.doc_scores(spark, d), [], True).select("threshold", "tpr", "fpr"))


@query(f"WITH {DOCS}, {BY}, q AS (SELECT pt.lang, p, tps, fps, sum(p) OVER (PARTITION BY pt.lang) AS ap FROM pt JOIN ro ON pt.lang = ro.lang AND pt.score = ro.threshold) SELECT lang, round(sum(p * tps / (tps + fps)) / nullif(max(ap), 0)::DOUBLE, 6) AS average_precision FROM q GROUP BY lang")
def average_precision(spark, d):
    return rounded(K.average_precision(I.doc_scores(spark, d), ["lang"]))


@query(f"WITH {DOCS}, {PRUNED}, m AS (SELECT lang, max((j, threshold)) AS m, count(*) FILTER (j IS NULL) AS u FROM kp GROUP BY lang) SELECT lang, round(m[2], 6) AS threshold, round(m[1], 6) AS j FROM m WHERE u = 0")
def youden_threshold(spark, d):
    return rounded(K.youden(K.roc(I.doc_scores(spark, d), ["lang"], True), ["lang"]))


@query(f"WITH {DOCS}, {BY}, m AS (SELECT *, max(tpr - fpr) OVER (PARTITION BY lang) AS b FROM ro) SELECT lang, round(max(threshold), 6) AS threshold, round(max(b), 6) AS j FROM m WHERE abs(tpr - fpr - b) <= 1e-8 + 1e-5 * abs(b) GROUP BY lang")
def youden_tolerant(spark, d):
    pts = K.roc(I.doc_scores(spark, d), ["lang"])
    return rounded(K.youden(pts, ["lang"], True))


@query(f"""WITH {DOCS}, {PRUNED}, f AS (SELECT unnest([0.9, 0.95, 1.5]::DOUBLE[]) AS floor), c AS (SELECT floor, lang, max((tpr >= floor, CASE WHEN tpr >= floor THEN -fpr ELSE tpr END, threshold, tpr, fpr)) AS m FROM kp, f WHERE tpr IS NOT NULL GROUP BY ALL)
SELECT floor, lang, round(m[3], 6) AS threshold, round(m[4], 6) AS sensitivity, round(1 - m[5], 6) AS specificity FROM c""")
def sensitivity_floor(spark, d):
    """Floors of 0.9 and 0.95, and one that no point reaches."""
    pts, out = K.roc(I.doc_scores(spark, d), ["lang"], True), None
    for floor in (0.9, 0.95, 1.5):
        one = K.at_sensitivity(pts, floor, ["lang"]).withColumn("floor", F.lit(floor))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query(f"WITH {SLIDES}, x AS (SELECT grp, gt, (score >= 0.5::DOUBLE)::INT AS pred FROM s), c AS (SELECT grp, {CONF}, count(*) AS n FROM x GROUP BY grp) SELECT *, {DERIVED} FROM c")
def locked_threshold(spark, d):
    return rounded(K.at_threshold(I.slide_scores(spark, d), 0.5, ["grp"]))


@query(f"""WITH {DOCS}, x AS (SELECT lang, gt, coalesce(CASE WHEN doc_id % 3 = 0 THEN gt END, (score >= 0.5::DOUBLE)::INT) AS pred FROM s), c AS (SELECT lang, {CONF} FROM x GROUP BY lang) SELECT *, {DERIVED} FROM c""")
def stored_or_thresholded(spark, d):
    raw = F.when(F.col("doc_id") % 3 == 0, F.col("gt").cast("string")).otherwise(F.lit(""))
    t = I.doc_scores(spark, d).withColumn("pred", F.coalesce(raw.try_cast("int"), (F.col("score") >= 0.5).cast("int")))
    return rounded(M.derived(t.groupBy("lang").agg(*M.confusion(F.col("gt"), F.col("pred")))))


@query(f"WITH {DOCS}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM s) SELECT bin, count(*) AS n FROM (SELECT CASE WHEN hi > lo THEN least(floor((score - lo) / ((hi - lo) / 80)), 79) ELSE 0 END::INT AS bin FROM s, e) GROUP BY 1")
def score_histogram(spark, d):
    return M.histogram(I.doc_scores(spark, d), "score", 80)


# ------------------------------------------------------------------ ids, joins, filters


@query("SELECT page_id, regexp_replace(coalesce(nullif(trim(url), ''), 'unknown'), '[^A-Za-z0-9._-]+', '_', 'g') AS safe, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_extract(url, '([^/]*)/[^/]*$', 1) AS parent FROM pages")
def safe_names(spark, d):
    u = F.col("url")
    return I.read(spark, d, "pages").select("page_id", T.safe_name(u).alias("safe"), T.basename(u).alias("base"), T.parent(u).alias("parent"))


@query("SELECT c_custkey AS k, nullif(regexp_extract(upper(trim(s)), '^(B\\d{2,4}\\.\\d{2,5})', 1), '') AS accession FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ' b' || (c_custkey % 100 + 10) || '.' || (c_custkey + 100) || '_B_HE' ELSE c_name END AS s FROM customer)")
def accessions(spark, d):
    k = F.col("c_custkey")
    s = F.when(k % 2 == 0, F.concat(F.lit(" b"), (k % 100 + 10).cast("string"), F.lit("."), (k + 100).cast("string"), F.lit("_B_HE"))).otherwise(F.col("c_name"))
    return I.read(spark, d, "customer").select(k.alias("k"), T.accession(s).alias("accession"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) || '::SLIDE::' || c_name ELSE lower(c_mktsegment) || '::' || upper(c_name) END AS case_id FROM customer")
def external_cases(spark, d):
    case = F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).otherwise(F.col("c_name"))
    return I.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), T.case_id(F.col("c_mktsegment"), case, F.concat(F.lit("/a/"), F.col("c_name"), F.lit(".svs"))).alias("case_id"))


@query("SELECT c_custkey AS k, 'Case-' || (c_custkey % 9) AS osteo, split_part(c_name, '#', 1) AS sicap, c_name || '_' || c_custkey AS databiox FROM customer")
def source_groups(spark, d):
    k, n = F.col("c_custkey"), F.col("c_name")
    t = I.read(spark, d, "customer")
    return t.select(
        k.alias("k"), T.source_group("osteo", F.concat(F.lit("/x/Case-"), (k % 9).cast("string"), F.lit("-A.jpg"))).alias("osteo"),
        T.source_group("sicap", F.concat(F.substring_index(n, "#", 1), F.lit("_1_2"))).alias("sicap"), T.source_group("databiox", F.concat(n, F.lit("_"), k.cast("string"), F.lit("_40x_1.JPG"))).alias("databiox"),
    )


@query("""WITH m AS (SELECT c_mktsegment AS grp, c_name AS slide, 'P' || (c_custkey // 3) AS pid FROM customer WHERE c_custkey % 4 <> 0)
SELECT c_custkey AS k, coalesce(m.pid, 'ext::' || regexp_replace(c_mktsegment, '[^A-Za-z0-9._-]+', '_', 'g') || '::SLIDE::' || regexp_replace(c_name, '[^A-Za-z0-9._-]+', '_', 'g')) AS patient_id, (m.pid IS NULL)::INT AS missed
FROM customer LEFT JOIN m ON c_mktsegment = m.grp AND c_name = m.slide""")
def patient_join(spark, d):
    c = I.read(spark, d, "customer")
    slides = c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("group"), F.regexp_replace("c_name", "#", "/").alias("slide"))
    known = c.where("c_custkey % 4 <> 0").select(F.col("c_mktsegment").alias("group"), F.col("c_name").alias("slide"), F.concat(F.lit("P"), F.floor(F.col("c_custkey") / 3).cast("string")).alias("patient_id"))
    return J.join_patients(slides, known, "ext").select("k", "patient_id", "missed")


@query("WITH b AS (SELECT l_orderkey, round(sum(l_extendedprice * l_discount), 4) AS s FROM lineitem GROUP BY 1) SELECT o_orderkey AS k, o_totalprice AS a, s AS b FROM orders JOIN b ON o_orderkey = l_orderkey")
def one_to_one_join(spark, d):
    a = I.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("a"))
    b = I.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("b"))
    return J.one_to_one(a, b, ["k"])


@query("SELECT o_orderpriority AS model, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment NOT IN ('BUILDING') GROUP BY 1")
def cohort_exclusion(spark, d):
    t = I.read(spark, d, "orders").join(I.read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("group")), "o_custkey")
    return J.if_evaluable(J.exclude_groups(t, ["BUILDING"])).groupBy(F.col("o_orderpriority").alias("model")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN v IN ('0', 'neg', 'negative') THEN 0 WHEN v IN ('1', 'pos', 'macro', 'micro') THEN 1 END AS label
FROM (SELECT doc_id, ['0', 'neg', 'macro', 'Pos', 'itc', '1'][doc_id % 6 + 1] AS v FROM documents)""")
def mapped_labels(spark, d):
    v = F.get(F.array(*map(F.lit, ["0", "neg", "macro", "Pos", "itc", "1"])), (F.col("doc_id") % 6).cast("int"))
    return I.read(spark, d, "documents").select("doc_id", J.label_of(v, L.EXTERNAL_LABELS).alias("label"))


@query("SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 0.25 WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 WHEN 3 THEN 2.0 WHEN 4 THEN 0.5 ELSE 50.0 END::DOUBLE AS mpp FROM customer")
def base_mpp(spark, d):
    m = (F.col("c_custkey") % 6).cast("int")
    pick = lambda *x: F.get(F.array(*[F.lit(v) for v in x]), m)
    return I.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), S.base_mpp(pick("0.25", "1000", "", "unknown", "NaN", "50"), pick("5", "40", "20", "5", "63", "40")).alias("mpp"))


@query("SELECT s_suppkey AS k, (SELECT i FROM (SELECT i, abs(1.0::DOUBLE + (s_suppkey % 5) - 0.25::DOUBLE * [1, 2, 4, 16][i + 1]) AS g FROM range(4) t(i)) ORDER BY g, i LIMIT 1)::INT AS level FROM supplier")
def nearest_level(spark, d):
    k = F.col("s_suppkey")
    return I.read(spark, d, "supplier").select(k.alias("k"), S.nearest_level(1.0 + (k % 5), F.lit(0.25), F.array(*map(F.lit, [1.0, 2.0, 4.0, 16.0]))).alias("level"))


@query("SELECT p_partkey AS k, y, x FROM (SELECT p_partkey, p_size * 100 AS h FROM part), range(0, 100000, 256) a(y), range(0, 1024, 256) b(x) WHERE y + 256 <= h AND x + 256 <= 1000")
def tile_grid(spark, d):
    return _grid(I.read(spark, d, "part"))


def _grid(part):
    t = part.select(F.col("p_partkey").alias("k"), (F.col("p_size") * 100).alias("h"), F.lit(1000).alias("w"))
    return J.tile_grid(t, "h", "w", 256, "k")


@query("SELECT user_id AS slide, round(avg(value), 6) AS mean_sat, round(avg((value BETWEEN 30 AND 220)::INT), 6) AS hue_part FROM events GROUP BY user_id HAVING avg(value) >= 20 AND avg((value BETWEEN 30 AND 220)::INT) >= 0.1::DOUBLE")
def tissue_filter(spark, d):
    e = I.read(spark, d, "events").select(F.col("user_id").alias("slide"), "value")
    return rounded(J.tissue(e, "slide", "value", "value", band=(30, 220)))


@query("""WITH n AS (SELECT count(*) AS n FROM events) SELECT event_id AS step, round(CASE WHEN event_id < 100 THEN 0.001::DOUBLE * (event_id + 1) / 100
ELSE 0.00001::DOUBLE + (0.001::DOUBLE - 0.00001::DOUBLE) * 0.5::DOUBLE * (1 + cos(pi() * (event_id - 100) / greatest(n - 100, 1)::DOUBLE)) END, 9) AS lr FROM events, n""")
def lr_schedule(spark, d):
    """The rate at each event, one being a step of a run over all of them."""
    e = I.read(spark, d, "events").select(F.col("event_id").alias("step"))
    return e.select("step", F.round(S.warmup_cosine(F.col("step"), e.count(), 100, 0.001, 0.00001), 9).alias("lr"))


@query("SELECT event_id, floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 8)::BIGINT AS batch FROM events")
def fixed_batches(spark, d):
    return J.batched(I.read(spark, d, "events"), "user_id", "event_id", 8).select("event_id", "batch")


@query("SELECT event_id, batch FROM (SELECT event_id, floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 8)::BIGINT AS batch, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE (batch + 1) * 8 <= n")
def whole_batches(spark, d):
    return J.batched(I.read(spark, d, "events"), "user_id", "event_id", 8, True).select("event_id", "batch")


# ------------------------------------------------------------------ texts and JSON


@query("""WITH c AS (SELECT p_partkey % 7 AS class_id, p_brand AS name, p_partkey AS ord FROM part), n AS (SELECT class_id, name, min(ord) AS ord FROM c GROUP BY ALL), t(template_key, template) AS (VALUES ('a', 'an image of {}.'), ('b', 'CLASSNAME is shown'), ('c', 'presence of {} in CLASSNAME'))
SELECT class_id, ord, template_key, name, replace(replace(template, '{}', name), 'CLASSNAME', name) AS prompt FROM n, t""")
def prompt_banks(spark, d):
    c = I.read(spark, d, "part").select((F.col("p_partkey") % 7).alias("class_id"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("ord"))
    t = spark.createDataFrame([("a", "an image of {}."), ("b", "CLASSNAME is shown"), ("c", "presence of {} in CLASSNAME")], "template_key string, template string")
    return W.prompt_bank(c, t)


@query("""WITH q AS (SELECT conv_id, turn, text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r2 FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ix FROM q WHERE role = 'user' AND r2 = 'assistant')
SELECT conv_id, ix::INT AS ix, md5('Question: ' || trim(q) || ' Answer: ' || trim(a)) AS digest FROM p WHERE trim(q) <> '' AND trim(a) <> ''""")
def qa_pairs(spark, d):
    return _qa(spark, d).select("conv_id", "ix", F.md5("text").alias("digest"))


def _qa(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = I.read(spark, d, "conversations").withColumns({"a": F.lead("text").over(w), "r2": F.lead("role").over(w)}).where("role = 'user' and r2 = 'assistant'")
    t = t.withColumn("at", F.row_number().over(w) - 1).withColumns({"row": F.floor(F.col("at") / 5), "ix": F.col("at") % 5 + 1})  # rows of five pairs
    cols = [F.max(F.when(F.col("ix") == i, F.col(c))).alias(f"{n}_{i}") for i in range(1, 6) for n, c in (("Question", "text"), ("Answer", "a"))]
    pairs = L.qa_pairs(t.groupBy("conv_id", "row").agg(*cols), ["conv_id", "row"])
    return pairs.select("conv_id", (F.col("row") * 5 + F.col("ix")).cast("int").alias("ix"), "text")


@query("""WITH q AS (SELECT conv_id, turn, text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r2 FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ix FROM q WHERE role = 'user' AND r2 = 'assistant')
SELECT conv_id, count(*) AS n_texts, md5(string_agg('Question: ' || trim(q) || ' Answer: ' || trim(a), ' || ' ORDER BY ix)) AS digest FROM p WHERE trim(q) <> '' AND trim(a) <> '' GROUP BY conv_id""")
def qa_pooled(spark, d):
    t = L.pooled_texts(_qa(spark, d), "conv_id")
    return t.select("conv_id", F.size("texts").cast("bigint").alias("n_texts"), F.md5(F.array_join("texts", " || ")).alias("digest"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_map_entries(spark, d):
    e = I.read(spark, d, "events").select("event_id", F.explode(F.map_entries(F.from_json("props", "map<string,string>"))).alias("e"))
    return e.where("e.key = 'k' and e.value is not null").select("event_id", F.col("e.value").try_cast("bigint").alias("k"))


@query("SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE source END), ''), lang) AS id FROM documents")
def first_filled_alias(spark, d):
    a = F.when(F.col("doc_id") % 2 == 0, F.lit(" ")).otherwise(F.col("source"))
    return I.read(spark, d, "documents").select("doc_id", T.first_filled(a, F.col("lang")).alias("id"))


@query("SELECT doc_id, doc_id % 4 - 1 AS label FROM documents WHERE doc_id % 4 IN (1, 2, 3)")
def single_positive_labels(spark, d):
    m = F.col("doc_id") % 4
    t = I.read(spark, d, "documents").select("doc_id", (m == 1).cast("int").alias("a"), (m == 2).cast("int").alias("b"), F.when(m == 0, F.lit(None)).otherwise((m == 3).cast("int")).alias("c"))
    return L.single_positive(t, ["a", "b", "c"]).select("doc_id", F.col("label").cast("bigint").alias("label"))


@query("SELECT doc_id, [0, 1, 2, 3, 2][doc_id % 5 + 1] AS label FROM documents")
def one_hot_labels(spark, d):
    cols = list(L.GRADE_CLASSES)
    t = I.read(spark, d, "documents").select("doc_id", *[(F.col("doc_id") % 5 == i).cast("int").alias(c) for i, c in enumerate(cols)])
    return t.select("doc_id", L.one_hot_label(cols, L.GRADE_CLASSES).alias("label"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 < 9 THEN doc_id % 10 END AS label, CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 ELSE 3 + doc_id % 3 END AS composed FROM documents")
def prefix_and_composed_labels(spark, d):
    code = F.get(F.array(*map(F.lit, [*L.PREFIX_CODES, "ZZZ"])), (F.col("doc_id") % 10).cast("int"))
    return I.read(spark, d, "documents").select("doc_id", L.prefix_code_label(F.concat(F.lit("/d/"), code, F.lit("-1.png"))).cast("bigint").alias("label"), L.composed_label(F.col("doc_id") % 2, F.col("doc_id") % 3).alias("composed"))


# ------------------------------------------------------------------ retrieval


@query(f"""WITH {PAIRS}, ps AS (SELECT i, list_dot_product(im, tx) AS at FROM pq)
SELECT q.i AS query_id, 1 + count(*) FILTER (c.i <> q.i AND list_dot_product(q.im, c.tx) > ps.at + 1e-12) AS rank, round(any_value(ps.at), 6) AS pos_sim FROM pq q JOIN ps ON ps.i = q.i, pq c GROUP BY q.i""")
def retrieval_ranks(spark, d):
    p = I.pairs(spark, d)
    q = p.select(F.col("pair_index").alias("query_id"), F.col("image_emb").alias("vec"), F.col("pair_index").alias("pos"))
    return rounded(R.ranks(q, p.select(F.col("pair_index").alias("cand_id"), F.col("text_emb").alias("vec"))))


@query(f"""WITH {PAIRS}, im AS (SELECT i // 2 AS k, min(i) AS cand, pos, avg(im[pos]) AS m FROM pq, range(1, 65) t(pos) GROUP BY i // 2, pos), iv AS (SELECT k, min(cand) AS cand, list(m ORDER BY pos) AS v FROM im GROUP BY k),
c AS (SELECT k, cand, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM iv), ps AS (SELECT pq.i, c.cand AS pos, list_dot_product(tx, v) AS at FROM pq JOIN c ON c.k = pq.i // 2),
r AS (SELECT q.i, 1 + count(*) FILTER (c.cand <> ps.pos AND list_dot_product(q.tx, c.v) > ps.at + 1e-12) AS rank FROM pq q JOIN ps ON ps.i = q.i, c GROUP BY q.i)
SELECT round(median(rank), 6) AS median_rank, round(avg(rank), 6) AS mean_rank, round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg((rank <= 1)::INT), 6) AS recall_1, round(avg((rank <= 5)::INT), 6) AS recall_5, round(avg((rank <= 10)::INT), 6) AS recall_10 FROM r""")
def text_to_image_summary(spark, d):
    p = I.pairs(spark, d)
    c = R.dedup_candidates(p, "image_id", "image_emb")
    q = p.join(c.select("k", F.col("cand_id").alias("pos")), p.image_id == F.col("k")).select(F.col("pair_index").alias("query_id"), F.col("text_emb").alias("vec"), "pos")
    return rounded(M.rank_summary(R.ranks(q, c.select("cand_id", "vec")), "rank"))


@query(f"""WITH {PAIRS}, x AS (SELECT q.i AS query_id, c.i AS cand_id, list_dot_product(q.im, c.tx) AS sim FROM pq q, pq c WHERE q.i % 25 = 0)
SELECT query_id, cand_id, round(sim, 6) AS sim, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, cand_id) AS place FROM x) WHERE place <= 10""")
def retrieval_top_k(spark, d):
    p = I.pairs(spark, d)
    q = p.where("pair_index % 25 = 0").select(F.col("pair_index").alias("query_id"), F.col("image_emb").alias("vec"))
    return rounded(R.top_k(q, p.select(F.col("pair_index").alias("cand_id"), F.col("text_emb").alias("vec")), 10))


@query(f"""WITH {PAIRS}, m AS (SELECT t.p, avg(im[t.p]) AS a, avg(tx[t.p]) AS b FROM pq, range(1, 65) t(p) GROUP BY t.p)
SELECT round(sqrt(sum((a - b) * (a - b))), 6) AS centroid_l2, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS centroid_cosine, round(sqrt(sum(a * a)), 6) AS norm_a, round(sqrt(sum(b * b)), 6) AS norm_b FROM m""")
def modality_gap(spark, d):
    return rounded(R.modality_gap(I.pairs(spark, d), "image_emb", "text_emb"))


@query(f"""WITH {PAIRS}, k AS (SELECT max(i) + 1 AS n FROM pq), s AS (SELECT range AS s, ('0x' || substr(md5('i' || range), 1, 15))::BIGINT AS x, ('0x' || substr(md5('j' || range), 1, 15))::BIGINT AS y FROM range(2000)),
d AS (SELECT s, x % n AS i, y % (n - 1) AS j FROM s, k), e AS (SELECT s, i, j + (j >= i)::INT AS j FROM d) SELECT s, a.i, b.i AS j, round(list_dot_product(a.im, b.tx), 6) AS sim FROM e JOIN pq a ON a.i = e.i JOIN pq b ON b.i = e.j""")
def random_nonmatches(spark, d):
    return rounded(R.nonmatches(I.pairs(spark, d), 2000, *_draws()))


def _draws():
    return [B.digest(F.concat(F.lit(x), F.col("s").cast("string"))) for x in "ij"]


@query(f"""WITH {PAIRS}, x AS (SELECT a.i // 64 AS batch, a.i, b.i AS j, list_dot_product(a.im, b.tx) AS sim FROM pq a JOIN pq b ON a.i // 64 = b.i // 64), r AS (SELECT i, ln(sum(exp(sim * 10))) AS l, max(sim) AS m FROM x GROUP BY i), c AS (SELECT j, ln(sum(exp(sim * 10))) AS l, max(sim) AS m FROM x GROUP BY j),
p AS (SELECT batch, i, sim FROM x WHERE i = j) SELECT batch, round((avg(r.l - sim * 10) + avg(c.l - sim * 10)) / 2, 6) AS loss, round((avg((sim >= r.m)::INT) + avg((sim >= c.m)::INT)) / 2, 6) AS top1 FROM p JOIN r USING (i) JOIN c ON c.j = p.i GROUP BY batch""")
def info_nce(spark, d):
    p = I.pairs(spark, d).withColumn("batch", F.floor(F.col("pair_index") / 64))
    both = p.select("batch", F.col("pair_index").alias("i"), "image_emb").join(p.select("batch", F.col("pair_index").alias("j"), "text_emb"), "batch")
    return rounded(R.info_nce(both.select("batch", "i", "j", V.dot(F.col("image_emb"), F.col("text_emb")).alias("sim")), 10.0, "batch"))


SHIFT = "list_dot_product(im, tx) AS cosine, sqrt(list_sum(list_transform(list_zip(im, tx), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / sqrt(list_dot_product(im, im)) AS relative_l2, sqrt(list_dot_product(tx, tx)) / sqrt(list_dot_product(im, im)) AS norm_ratio, list_avg(list_transform(list_zip(im, tx), lambda z: abs(z[1] - z[2]))) AS mean_abs"


@query(f"""WITH {PAIRS}, x AS (SELECT {SHIFT} FROM pq)
SELECT round(avg(cosine), 6) AS mean_cosine, round(quantile_cont(cosine, 0.05), 6) AS p05, round(stddev_pop(cosine), 6) AS std, round(avg(relative_l2), 6) AS relative_l2, round(avg(norm_ratio), 6) AS norm_ratio, round(avg(mean_abs), 6) AS mean_abs FROM x""")
def feature_shift(spark, d):
    x = I.pairs(spark, d).select(*[c.alias(n) for n, c in V.shift(F.col("image_emb"), F.col("text_emb")).items()])
    means = [F.avg(c).alias(c) for c in ("relative_l2", "norm_ratio", "mean_abs")]
    return rounded(x.agg(F.avg("cosine").alias("mean_cosine"), F.percentile("cosine", F.lit(0.05)).alias("p05"), F.stddev_pop("cosine").alias("std"), *means))


@query("WITH t AS (SELECT user_id % 12 + 1 AS rank FROM events) SELECT rank, round(sum(count(*)) OVER (ORDER BY rank) / sum(count(*)) OVER ()::DOUBLE, 6) AS cdf FROM t GROUP BY rank")
def rank_cdf(spark, d):
    return rounded(M.rank_cdf(I.read(spark, d, "events").select((F.col("user_id") % 12 + 1).alias("rank")), "rank"))


# ------------------------------------------------------------------ resampling and splits

DRAWS = """cl AS (SELECT source::VARCHAR AS c, row_number() OVER (ORDER BY source) - 1 AS ix FROM (SELECT DISTINCT source FROM s)), nc AS (SELECT count(*) AS n FROM cl),
dr AS (SELECT (r // n)::INT AS rep, ('0x' || substr(md5('b' || r), 1, 15))::BIGINT % n AS d FROM (SELECT n, unnest(range(200 * n)) AS r FROM nc)), w AS (SELECT rep, c, count(*) AS weight FROM dr JOIN cl ON d = ix GROUP BY ALL)"""
REPS = f"""{DRAWS}, x AS (SELECT rep, score, sum(CASE WHEN gt = 1 THEN weight ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN gt = 0 THEN weight ELSE 0 END)::DOUBLE AS n FROM s JOIN w ON source = c GROUP BY ALL),
bl AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY rep ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM x), st AS (SELECT rep, {AUC} AS auroc FROM bl GROUP BY rep)"""


def _weighted(spark, d, reps=200):
    t = I.doc_scores(spark, d)
    w = B.cluster_draws(t, "source", reps)
    return t.join(w, t.source == w.cluster)


@query(f"WITH {DOCS}, {REPS} SELECT round(quantile_cont(auroc, 0.025), 6) AS lo, round(quantile_cont(auroc, 0.975), 6) AS hi, count(auroc) AS n_valid FROM st")
def bootstrap_auroc(spark, d):
    return rounded(B.interval(K.auroc(_weighted(spark, d), ["rep"], "weight"), "auroc"))


@query(f"""WITH {DOCS}, {DRAWS}, z AS (SELECT rep, sum(weight * (gt = (score >= 0.05::DOUBLE)::INT)::INT) / sum(weight)::DOUBLE AS a, sum(weight * (gt = (score >= 0.02::DOUBLE)::INT)::INT) / sum(weight)::DOUBLE AS b FROM s JOIN w ON source = c GROUP BY rep)
SELECT round(least(1, 2 * least((count(*) FILTER (a - b <= 0) + 1) / (count(*) + 1)::DOUBLE, (count(*) FILTER (a - b >= 0) + 1) / (count(*) + 1)::DOUBLE)), 6) AS p_value, count(*) AS n_valid, round(quantile_cont(a - b, 0.025), 6) AS lo, round(quantile_cont(a - b, 0.975), 6) AS hi FROM z""")
def paired_bootstrap(spark, d):
    t = _weighted(spark, d)
    acc = lambda at: (F.sum(F.col("weight") * (F.col("gt") == (F.col("score") >= at).cast("int")).cast("int")) / F.sum("weight"))
    return rounded(B.paired_p(t.groupBy("rep").agg((acc(0.05) - acc(0.02)).alias("delta")), "delta"))


@query(f"""WITH {DOCS}, {REPS}, k AS (SELECT rep, sum(weight) FILTER (gt = 1 AND score >= 0.05::DOUBLE) AS tp, sum(weight) FILTER (gt = 0 AND score < 0.05::DOUBLE) AS tn, sum(weight) FILTER (gt = 1) AS p, sum(weight) FILTER (gt = 0) AS n FROM s JOIN w ON source = c GROUP BY rep),
m AS (SELECT auroc, coalesce(tp, 0) / p::DOUBLE AS se, coalesce(tn, 0) / n::DOUBLE AS sp FROM k JOIN st USING (rep) WHERE auroc IS NOT NULL)
SELECT round(quantile_cont(auroc, 0.025), 6) AS auroc_lo, round(quantile_cont(auroc, 0.975), 6) AS auroc_hi, round(quantile_cont((se + sp) / 2, 0.025), 6) AS balanced_accuracy_lo, round(quantile_cont((se + sp) / 2, 0.975), 6) AS balanced_accuracy_hi,
round(quantile_cont(se, 0.025), 6) AS sensitivity_lo, round(quantile_cont(se, 0.975), 6) AS sensitivity_hi, round(quantile_cont(sp, 0.025), 6) AS specificity_lo, round(quantile_cont(sp, 0.975), 6) AS specificity_hi, count(*) AS n_valid FROM m""")
def locked_threshold_intervals(spark, d):
    return rounded(U.locked_threshold_intervals(I.doc_scores(spark, d), "source", 0.05, 200))


@query("""WITH p AS (SELECT p_partkey AS k, p_size % 4 AS g, (p_partkey * 37 % 1000) / 1000.0::DOUBLE AS p FROM part), r AS (SELECT *, least(1, (count(*) OVER (PARTITION BY g) - row_number() OVER w + 1) * p) AS s FROM p WINDOW w AS (PARTITION BY g ORDER BY p, k))
SELECT g, k, round(p, 6) AS p, round(max(s) OVER (PARTITION BY g ORDER BY p, k ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM r""")
def holm_correction(spark, d):
    return _holm(I.read(spark, d, "part"))


def _holm(part):
    t = part.select((F.col("p_size") % 4).alias("g"), F.col("p_partkey").alias("k"), ((F.col("p_partkey") * 37 % 1000) / 1000.0).cast("double").alias("p"))
    return rounded(B.holm(t, "p", "g", order="k"))


@query(f"""WITH {SLIDES}, p AS (SELECT patient, any_value(grp) AS grp, CASE WHEN sum(gt) = 0 THEN 'negative_only' WHEN sum(gt) = count(*) THEN 'positive_only' ELSE 'mixed' END AS pattern FROM s GROUP BY patient),
z AS (SELECT grp, pattern, count(*) AS n, sum(count(*)) OVER () AS t, ceil(sum(count(*)) OVER () * 0.2 - 0.000000001) AS k FROM p GROUP BY ALL), f AS (SELECT *, n * k::DOUBLE / t AS share, floor(n * k::DOUBLE / t + 1e-9) AS base FROM z),
q AS (SELECT grp, pattern, base + (row_number() OVER (ORDER BY round(share - base, 9) DESC, n DESC, grp || '::' || pattern) <= k - sum(base) OVER ())::INT AS m FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, pattern ORDER BY ('0x' || substr(md5('42' || patient), 1, 15))::BIGINT, patient) AS r FROM p)
SELECT patient, r.grp, r.pattern, CASE WHEN r <= m THEN 'calibration' ELSE 'holdout' END AS split FROM r JOIN q ON r.grp = q.grp AND r.pattern = q.pattern""")
def stratified_split(spark, d):
    return B.stratified(_patients(spark, d), "patient", ["grp", "pattern"], 0.2, least=1).select("patient", "grp", "pattern", "split")


@query("""WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, n, CASE WHEN coalesce(sum(n) OVER (ORDER BY ('0x' || substr(md5('42' || source), 1, 15))::BIGINT, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.2 * sum(n) OVER () THEN 'val' ELSE 'train' END AS split FROM g""")
def grouped_split(spark, d):
    return B.grouped_split(I.read(spark, d, "documents"), "source", 0.2)


@query("""WITH h AS (SELECT doc_id, ('0x' || substr(md5('42' || doc_id), 1, 15))::BIGINT AS h FROM documents) SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY h, doc_id) <= (SELECT round(count(*) * 0.1::DOUBLE) FROM h) THEN 'val' ELSE 'train' END AS split FROM h""")
def flat_split(spark, d):
    return B.flat_split(I.read(spark, d, "documents").select("doc_id"), "doc_id", 0.1)


@query("""WITH d AS (SELECT c_acctbal - lead(c_acctbal) OVER (ORDER BY c_custkey) AS d FROM customer), x AS (SELECT d, abs(d) AS m FROM d WHERE d <> 0), r AS (SELECT d, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0::DOUBLE AS r FROM x)
SELECT count(*) AS n, round(least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0)), 3) AS w FROM r""")
def wilcoxon(spark, d):
    c = I.read(spark, d, "customer").select("c_custkey", "c_acctbal")
    nxt = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_acctbal").alias("b"))
    return rounded(B.wilcoxon(c.join(nxt, "c_custkey"), "c_acctbal", "b"), 3)


@query("""WITH RECURSIVE x AS (SELECT p_brand AS brand, p_size, avg(l_extendedprice) FILTER (l_orderkey % 2 = 0) - avg(l_extendedprice) FILTER (l_orderkey % 2 = 1) AS d FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
r AS (SELECT brand, d, rank() OVER (PARTITION BY brand ORDER BY abs(d)) AS r FROM x WHERE d <> 0), s AS (SELECT brand, count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0))::DOUBLE AS w FROM r GROUP BY brand),
ways(r, v) AS (SELECT 0, list_transform(range(1276), lambda s: (s = 0)::INT::DOUBLE) UNION ALL SELECT r + 1, list_transform(range(1276), lambda s: v[s + 1] + CASE WHEN s > r THEN v[s - r] ELSE 0 END) FROM ways WHERE r < 50)
SELECT brand, n, w, round(least(1, 2 * list_sum(v[1:w::INT + 1]) / pow(2, n)), 6) AS p_value FROM s JOIN ways ON ways.r = n""")
def wilcoxon_exact(spark, d):
    """For each brand: mean prices in even against odd orders, paired by size; a brand has 50 sizes at most, so its test is exact."""
    part = I.read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"), "p_size")
    price = lambda k: F.avg(F.when(F.col("l_orderkey") % 2 == k, F.col("l_extendedprice")))
    t = I.read(spark, d, "lineitem").join(part, "l_partkey").groupBy("brand", "p_size").agg(price(0).alias("a"), price(1).alias("b"))
    return rounded(B.wilcoxon_test(t, "a", "b", "brand"))


# ------------------------------------------------------------------ sets and upserts


@query("""WITH o AS (SELECT c_mktsegment AS model, c_custkey AS k, c_acctbal AS v FROM customer), n AS (SELECT 'BUILDING' AS model, s_suppkey AS k, s_acctbal AS v FROM supplier)
SELECT * FROM o WHERE model NOT IN (SELECT model FROM n) UNION ALL SELECT * FROM n""")
def block_upsert(spark, d):
    old = I.read(spark, d, "customer").select(F.col("c_mktsegment").alias("model"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = I.read(spark, d, "supplier").select(F.lit("BUILDING").alias("model"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return J.upsert(old, new, ["model"])


@query("SELECT 'holdout' AS split, 'holdout::' || o_custkey AS bootstrap_id, o_orderkey AS slide FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT 'external', 'external::' || o_custkey, o_orderkey FROM orders WHERE o_orderpriority NOT LIKE '1%'")
def tagged_union(spark, d):
    o = I.read(spark, d, "orders")
    part = lambda df, name: df.select(F.lit(name).alias("split"), F.concat_ws("::", F.lit(name), F.col("o_custkey").cast("string")).alias("bootstrap_id"), F.col("o_orderkey").alias("slide"))
    one = F.col("o_orderpriority").startswith("1")
    return part(o.where(one), "holdout").unionByName(part(o.where(~one), "external"))


@query("SELECT s_nationkey AS key FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def model_intersection(spark, d):
    a = I.read(spark, d, "supplier").select(F.col("s_nationkey").alias("key"))
    return a.intersect(I.read(spark, d, "customer").select(F.col("c_nationkey").alias("key")))


@query("SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")
def resume_skip(spark, d):
    work = I.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return work.join(I.read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("k")), "k", "left_anti")


@query("SELECT event_type, user_id, first FROM (SELECT event_type, user_id, min(event_id) AS first FROM events GROUP BY ALL)")
def first_seen_distinct(spark, d):
    return I.read(spark, d, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("first"))


@query("SELECT lang, round(avg((x - 1.0::DOUBLE / 4) / (1 - 1.0::DOUBLE / 4)), 6) AS headline FROM (SELECT lang, source, avg((n_chars > 2000)::INT) AS x FROM documents GROUP BY ALL) GROUP BY lang")
def headline_mean(spark, d):
    t = I.read(spark, d, "documents").groupBy("lang", "source").agg(F.avg((F.col("n_chars") > 2000).cast("int")).alias("x"))
    return rounded(t.groupBy("lang").agg(F.avg(S.chance_corrected(F.col("x"), F.lit(4))).alias("headline")))


from aperture import queries_reports  # noqa: E402, F401  registers the rest

"""Queries that evaluate a scored table: documents with a label, and p as a dyadic number from a digest of doc_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.operators import metrics as M
from corpusforge.plans.urls import URL_FEATURES

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def number(key: str, bits: int = 16):
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, bits // 4), 16, 10).cast("long")


def scored(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "lang", "n_chars")
    rows = docs.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    x = number("doc_id")
    p = (F.col("quality") * 12288 + F.floor(x * 3 / 4)) / 65536
    return rows.select("doc_id", "source", "lang", "n_chars", F.col("quality").alias("label"), p.alias("p"), (1 + x % 4).alias("weight"), F.array_compact(F.array(F.when(x % 2 == 0, "even"), F.when(x % 3 == 0, "third"), F.lit("all"))).alias("tags"), (x % 5 == 0).alias("dynamic"))


SCORED = """x AS (SELECT d.doc_id, source, lang, n_chars, quality AS label, ('0x' || substr(md5(d.doc_id::VARCHAR), 1, 4))::BIGINT AS x FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT doc_id, source, lang, n_chars, label, (label * 12288 + floor(x * 3 / 4)) / 65536 AS p, 1 + x % 4 AS weight, list_filter([CASE WHEN x % 2 = 0 THEN 'even' END, CASE WHEN x % 3 = 0 THEN 'third' END, 'all'], lambda t: t IS NOT NULL) AS tags, x % 5 = 0 AS dynamic FROM x),
b AS (SELECT p, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM s GROUP BY p),
c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS pos_ge, sum(neg) OVER (ORDER BY p DESC) AS neg_ge, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM b)"""


def rounded(df, *keep):
    return df.select(*[F.round(c, 9).alias(c) if kind == "double" and c not in keep else c for c, kind in df.dtypes])


RATES = """CASE WHEN tp + fp + tn + fn > 0 THEN round((tp + tn) / (tp + fp + tn + fn), 9) ELSE 0 END AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 9) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 9) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 9) ELSE 0 END AS f1, CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn), 9) END AS fpr, CASE WHEN fn + tp > 0 THEN round(fn / (fn + tp), 9) END AS fnr"""


def counts(hit: str, w: str = "1") -> str:
    return ", ".join(f"coalesce(sum(CASE WHEN label = {y} AND {'' if h else 'NOT '}({hit}) THEN {w} ELSE 0 END), 0)::BIGINT AS {n}" for n, y, h in (("tp", 1, True), ("fp", 0, True), ("tn", 0, False), ("fn", 1, False)))


@query("confusion_by_source", f"WITH {SCORED}, k AS (SELECT source, {counts('p >= 0.5')} FROM s GROUP BY source) SELECT *, {RATES} FROM k")
def _(spark, d):
    return rounded(M.confusion(scored(spark, d), 0.5, "source"))


@query("confusion_weighted", f"WITH {SCORED}, k AS (SELECT {counts('p >= 0.5', 'weight')} FROM s) SELECT *, {RATES} FROM k")
def _(spark, d):
    return rounded(M.confusion(scored(spark, d), 0.5, weight="weight"))


@query("confusion_of_verdict", f"WITH {SCORED}, k AS (SELECT {counts('p >= 0.85')} FROM s) SELECT *, {RATES} FROM k")
def _(spark, d):
    df = scored(spark, d)
    return rounded(M.confusion(df, 0.0, predicted=M.verdict(0.45, 0.85) == "PHISHING"))


@query("ranking", f"WITH {SCORED} SELECT round(sum(neg * (pos_ge - pos + pos / 2)) / (any_value(np) * any_value(nn)), 9) AS roc_auc, round(sum(pos * pos_ge / (pos_ge + neg_ge)) / any_value(np), 9) AS average_precision FROM c")
def _(spark, d):
    return rounded(M.ranking(scored(spark, d)))


@query("brier_by_lang", f"WITH {SCORED} SELECT lang, round(avg((p - label) * (p - label)), 9) AS brier FROM s GROUP BY lang")
def _(spark, d):
    return rounded(M.brier(scored(spark, d), "lang"))


BIN = "(" + " + ".join(f"CASE WHEN p >= {i * (1.0 / 10)!r}::DOUBLE THEN 1 ELSE 0 END" for i in range(1, 10)) + ")"


@query("reliability", f"WITH {SCORED} SELECT {BIN} AS bin, count(*) AS n, count(*)::DOUBLE AS mass, round(avg(p), 9) AS mean_probability, round(avg(label), 9) AS positive_rate FROM s GROUP BY 1")
def _(spark, d):
    return rounded(M.reliability(scored(spark, d)))


@query("calibration_weighted", f"WITH {SCORED}, r AS (SELECT {BIN} AS bin, sum(weight) AS mass, sum(weight * p) / sum(weight) AS mp, sum(weight * label) / sum(weight) AS pr FROM s GROUP BY 1) SELECT round(sum(mass * abs(mp - pr)) / sum(mass), 9) AS ece FROM r")
def _(spark, d):
    return rounded(M.calibration_error(scored(spark, d), weight="weight"))


@query("policy_rates", f"""WITH {SCORED} SELECT source, count(*) AS n, count(*) FILTER (WHERE p < 0.45) AS n_safe, count(*) FILTER (WHERE p >= 0.45 AND p < 0.85) AS n_suspicious, count(*) FILTER (WHERE p >= 0.85) AS n_phishing,
  round(avg((p < 0.45)::INT), 9) AS safe_rate, round(avg((p >= 0.45 AND p < 0.85)::INT), 9) AS suspicious_rate, round(avg((p >= 0.85)::INT), 9) AS phishing_rate, round(coalesce(avg((p < 0.45)::INT) FILTER (WHERE label = 1), 0), 9) AS false_safe,
  round(coalesce(avg((p >= 0.85)::INT) FILTER (WHERE label = 0), 0), 9) AS false_phishing, round(coalesce(avg((p < 0.85)::INT) FILTER (WHERE label = 1), 1), 9) AS fnr FROM s GROUP BY source""")
def _(spark, d):
    return rounded(M.policy_rates(scored(spark, d), 0.45, 0.85, "source"))


@query("verdicts_and_risk", f"WITH {SCORED} SELECT doc_id, CASE WHEN p >= 0.85 THEN 'PHISHING' WHEN p >= 0.45 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict, round_even(greatest(least((p - 0.45::DOUBLE) / 0.4::DOUBLE * 100, 100), 0), 0)::INT AS risk FROM s")
def _(spark, d):
    return scored(spark, d).select("doc_id", M.verdict(0.45, 0.85).alias("verdict"), M.risk_score(0.45, 0.85).alias("risk"))


@query("cohort_errors", f"""WITH {SCORED}, w AS (SELECT unnest(['even', 'third', 'all', 'none']) AS cohort), t AS (SELECT label, p, unnest(tags) AS cohort FROM s),
  k AS (SELECT cohort, count(label) FILTER (WHERE label = 0) AS n_legitimate, count(*) FILTER (WHERE label = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE label = 1) AS n_phishing, count(*) FILTER (WHERE label = 1 AND p < 0.5) AS fn FROM w LEFT JOIN t USING (cohort) GROUP BY cohort)
  SELECT *, CASE WHEN n_legitimate > 0 THEN round(fp / n_legitimate, 9) END AS fpr, CASE WHEN n_phishing > 0 THEN round(fn / n_phishing, 9) END AS fnr FROM k""")
def _(spark, d):
    return rounded(M.cohort_errors(scored(spark, d), 0.5, ["even", "third", "all", "none"]))


@query("one_class", f"WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (WHERE p >= 0.5 AND NOT dynamic) AS detected, count(*) FILTER (WHERE dynamic) AS failed, round(avg((p >= 0.5 AND NOT dynamic)::INT), 9) AS recall, round(avg((NOT (p >= 0.5 AND NOT dynamic))::INT), 9) AS fnr, round(min(p), 9) AS min_p, round(quantile_cont(p, 0.5), 9) AS median_p, round(max(p), 9) AS max_p, NULL::DOUBLE AS fpr FROM s WHERE label = 1")
def _(spark, d):
    return rounded(M.one_class(scored(spark, d).filter("label = 1"), 0.5, ~F.col("dynamic")))


@query("domain_fpr", f"WITH {SCORED}, g AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE p >= 0.5) AS hits FROM s WHERE label = 0 GROUP BY source) SELECT round(sum(hits) / sum(n), 9) AS url_fpr, round(avg((hits > 0)::INT), 9) AS domain_fpr, count(*) AS n_domains FROM g")
def _(spark, d):
    return rounded(M.domain_fpr(scored(spark, d), 0.5, "source"))


DELTAS = [-0.5, -0.25, -0.125, -0.0625, 0.0, 0.0625, 0.125, 0.25, 0.75]


@query("threshold_sweep", f"WITH {SCORED}, t AS (SELECT unnest({DELTAS})::DOUBLE AS delta), k AS (SELECT lang, delta, least(greatest(0.5 + delta, 0), 1) AS threshold, s.* EXCLUDE (lang) FROM s, t) SELECT lang, delta, threshold, {counts('p >= threshold')} FROM k GROUP BY lang, delta, threshold")
def _(spark, d):
    return M.sweep(scored(spark, d), 0.5, DELTAS, "lang")


@query("counterfactuals", f"""WITH {SCORED}, v AS (SELECT source, lang, max(p) AS p FROM s GROUP BY source, lang), h AS (SELECT source, max(p) AS h FROM v WHERE lang = 'en' GROUP BY source), j AS (SELECT lang, p - h AS d, h < 0.5 AND p >= 0.5 AS crossed FROM v JOIN h USING (source) WHERE lang <> 'en')
  SELECT lang, count(*) AS n, round(quantile_cont(d, 0.5), 9) AS median_delta, round(avg(d), 9) AS mean_delta, round(max(d), 9) AS max_delta, round(avg((d > 0)::INT), 9) AS share_up, count(*) FILTER (WHERE crossed) AS crossed, bool_and(d > 0) AS always_up, quantile_cont(d, 0.5) >= 0.1 OR count(*) FILTER (WHERE crossed) * 2 > count(*) AS systematic FROM j GROUP BY lang""")
def _(spark, d):
    variants = scored(spark, d).groupBy("source", "lang").agg(F.max("p").alias("p"))
    return rounded(M.counterfactual(variants, "source", "lang", 0.5, home="en"))


@query("quality_gates", f"""WITH {SCORED}, k AS (SELECT {counts('p >= 0.5')} FROM s), m AS (SELECT tp / (tp + fn) AS recall, fp / (fp + tn) AS fpr FROM k), g AS (SELECT 'recall' AS metric, '>= 0.7' AS requirement, round(recall, 9) AS actual, recall >= 0.7 AS passed FROM m UNION ALL SELECT 'fpr', '<= 0.3', round(fpr, 9), fpr <= 0.3 FROM m)
  SELECT * FROM g UNION ALL SELECT 'overall', 'all', NULL, bool_and(passed) FROM g""")
def _(spark, d):
    return rounded(M.gates(M.confusion(scored(spark, d), 0.5), [("recall", ">=", 0.7), ("fpr", "<=", 0.3)]))


@query("leaderboard", f"""WITH {SCORED}, k AS (SELECT source AS model, {counts('p >= 0.5')} FROM s GROUP BY source), r AS (SELECT *, {RATES} FROM k), bb AS (SELECT source AS model, avg((p - label) * (p - label)) AS brier FROM s GROUP BY source),
  e AS (SELECT source, p, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY source, p), f AS (SELECT *, sum(pos) OVER (PARTITION BY source ORDER BY p DESC) AS pg, sum(neg) OVER (PARTITION BY source ORDER BY p DESC) AS ng, sum(pos) OVER (PARTITION BY source) AS np FROM e), ap AS (SELECT source AS model, sum(pos * pg / (pg + ng)) / any_value(np) AS average_precision FROM f GROUP BY source)
  SELECT model, (row_number() OVER (ORDER BY coalesce(r.fpr, 1) <= 0.5 DESC, coalesce(r.fpr, 1), r.recall DESC, r.f1 DESC, average_precision DESC, brier, model))::INT AS rank FROM r JOIN bb USING (model) JOIN ap USING (model)""")
def _(spark, d):
    df = scored(spark, d).withColumnRenamed("source", "model")
    results = M.confusion(df, 0.5, "model").join(M.ranking(df, "model"), "model").join(M.brier(df, "model"), "model")
    results = rounded(results, "brier", "average_precision").withColumn("fpr", F.coalesce("fpr", F.lit(1.0))).withColumn("passed", F.col("fpr") <= 0.5).withColumn("run", F.lit(1))
    return M.leaderboard(results).select("model", "rank")


def _per_model(rows: str) -> str:
    """CTEs: k, the rates of each model over rows (model, label, p), with ranking and Brier score."""
    return f"""m AS ({rows}), f AS (SELECT model, {counts('p >= 0.5')}, avg((p - label) * (p - label)) AS brier FROM m GROUP BY model),
  pb AS (SELECT model, p, sum(label) AS pos, sum(1 - label) AS neg FROM m GROUP BY model, p), pc AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS pg, sum(neg) OVER (PARTITION BY model ORDER BY p DESC) AS ng FROM pb),
  pr AS (SELECT model, sum(neg * (pg - pos + pos / 2)) / (sum(pos) * sum(neg)) AS roc_auc, sum(pos * pg / (pg + ng)) / sum(pos) AS average_precision FROM pc GROUP BY model),
  k AS (SELECT model, (tp + tn) / (tp + fp + tn + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, fp / (fp + tn) AS fpr, fn / (fn + tp) AS fnr, roc_auc, average_precision, brier
    FROM f JOIN pr USING (model))"""


NINE = ("accuracy", "precision", "recall", "f1", "fpr", "fnr", "roc_auc", "average_precision", "brier")


@query("compare_models", f"WITH {SCORED}, " + _per_model("SELECT 'new' AS model, label, p FROM s UNION ALL SELECT 'old', label, 1 - p FROM s") + ", l AS (" + " UNION ALL ".join(f"SELECT model, '{n}' AS metric, {n}::DOUBLE AS value FROM k" for n in NINE) + """)
  SELECT metric, round(max(value) FILTER (WHERE model = 'old'), 9) AS baseline, round(max(value) FILTER (WHERE model = 'new'), 9) AS candidate, round(max(value) FILTER (WHERE model = 'new') - max(value) FILTER (WHERE model = 'old'), 9) AS delta FROM l GROUP BY metric""")
def _(spark, d):
    df = scored(spark, d)
    both = df.withColumn("model", F.lit("new")).unionByName(df.withColumn("p", 1 - F.col("p")).withColumn("model", F.lit("old")))
    return rounded(M.compare_models(both, 0.5, "model", "old", "new"))


@query("failures", f"WITH {SCORED}, k AS (SELECT *, CASE WHEN label = 0 AND p >= 0.5 THEN 'false_positive' WHEN label = 1 AND p < 0.5 THEN 'false_negative' END AS kind FROM s) SELECT doc_id, kind, (row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'false_positive' THEN p ELSE -p END DESC, doc_id))::INT AS rank FROM k WHERE kind IS NOT NULL QUALIFY rank <= 100")
def _(spark, d):
    return M.failures(scored(spark, d), 0.5, "doc_id").select("doc_id", "kind", "rank")


@query("expectations", f"WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (WHERE label = (p >= 0.5)::INT) AS passed, bool_and(label = (p >= 0.5)::INT) AS all_passed FROM s")
def _(spark, d):
    return M.expectations(scored(spark, d).withColumn("got", (F.col("p") >= 0.5).cast("int")), "label", "got")


@query("parity", "SELECT 0::BIGINT AS only_left, 0::BIGINT AS only_right")
def _(spark, d):
    from corpusforge.functions import features as X
    from corpusforge.functions import urls as U

    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    other = U.normalize(pages.withColumn("url", F.concat(F.lit(" "), F.regexp_replace("url", "^(https?)", "$1")))).select("page_id", "normalized_url")
    paths = [X.url_features(x).select("page_id", *[F.round(c, 9).alias(c) for c in X.MODEL_FEATURES]) for x in (U.normalize(pages).select("page_id", "normalized_url"), other)]
    return M.parity(*paths)


QUANTILES = ", ".join(f"round(quantile_cont(p, {q}), 9) AS {n}" for q, n in ((0.01, "p01"), (0.05, "p05"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")))


@query("distribution", f"WITH {SCORED} SELECT label, count(*) AS n, round(min(p), 9) AS min, {QUANTILES}, round(max(p), 9) AS max, round(avg(p), 9) AS mean FROM s GROUP BY label")
def _(spark, d):
    return rounded(M.distribution(scored(spark, d), "label"))


@query("binned_misses", f"""WITH {SCORED}, l AS (SELECT 'n_chars' AS dimension, CASE WHEN n_chars <= 500 THEN '<=500' WHEN n_chars <= 2000 THEN '(500,2000]' ELSE '>2000' END AS value, p < 0.5 AS miss FROM s WHERE label = 1 UNION ALL SELECT 'dynamic', CASE WHEN dynamic THEN 'yes' ELSE 'no' END, p < 0.5 FROM s WHERE label = 1)
  SELECT dimension, value, count(*) AS samples, count(*) FILTER (WHERE miss) AS missed, round(avg(miss::INT), 9) AS miss_rate FROM l GROUP BY 1, 2""")
def _(spark, d):
    return rounded(M.binned_misses(scored(spark, d).filter("label = 1"), 0.5, {"n_chars": [500, 2000]}, ["dynamic"]))


@query("error_groups", f"WITH {SCORED}, l AS (SELECT 'source' AS group_type, source AS key, * EXCLUDE (source) FROM s UNION ALL SELECT 'lang', lang, * EXCLUDE (source) FROM s) SELECT group_type, key, count(*) AS n, count(*) FILTER (WHERE label = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND p < 0.5) AS fn, round(avg((label <> (p >= 0.5)::INT)::INT), 9) AS error_rate FROM l GROUP BY 1, 2")
def _(spark, d):
    return rounded(M.error_groups(scored(spark, d), 0.5, {"source": "source", "lang": "lang"}))


def _contrast(f: str) -> str:
    kinds = (("false_positive", "label = 0 AND p >= 0.5"), ("correct_legitimate", "label = 0 AND p < 0.5"), ("false_negative", "label = 1 AND p < 0.5"), ("detected", "label = 1 AND p >= 0.5"))
    return f"SELECT '{f}' AS feature, " + ", ".join(f"round(avg({f}) FILTER (WHERE {c}), 9) AS {k}" for k, c in kinds) + " FROM s"


@query("error_contrast", f"WITH {SCORED} {_contrast('n_chars')} UNION ALL {_contrast('weight')}")
def _(spark, d):
    return rounded(M.error_contrast(scored(spark, d), 0.5, ["n_chars", "weight"]))


@query("budget_thresholds", f"""WITH {SCORED}, t AS (SELECT max(p) FILTER (WHERE pos > 0 AND np - pos_ge <= 0.02::DOUBLE * np) AS safe, coalesce(min(p) FILTER (WHERE neg > 0 AND neg_ge <= 0.01::DOUBLE * nn), 1.0) AS phishing FROM c)
  SELECT round(CASE WHEN phishing <= safe THEN least(safe, greatest(phishing - 0.05, 0)) ELSE safe END, 9) AS safe, round(phishing, 9) AS phishing FROM t""")
def _(spark, d):
    return rounded(M.budget_thresholds(scored(spark, d)))


@query("next_negative_threshold", f"""WITH {SCORED}, n AS (SELECT list(p ORDER BY p) FILTER (WHERE label = 1) AS ps FROM s),
  t AS (SELECT coalesce(min(p) FILTER (WHERE neg > 0 AND neg_ge <= floor(0.02::DOUBLE * nn)), 'infinity'::DOUBLE) AS phishing FROM c),
  k AS (SELECT ps[least(floor(0.02::DOUBLE * len(ps))::INT + 1, len(ps))] AS safe, phishing FROM n, t)
  SELECT CASE WHEN phishing <= safe THEN least(safe, greatest(phishing - 0.05, 0)) ELSE safe END AS safe, phishing FROM k""")
def _(spark, d):
    return M.next_negative_threshold(scored(spark, d))


@query("false_positive_threshold", f"WITH {SCORED} SELECT coalesce(max(p) FILTER (WHERE neg_ge > floor(0.05::DOUBLE * nn)), -1) AS above FROM c WHERE neg > 0")
def _(spark, d):
    return M.false_positive_threshold(scored(spark, d), 0.05)


def domain_threshold_sql(limit: str) -> str:
    return f"""WITH {SCORED}, m AS (SELECT source, max(p) AS p FROM s WHERE label = 0 GROUP BY source),
  t AS (SELECT p FROM m UNION SELECT p FROM s WHERE label = 1 UNION SELECT nextafter(1::DOUBLE, 2::DOUBLE)),
  r AS (SELECT t.p, (SELECT count(*) FILTER (WHERE m.p >= t.p) / count(*) FROM m) AS domain_fpr,
    (SELECT count(*) FILTER (WHERE s.p >= t.p) / count(*) FROM s WHERE label = 1) AS recall, (SELECT count(*) FILTER (WHERE s.p >= t.p) / count(*) FROM s WHERE label = 0) AS url_fpr FROM t)
  SELECT p AS phishing, round(recall, 9) AS recall, round(domain_fpr, 9) AS domain_fpr, round(url_fpr, 9) AS url_fpr FROM r WHERE domain_fpr <= {limit}::DOUBLE ORDER BY recall DESC, p DESC LIMIT 1"""


@query("domain_threshold", domain_threshold_sql("0.2"))
def _(spark, d):
    return rounded(M.domain_threshold(scored(spark, d), "source", 0.2), "phishing")


@query("domain_threshold_strict", domain_threshold_sql("0.0"))
def _(spark, d):
    return rounded(M.domain_threshold(scored(spark, d), "source", 0.0), "phishing")


def weighted_threshold_sql(limit: str) -> str:
    return f"""WITH {SCORED}, g AS (SELECT p, sum(CASE WHEN label = 0 THEN weight ELSE 0 END) AS w, count(*) FILTER (WHERE label = 0 AND dynamic) AS d, sum(label) AS y, sum(1 - label) AS c,
    sum(CASE WHEN label = 1 THEN weight ELSE 0 END) AS v FROM (SELECT p, label, weight, dynamic FROM s UNION ALL SELECT 1, 0, 0, false) GROUP BY p),
  h AS (SELECT p, c, y AS here, sum(w) OVER up AS w, sum(d) OVER up AS d, sum(y) OVER up AS y, sum(v) OVER up AS v, sum(w) OVER () AS tw, sum(d) OVER () AS td, sum(y) OVER () AS ty, sum(v) OVER () AS tv
    FROM g WINDOW up AS (ORDER BY p DESC)),
  f AS (SELECT p, y / ty AS recall, w / greatest(tw, 1) AS weighted_fpr, d / td AS dynamic_fpr FROM h WHERE c > 0 AND w / greatest(tw, 1) <= {limit}::DOUBLE AND d <= {limit}::DOUBLE * td ORDER BY y DESC, p LIMIT 1),
  k AS (SELECT coalesce(max(p) FILTER (WHERE here > 0 AND (tv - v) / greatest(tv, 1) <= 0.02::DOUBLE), 0) AS safe FROM h),
  j AS (SELECT k.safe, coalesce(f.p, nextafter(1::DOUBLE, 2::DOUBLE)) AS phishing, f.p IS NOT NULL AS feasible, coalesce(recall, 0) AS recall, weighted_fpr, dynamic_fpr FROM k LEFT JOIN f ON true)
  SELECT round(CASE WHEN safe >= phishing THEN greatest(phishing - 0.000001, 0) ELSE safe END, 9) AS safe, phishing, feasible, round(recall, 9) AS recall, round(weighted_fpr, 9) AS weighted_fpr, round(dynamic_fpr, 9) AS dynamic_fpr FROM j"""


@query("weighted_threshold", weighted_threshold_sql("0.2"))
def _(spark, d):
    return rounded(M.weighted_threshold(scored(spark, d), "weight", "dynamic", 0.2), "phishing")


@query("weighted_threshold_strict", weighted_threshold_sql("0.0"))
def _(spark, d):
    return rounded(M.weighted_threshold(scored(spark, d), "weight", "dynamic", 0.0), "phishing")


@query("guarded_threshold", f"""WITH {SCORED}, t AS (SELECT p, pos_ge / np AS recall, neg_ge / nn AS fpr, pos_ge / (pos_ge + neg_ge) AS precision FROM c WHERE p > 0.25) SELECT p AS phishing, round(recall, 9) AS recall, round(fpr, 9) AS fpr, recall >= 0.9 AS guard_met FROM t
  ORDER BY recall >= 0.9 DESC, CASE WHEN recall >= 0.9 THEN fpr END, CASE WHEN recall < 0.9 THEN -recall END, fpr, recall DESC, precision DESC, p DESC LIMIT 1""")
def _(spark, d):
    return rounded(M.guarded_threshold(scored(spark, d), 0.25, 0.9), "phishing")


def grid_threshold_sql(limit: str, rows: str = "s") -> str:
    return f"""WITH {SCORED}, v AS (SELECT * FROM {rows}), t AS (SELECT p FROM v UNION SELECT 0.05 + i * (0.999::DOUBLE - 0.05) / 1999 FROM range(1999) r(i) UNION SELECT 0.999),
  k AS (SELECT t.p, count(*) FILTER (WHERE label = 1 AND v.p >= t.p) / count(*) FILTER (WHERE label = 1) AS recall, count(*) FILTER (WHERE label = 0 AND v.p >= t.p) / count(*) FILTER (WHERE label = 0) AS fpr FROM t, v GROUP BY t.p),
  w AS (SELECT * FROM k WHERE fpr <= {limit}::DOUBLE ORDER BY recall DESC, fpr, p DESC LIMIT 1)
  SELECT w.p AS phishing, round(recall, 9) AS recall, round(fpr, 9) AS fpr, w.p IS NOT NULL AS feasible FROM (SELECT 1) o LEFT JOIN w ON true"""


@query("grid_threshold", grid_threshold_sql("0.1"))
def _(spark, d):
    return rounded(M.grid_threshold(scored(spark, d), 0.1), "phishing")


@query("grid_threshold_end", grid_threshold_sql("0.0", "(SELECT label, (label + 1) / 4 AS p FROM s UNION ALL SELECT 0, 0.75)"))
def _(spark, d):
    df = scored(spark, d)
    flat = df.select("label", ((F.col("label") + 1) / 4).alias("p"))
    return rounded(M.grid_threshold(flat.unionByName(spark.range(1).select(F.lit(0).alias("label"), F.lit(0.75).alias("p"))), 0.0), "phishing")


@query("grid_threshold_none", grid_threshold_sql("0.0", "(SELECT label, 1.0::DOUBLE AS p FROM s)"))
def _(spark, d):
    return rounded(M.grid_threshold(scored(spark, d).select("label", F.lit(1.0).alias("p")), 0.0), "phishing")


@query("worst_groups", f"""WITH {SCORED}, l AS (SELECT 'n_chars' AS dimension, CASE WHEN n_chars <= 500 THEN '<=500' WHEN n_chars <= 2000 THEN '(500,2000]' ELSE '>2000' END AS value, p < 0.5 AS miss FROM s WHERE label = 1 UNION ALL SELECT 'dynamic', CASE WHEN dynamic THEN 'yes' ELSE 'no' END, p < 0.5 FROM s WHERE label = 1)
  SELECT dimension, value, count(*) AS samples, count(*) FILTER (WHERE miss) AS missed, round(avg(miss::INT), 9) AS miss_rate FROM l GROUP BY 1, 2 ORDER BY missed DESC, miss_rate DESC, dimension, value LIMIT 4""")
def _(spark, d):
    return rounded(M.worst_groups(M.binned_misses(scored(spark, d).filter("label = 1"), 0.5, {"n_chars": [500, 2000]}, ["dynamic"]), 4))


@query("selection_score", f"WITH {SCORED}, k AS (SELECT {counts('p >= 0.5')} FROM s), r AS (SELECT tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, fp / (fp + tn) AS fpr FROM k), a AS (SELECT sum(pos * pos_ge / (pos_ge + neg_ge)) / any_value(np) AS ap FROM c), bb AS (SELECT avg((p - label) * (p - label)) AS brier FROM s) SELECT round(0.35::DOUBLE * recall + 0.25::DOUBLE * ap + 0.2::DOUBLE * f1 - 0.3::DOUBLE * fpr - 0.1::DOUBLE * brier, 9) AS score FROM r, a, bb")
def _(spark, d):
    df = scored(spark, d)
    one = M.confusion(df, 0.5).crossJoin(M.ranking(df)).crossJoin(M.brier(df))
    return rounded(one.select(M.selection_score().alias("score")))


@query("line_item_ranking", """WITH b AS (SELECT l_discount AS p, sum((l_returnflag = 'R')::INT) AS pos, sum((l_returnflag <> 'R')::INT) AS neg FROM lineitem GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS pg, sum(neg) OVER (ORDER BY p DESC) AS ng, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM b)
  SELECT round(sum(neg * (pg - pos + pos / 2)) / (any_value(np) * any_value(nn)), 9) AS roc_auc, round(sum(pos * pg / (pg + ng)) / any_value(np), 9) AS average_precision FROM c""")
def _(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_discount").cast("double").alias("p"))
    return rounded(M.ranking(items))


def _item(id_: str, severity: str, polarity: str, feature: str) -> str:
    return f"'{id_}:{severity}:{polarity}:{feature}:' || \"{feature}\"::DOUBLE::VARCHAR"


EVIDENCE = ", ".join(f"CASE WHEN {c} THEN {_item(*i)} END" for c, i in (
    ('"IsHTTPS" = 1', ("https_enabled", "info", "neutral", "IsHTTPS")), ('"IsHTTPS" = 0', ("http_scheme", "warning", "negative", "IsHTTPS")), ('"IsDomainIP" = 1', ("ip_host", "danger", "negative", "IsDomainIP")),
    ('"HasSuspiciousToken" = 1', ("suspicious_token", "warning", "negative", "HasSuspiciousToken")), ('"HasUserInfo" = 1', ("userinfo", "danger", "negative", "HasUserInfo")), ('"HasPort" = 1', ("explicit_port", "warning", "negative", "HasPort")),
    ('"URLPercentEncodingCount" > 0', ("encoding", "warning", "negative", "URLPercentEncodingCount")), ('"SubdomainDepth" >= 3', ("deep_subdomains", "warning", "negative", "SubdomainDepth")),
))


@query("evidence", f"WITH f AS ({URL_FEATURES}) SELECT page_id, list_filter([{EVIDENCE}], lambda x: x IS NOT NULL) AS evidence FROM f")
def _(spark, d):
    from corpusforge.functions import features as X
    from corpusforge.functions import urls as U

    df = X.url_features(U.normalize(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")))
    return df.select("page_id", F.transform(M.evidence(), lambda e: F.concat_ws(":", e["id"], e["severity"], e["polarity"], e["feature"], e["value"].cast("string"))).alias("evidence"))


#: Routes by page_id, and whether the built-in policy covers them.
ROUTES = (
    ("https://chatgpt.com/", True), ("https://www.netflix.com/watch/81?trackId=7&ctx=a", True), ("https://www.netflix.com/watch/81?trackId=x", False), ("https://www.netflix.com/watch/81?u=1", False), ("https://netflix.com.evil.test/browse", False),
    ("https://amazon.com/some-name/dp/B012345678/ref", True), ("https://amazon.com/dp/B01", False), ("https://www.indiacode.nic.in/handle/123456789/1999", True), ("http://127.0.0.1/x", True), ("https://mail.google.com/mail/u/0/?continue=x", False),
    ("https://www.canva.com/templates?a=https://b.test", False), ("https://user@www.canva.com/templates", False), ("http://www.canva.com/templates", False), ("https://www.youtube.com:8443/", False), ("https://gemini.google.com/app", True),
)


@query("route_policy", "SELECT page_id, " + "CASE page_id % 15 " + " ".join(f"WHEN {i} THEN {str(ok).lower()}" for i, (_, ok) in enumerate(ROUTES)) + " END AND page_id % 4 <> 0 AS policy_applied FROM pages WHERE page_id % 15 <> 8 UNION ALL SELECT page_id, true FROM pages WHERE page_id % 15 = 8")
def _(spark, d):
    url = F.element_at(F.array(*[F.lit(u) for u, _ in ROUTES]), (F.col("page_id") % len(ROUTES) + 1).cast("int"))
    df = spark.read.parquet(f"{d}/pages.parquet").select("page_id", url.alias("normalized_url"), F.when(F.col("page_id") % 4 == 0, 0.2).otherwise(0.9).alias("p"))
    return M.route_policy(df, M.official_policy(spark), 0.45).select("page_id", "policy_applied")


@query("legitimate_only", f"""WITH {SCORED}, g AS (SELECT p, unnest(['all', 'source'] || list_transform(tags, lambda t: 'tag')) AS facet, unnest(['all', source] || tags) AS key FROM s WHERE label = 0)
  SELECT facet, key, count(*) AS n, count(*) FILTER (WHERE p < 0.3) AS safe, count(*) FILTER (WHERE p >= 0.3 AND p < 0.6) AS suspicious, count(*) FILTER (WHERE p >= 0.6) AS phishing, round(avg((p >= 0.6)::INT), 9) AS fpr, round(min(p), 9) AS min_p, round(avg(p), 9) AS avg_p, round(max(p), 9) AS max_p FROM g GROUP BY 1, 2""")
def _(spark, d):
    return rounded(M.legitimate_only(scored(spark, d).filter("label = 0"), 0.3, 0.6, {"source": "source"}, "tags"))


@query("hard_recall", f"WITH {SCORED}, h AS (SELECT p, unnest(tags) AS tag FROM s WHERE label = 1 AND source NOT IN (SELECT source FROM s WHERE doc_id % 100 = 0)) SELECT tag, count(*) AS samples, count(*) FILTER (WHERE p >= 0.5) AS detected, round(avg((p >= 0.5)::INT), 9) AS recall FROM h GROUP BY tag")
def _(spark, d):
    df = scored(spark, d)
    return rounded(M.hard_recall(df, 0.5, "tags", "source", df.filter("doc_id % 100 = 0")))


@query("coverage", f"WITH {SCORED}, t AS (SELECT label, unnest(tags) AS tag FROM s WHERE NOT (dynamic AND label = 0)), w AS (SELECT unnest(['even', 'third', 'none']) AS tag), k AS (SELECT w.tag, count(*) FILTER (WHERE label = 0) AS l, count(*) FILTER (WHERE label = 1) AS p FROM w LEFT JOIN t USING (tag) GROUP BY w.tag) SELECT bool_and(l = 0 AND p > 0) AS supports, count(*) FILTER (WHERE l = 0) AS tags_without_legitimate FROM k")
def _(spark, d):
    rows = scored(spark, d).filter("NOT (dynamic AND label = 0)")
    counts_ = rows.select("label", F.explode("tags").alias("tag")).groupBy("tag", "label").agg(F.count("*").alias("n"))
    return M.coverage(counts_, ["even", "third", "none"])


@query("meaningful_improvement", f"""WITH {SCORED}, k AS (SELECT source, 100 * (count(*) FILTER (WHERE label = 0 AND p >= 0.5) / count(*) FILTER (WHERE label = 0)) AS fpr, 100 * (count(*) FILTER (WHERE label = 1 AND p >= 0.5) / count(*) FILTER (WHERE label = 1)) AS recall FROM s GROUP BY source),
  w AS (SELECT source, CASE WHEN isnan(fpr) THEN NULL ELSE fpr END AS fpr, CASE WHEN isnan(recall) THEN NULL ELSE recall END AS recall FROM k), z AS (SELECT source, coalesce(fpr, 0) AS fpr, coalesce(recall, 0) AS recall FROM w)
  SELECT a.source AS candidate, b.source AS incumbent, CASE WHEN a.recall >= 60 AND b.recall < 60 THEN true ELSE (b.fpr - a.fpr >= 0.2::DOUBLE AND a.recall >= b.recall - 1) OR (a.recall - b.recall >= 1 AND a.fpr <= b.fpr + 0.2::DOUBLE) END AS improves
  FROM z a JOIN z b ON a.source <> b.source""")
def _(spark, d):
    rates = M.confusion(scored(spark, d), 0.5, "source").select("source", (100 * F.col("fpr")).alias("fpr"), (100 * F.when(F.col("tp") + F.col("fn") > 0, F.col("recall"))).alias("recall"))
    a, b = (rates.select(*[F.col(c).alias(f"{c}_{x}") for c in rates.columns]) for x in "ab")
    pairs = a.join(b, F.col("source_a") != F.col("source_b"))  # one row a source on each side
    return pairs.select(F.col("source_a").alias("candidate"), F.col("source_b").alias("incumbent"), M.improves(F.col("fpr_a"), F.col("recall_a"), F.col("fpr_b"), F.col("recall_b"), 60.0).alias("improves"))


@query("report_metrics", f"WITH {SCORED} SELECT doc_id, round(p, 6) AS recall, CASE WHEN dynamic THEN round(p, 6) END AS fpr, NULL::DOUBLE AS precision, NULL::DOUBLE AS roc_auc, NULL::DOUBLE AS average_precision, NULL::DOUBLE AS brier, false AS complete FROM s")
def _(spark, d):
    number_ = F.round("p", 6).cast("string")
    text = F.when(F.col("dynamic"), F.concat(F.lit('{"metrics":{"recall":'), number_, F.lit(',"fpr":'), number_, F.lit("}}"))).otherwise(F.concat(F.lit('{"recall":"x","test":{"recall":'), number_, F.lit("}}")))
    return M.report_metrics(scored(spark, d).withColumn("report", text), "doc_id", "report")


@query("dynamic_coverage", f"WITH {SCORED} SELECT label, count(*) AS n, count(*) FILTER (WHERE dynamic) AS n_dynamic FROM s GROUP BY label")
def _(spark, d):
    return scored(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.count_if("dynamic").alias("n_dynamic"))


@query("select_candidate", f"WITH {SCORED}, " + _per_model("SELECT lang AS model, label, p FROM s WHERE lang IS NOT NULL") + """, z AS (SELECT model, 0.35::DOUBLE * recall + 0.25::DOUBLE * average_precision + 0.2::DOUBLE * f1 - 0.3::DOUBLE * fpr - 0.1::DOUBLE * brier AS score FROM k WHERE fpr < 0.9::DOUBLE),
  h AS (SELECT arg_max(model, (score, model)) AS best, max(score) AS best_score, max(score) FILTER (WHERE model = 'en') AS held FROM z) SELECT CASE WHEN held IS NOT NULL AND best_score - held <= 0.01::DOUBLE THEN 'en' ELSE best END AS model, round(best_score, 9) AS best_score, round(held, 9) AS held FROM h""")
def _(spark, d):
    df = scored(spark, d).withColumnRenamed("lang", "model")
    metrics = M.confusion(df, 0.5, "model").join(M.ranking(df, "model"), "model").join(M.brier(df, "model"), "model").withColumn("passed", F.col("fpr") < 0.9)
    return rounded(M.select_candidate(metrics, "en", 0.01))


QUERIES, ORACLE_SQL = Q, S

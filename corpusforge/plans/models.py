"""Queries that fit and apply models to pages (URL features) and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions import features as X
from corpusforge.functions import urls as U
from corpusforge.operators import metrics as M
from corpusforge.operators import models as O
from corpusforge.operators.boosting import HistBoosting
from corpusforge.operators.scratch import materialise

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


#: The 29 features that models see.
COLUMNS = list(X.MODEL_FEATURES)


def table(spark, d):
    """URL features with label 1 for pages whose URL has a query or is long: something a model can learn.

    A scratch table, since models, curves and metrics read it many times, and features take longer than all of them. Nothing is
    joined or shuffled before, so that features are computed in as many tasks as the pages have splits.
    """
    df = U.normalize(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url"))
    df = X.url_features(df.withColumn("site", F.regexp_extract(U.analysis_url(F.col("normalized_url")), "^[a-z]+://([^/?#]*)", 1)))
    return materialise(df.select("page_id", "url", "site", *[F.col(c).cast("double").alias(c) for c in COLUMNS], ((F.col("QueryLength") > 0) | (F.col("URLLength") > 45)).cast("int").alias("label"), U.hash_bucket(F.col("page_id").cast("string")).alias("bucket")))


def fitted(spark, d, estimator=None, df=None):
    df = table(spark, d) if df is None else df
    train, calibration, test = df.filter("bucket < 60"), df.filter("bucket >= 60 AND bucket < 80"), df.filter("bucket >= 80")
    from pyspark.ml import Pipeline

    model = Pipeline(stages=[O.numeric(COLUMNS), estimator or O.logistic(train.count())]).fit(train)
    return model, calibration, test


@query("model_metrics")
def _(spark, d):
    model, calibration, test = fitted(spark, d)
    raw, calibrated = O.probability(model.transform(test)), O.Calibrated(model, calibration).transform(test)
    parts = []
    for name, scored in (("raw", raw), ("calibrated", calibrated)):
        scored = scored.select("label", "p")
        parts.append(M.confusion(scored, 0.5).crossJoin(M.ranking(scored)).crossJoin(M.brier(scored)).withColumn("model", F.lit(name)))
    return parts[0].unionByName(parts[1])


@query("tree_models")
def _(spark, d):
    df, parts = table(spark, d), []
    for name, estimator in (("forest", O.forest()), ("boosting", O.boosting())):
        model, _, test = fitted(spark, d, estimator, df)
        parts.append(M.ranking(O.probability(model.transform(test)).select("label", "p")).withColumn("model", F.lit(name)))
    return parts[0].unionByName(parts[1])


@query("hist_boosting")
def _(spark, d):
    df = table(spark, d)
    model = HistBoosting(COLUMNS, rounds=40, l2=1.0).fit(df.filter("bucket < 60"))
    scored = model.transform(df.filter("bucket >= 80")).select("label", "p")
    return M.ranking(scored).crossJoin(M.brier(scored))


@query("feature_importance")
def _(spark, d):
    model, _, _ = fitted(spark, d)
    return O.importance(model, COLUMNS, spark, 5)


@query("substitutions")
def _(spark, d):
    model, _, test = fitted(spark, d)
    return O.substitutions(model, test, "page_id", COLUMNS, dict.fromkeys(COLUMNS, 0.0))


@query("permutation_importance")
def _(spark, d):
    model, _, test = fitted(spark, d)
    return O.permutation_importance(model, test.select("page_id", "label", *COLUMNS), COLUMNS, "page_id")


@query("stacked_model")
def _(spark, d):
    df = table(spark, d)
    train, calibration, test = df.filter("bucket < 60"), df.filter("bucket >= 60 AND bucket < 80"), df.filter("bucket >= 80")
    from pyspark.ml import Pipeline

    for name, columns in (("p_length", COLUMNS[:4]), ("p_shape", COLUMNS[4:])):
        one = O.Calibrated(Pipeline(stages=[O.numeric(columns), O.logistic(train.count())]).fit(train), calibration)
        calibration, test = (one.transform(x).withColumnRenamed("p", name).drop("raw_p", "_x", "features") for x in (calibration, test))
    scored = O.Stacked(calibration, ["p_length", "p_shape"]).transform(test)
    blended = O.blend(test, {"p_length": 0.7, "p_shape": 0.3}, "p")
    return M.ranking(scored.select("label", "p")).withColumn("model", F.lit("stacked")).unionByName(M.ranking(blended.select("label", "p")).withColumn("model", F.lit("blend")))


@query("ablation")
def _(spark, d):
    df = table(spark, d)
    return O.ablation(df.filter("bucket < 60"), df.filter("bucket >= 80"), COLUMNS, ["URLLength", "PathLength", "QueryLength", "FragmentLength"], O.logistic(1))


@query("url_decisions")
def _(spark, d):
    model, _, _ = fitted(spark, d)

    class Scores:
        def transform(self, df):
            return O.probability(model.transform(df))

    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    policy = spark.createDataFrame([("thther.example.org", "/en/.*")], "host string, path_pattern string")
    return O.score_urls(pages, Scores(), 0.45, 0.85, policy).select("page_id", "reject_reason", "policy_applied", "verdict", "risk_score", F.size("evidence").alias("n_evidence"))


@query("gram_frequency", """WITH g AS (SELECT DISTINCT page_id, substr(url, i, n) AS gram FROM (SELECT page_id, url, unnest([3, 4, 5]) AS n FROM pages) t, LATERAL (SELECT unnest(range(1, length(url) - n + 2)) AS i)) SELECT gram, count(*) AS df FROM g GROUP BY gram HAVING count(*) >= 2""")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.explode(F.array_distinct(O.char_grams(F.col("url"), 3, 5))).alias("gram"))
    return pages.groupBy("gram").agg(F.count("*").alias("df")).filter("df >= 2")


@query("tfidf")
def _(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", O.char_grams(F.col("url"), 3, 5).alias("grams"))
    v = O.nonzeros("tfidf")
    return O.TfIdf().fit(pages).transform(pages).select("page_id", v["n"].alias("n_terms"), F.round(v["norm"], 6).alias("norm"))


@query("counterfactual_variants", "WITH o AS (SELECT DISTINCT regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) AS base_url FROM pages), v AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}')" for k, t in O.VARIANTS.items()) + ") x(variant_type, tail)) SELECT base_url, variant_type, base_url || tail AS url FROM o, v")
def _(spark, d):
    return O.variants(spark.read.parquet(f"{d}/pages.parquet").select("url"), "url")


QUERIES, ORACLE_SQL = Q, S

"""Text and feature models on MLlib: n-gram TF-IDF, weighted classifiers, calibration, scoring, importance, variants."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.operators import metrics as M


def char_grams(text: Column, low: int, high: int) -> Column:
    """All character n-grams of the lengths low to high, in order."""
    one = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*[one(n) for n in range(low, high + 1)]))


@F.udf(VectorUDT())  # one small helper per row; MLlib has no sublinear counts, and vectors do not travel in Arrow batches
def _sublinear(v):
    return SparseVector(v.size, v.indices, 1.0 + np.log(v.values))


@F.udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("norm", T.DoubleType())]))  # as small; vector_to_array would make the vector dense
def nonzeros(v):
    """Entries above 0 of a sparse vector, and the sum of its squares."""
    return int((v.values > 0).sum()), float(v.values @ v.values)


class TfIdf:
    """TF-IDF over an array of terms: terms in min_df rows, the ``top`` most frequent, 1 + ln tf, ln((1 + n) / (1 + df)) + 1, unit length."""

    def __init__(self, terms: str = "grams", out: str = "tfidf", min_df: int = 2, top: int = 30_000):
        self.terms, self.out, self.min_df, self.top = terms, out, min_df, top

    def fit(self, df: DataFrame) -> TfIdf:
        self.counts = CountVectorizer(inputCol=self.terms, outputCol="_tf", minDF=self.min_df, vocabSize=self.top).fit(df)
        idf = IDF(inputCol="_tf", outputCol="_w").fit(self.counts.transform(df)).idf
        self.scale = ElementwiseProduct(scalingVec=Vectors.dense([x + 1.0 for x in idf]), inputCol="_s", outputCol="_w")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        weighed = self.scale.transform(self.counts.transform(df).withColumn("_s", _sublinear("_tf")))
        return Normalizer(inputCol="_w", outputCol=self.out).transform(weighed).drop("_tf", "_s", "_w")


def numeric(columns: list[str], out: str = "features", mean: bool = True, extra: str | None = None) -> Pipeline:
    """Standardised columns, followed by a further vector column."""
    stages = [VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="error"), StandardScaler(inputCol="_x", outputCol="_z" if extra else out, withMean=mean)]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=["_z", extra], outputCol=out)] if extra else stages)


def logistic(rows: int, c: float = 1.0, weight: str | None = None, features: str = "features") -> LogisticRegression:
    return LogisticRegression(featuresCol=features, labelCol="label", regParam=1.0 / (c * max(rows, 1)), maxIter=200, **({"weightCol": weight} if weight else {}))


def forest(trees: int = 80, leaf: int = 2, seed: int = 42, weight: str | None = None) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="label", numTrees=trees, minInstancesPerNode=leaf, maxDepth=12, seed=seed, **({"weightCol": weight} if weight else {}))


def boosting(rounds: int = 100, rate: float = 0.08, depth: int = 5, seed: int = 42, weight: str | None = None) -> GBTClassifier:
    return GBTClassifier(labelCol="label", maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed, **({"weightCol": weight} if weight else {}))


def probability(scored: DataFrame, out: str = "p") -> DataFrame:
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


class Calibrated:
    """A model with Platt scaling: a logistic curve over its probability, fitted on rows of its own."""

    def __init__(self, model, calibration: DataFrame, weight: str | None = None):
        self.model = model
        raw = self._raw(calibration)
        self.curve = LogisticRegression(featuresCol="_v", labelCol="label", maxIter=200, **({"weightCol": weight} if weight else {})).fit(raw)

    def _raw(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=["raw_p"], outputCol="_v").transform(probability(self.model.transform(df), "raw_p"))

    def transform(self, df: DataFrame) -> DataFrame:
        return probability(self.curve.transform(self._raw(df))).withColumn("p", F.greatest(F.least("p", F.lit(1.0)), F.lit(0.0))).drop("_v")


def blend(df: DataFrame, weights: dict[str, float], out: str = "raw_p") -> DataFrame:
    return df.withColumn(out, reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights.items()]))


class Stacked:
    """A logistic curve over the scores of several calibrated models, fitted on rows of their calibration part (label, the scores, an optional weight)."""

    def __init__(self, scored: DataFrame, columns: list[str], weight: str | None = None):
        self.assembler = VectorAssembler(inputCols=columns, outputCol="_v")
        self.curve = LogisticRegression(featuresCol="_v", labelCol="label", maxIter=1000, **({"weightCol": weight} if weight else {})).fit(self.assembler.transform(scored))

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        return probability(self.curve.transform(self.assembler.transform(df)), out).drop("_v")


def ablation(train: DataFrame, test: DataFrame, columns: list[str], without: list[str], estimator) -> DataFrame:
    """(variant, n_features, roc_auc, average_precision) of a model refitted without some columns beside the full one."""
    parts = []
    for name, kept in (("full", columns), ("without", [c for c in columns if c not in without])):
        model = Pipeline(stages=[numeric(kept), estimator]).fit(train)
        scored = probability(model.transform(test)).select("label", "p")
        parts.append(M.ranking(scored).select(F.lit(name).alias("variant"), F.lit(len(kept)).alias("n_features"), "*"))
    return parts[0].unionByName(parts[1])


def importance(model, columns: list[str], spark, top: int = 10) -> DataFrame:
    """(feature, importance) of trees or absolute coefficients, normalised to 1, the highest first."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    total = float(values.sum()) or 1.0
    return spark.createDataFrame([(c, float(v) / total) for c, v in zip(columns, values)], "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


#: Rows that are exchanged among each other, and ordered in one task.
BUCKET_ROWS = 10_000


def exchanged(df: DataFrame, columns: list[str], key: str, repeats: int, rows: int) -> DataFrame:
    """Each row once a feature and repeat, (feature, repeat) and df's columns, with the feature's value of another row.

    A repeat is one exchange of whole rows: they get places by two hash orders within hash buckets of the key, so no task
    orders all rows, and the row at the same place gives the value.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(max(1, rows // BUCKET_ROWS)))
    many = df.withColumn("_b", bucket).withColumn("repeat", F.explode(F.array(*[F.lit(r) for r in range(repeats)])))
    place = lambda side: F.row_number().over(Window.partitionBy("_b", "repeat").orderBy(F.xxhash64(key, F.lit(side), "repeat"), key))
    left = many.withColumn("_n", place(0))
    right = many.withColumn("_n", place(1)).select("_b", "repeat", "_n", F.struct(*columns).alias("_other"))
    one = lambda f: F.struct(F.lit(f).alias("feature"), *[(F.col("_other")[c] if c == f else F.col(c)).alias(c) for c in columns])
    rest = [c for c in df.columns if c not in columns]
    long = left.join(right, ["_b", "repeat", "_n"]).select(*rest, "repeat", F.explode(F.array(*[one(f) for f in columns])).alias("_x"))
    return long.select(*rest, "repeat", "_x.*")


def permutation_importance(model, df: DataFrame, columns: list[str], key: str, repeats: int = 3) -> DataFrame:
    """(feature, mean_drop, std_drop) of average precision when one column is exchanged between rows. All exchanges are scored in one pass."""
    base = M.ranking(probability(model.transform(df))).select(F.col("average_precision").alias("_base"))
    scored = probability(model.transform(exchanged(df, columns, key, repeats, df.count())))
    found = M.ranking(scored, "feature", "repeat").crossJoin(F.broadcast(base))  # one row
    drop = F.col("_base") - F.col("average_precision")
    return found.groupBy("feature").agg(F.avg(drop).alias("mean_drop"), F.stddev_pop(drop).alias("std_drop"))


def substitutions(model, df: DataFrame, key: str, columns: list[str], neutral: dict[str, float]) -> DataFrame:
    """(key, feature, delta): from a neutral vector, what each single feature of a row changes in p. One row per feature, scored in one pass."""
    base = probability(model.transform(df.sparkSession.createDataFrame([tuple(float(neutral[c]) for c in columns)], ", ".join(f"`{c}` double" for c in columns)))).first()["p"]
    one = lambda f: F.struct(F.lit(f).alias("feature"), *[(F.col(c).cast("double") if c == f else F.lit(float(neutral[c]))).alias(c) for c in columns])
    changed = F.array_compact(F.array(*[F.when(F.col(c) != neutral[c], one(c)) for c in columns]))
    rows = df.select(key, F.explode(changed).alias("s")).select(key, "s.*")
    return probability(model.transform(rows)).select(key, "feature", (F.col("p") - base).alias("delta"))


#: The shapes of a counterfactual URL, after the origin.
VARIANTS = {"homepage": "/", "path": "/products/item", "query": "/?q=test", "multi-query": "/?q=test&page=2&sort=asc", "encoded": "/?q=hello%20world", "fragment": "/#section", "path+query": "/products/item?q=test"}


def variants(df: DataFrame, url: str) -> DataFrame:
    """(base_url, variant_type, url): each distinct origin in every shape."""
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    shapes = F.array(*[F.struct(F.lit(k).alias("variant_type"), F.lit(v).alias("tail")) for k, v in VARIANTS.items()])
    rows = df.select(origin.alias("base_url")).filter("base_url <> ''").distinct().select("base_url", F.explode(shapes).alias("v"))
    return rows.select("base_url", "v.variant_type", F.concat("base_url", "v.tail").alias("url"))


def score_urls(df: DataFrame, model, safe: float, phishing: float, policy: DataFrame | None = None, url: str = "url") -> DataFrame:
    """df with the whole decision: normalised URL or reason, p, effective_p, verdict, risk and evidence. Rows with a reason have none of the rest.

    The model transforms the feature columns to p. URLs of more than 2048 characters are rejected.
    """
    from corpusforge.functions import features as X
    from corpusforge.functions import urls as U

    rows = U.normalize(df, url)
    long = F.length(url) > 2048
    rows = rows.withColumn("reject_reason", F.when(long, "url_too_long").otherwise(F.col("reject_reason"))).withColumn("normalized_url", F.when(~long, F.col("normalized_url")))
    scored = model.transform(X.url_features(rows))
    scored = M.route_policy(scored, policy, safe) if policy is not None else scored.withColumn("policy_applied", F.lit(False)).withColumn("effective_p", F.col("p"))
    ok = F.col("reject_reason").isNull()
    found = {"verdict": M.verdict(safe, phishing, "effective_p"), "risk_score": M.risk_score(safe, phishing, "effective_p"), "evidence": M.evidence(), "p": F.col("p"), "effective_p": F.col("effective_p")}
    return scored.select(*df.columns, "normalized_url", "reject_reason", "policy_applied", *[F.when(ok, c).alias(n) for n, c in found.items()])

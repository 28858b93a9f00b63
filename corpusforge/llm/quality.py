"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded as shares of character classes
and word statistics, then as h = tanh(W x). Gated attention weighs the passages of a document,
a = softmax(w . (tanh(V h) * sigmoid(U h))), and the weighted sum of their h gives the logit of the label.
Only document labels are known; the attention learns which passages decide.

Training takes a sample of at most TRAINING_DOCS labelled documents, the first in the order of a hash of
doc_id; they are encoded on the executors and only their passage features come to the driver. Scoring
encodes every passage of every whole text in Arrow batches with the broadcast weights, a few KB.

Defined cases: null and empty texts are one passage without words and are scored as such; a null doc_id is
neither held out nor learned from; rows without a label are not learned from; without both labels the score is the share of label 1
(0.5 without any); repeated rows score alike; an empty table gives an empty table; further columns pass
through keep_good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.llm.common import documents, materialise, rows_of
from corpusforge.llm.langid import fold

PASSAGE = 64
TRAINING_DOCS = 4096
HIDDEN, GATE = 16, 8
EPOCHS, RATE, DECAY = 300, 0.02, 1e-3
THRESHOLD = 0.3
#: Characters with a class of their own; the others are lower, upper, digit, white space, other ASCII, beyond ASCII.
SINGLE = b".,!*#$%&|\n?-:@/"
CLASSES = 6 + len(SINGLE)
FEATURES = CLASSES + 5


def _classes() -> np.ndarray:
    table = np.full(256, 4, dtype=np.int64)
    table[128:] = 5
    for chars, k in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), ((9, 10, 11, 12, 13, 32), 3)):
        table[list(chars)] = k
    for k, b in enumerate(SINGLE):
        table[b] = 6 + k
    return table


TABLE = _classes()


def passages(text: str) -> np.ndarray:
    """One row of FEATURES numbers for each passage of PASSAGE words of a whole text."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    words = text.encode().split()
    n = max(1, -(-len(words) // PASSAGE))
    out = np.zeros((n, FEATURES))
    if not words:
        return out
    kinds = TABLE[data]
    space = kinds == 3
    space |= data == 10
    starts = ~space
    starts[1:] &= space[:-1]
    passage = np.maximum(np.cumsum(starts) - 1, 0) // PASSAGE
    counts = np.bincount(passage * CLASSES + kinds, minlength=n * CLASSES).reshape(n, CLASSES)
    total = counts.sum(1, keepdims=True)
    out[:, :CLASSES] = counts / total
    for i in range(n):
        part = words[i * PASSAGE : (i + 1) * PASSAGE]
        out[i, CLASSES] = len(set(part)) / len(part)
        out[i, CLASSES + 1] = sum(a == b for a, b in zip(part, part[1:])) / len(part)
        out[i, CLASSES + 2] = np.log1p(len(part)) / 4
        out[i, CLASSES + 3] = min(1.0, total[i, 0] / len(part) / 20)
    out[:, CLASSES + 4] = np.log1p(n) / 5
    return out


class Model:
    """Weights, scoring and training; all sums over a document run on the rows between its starts."""

    def __init__(self, weights: dict[str, np.ndarray] | None, prior: float = 0.5):
        self.w, self.prior = weights, prior

    def forward(self, x: np.ndarray, starts: np.ndarray):
        w = self.w
        h = np.tanh(((x - w["mean"]) / w["scale"]) @ w["W"] + w["b"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (v * u) @ w["a"]
        size = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), size))
        a = e / np.repeat(np.add.reduceat(e, starts), size)
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, v, u, a, z, size, z @ w["c"] + w["d"]

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.w is None or not bags:
            return np.full(len(bags), self.prior)
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return 1 / (1 + np.exp(-np.clip(self.forward(np.concatenate(bags), starts)[-1], -30, 30)))


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Full-batch Adam on the log loss."""
    prior = float(labels.mean()) if len(labels) else 0.5
    if prior in (0.0, 1.0) or not len(labels):
        return Model(None, prior)
    x, starts = np.concatenate(bags), np.cumsum([0, *map(len, bags[:-1])])
    rng = np.random.default_rng(seed)
    p = {"W": rng.normal(0, 0.3, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)),
         "a": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.array(np.log(prior / (1 - prior)))}
    model = Model(p | {"mean": x.mean(0), "scale": x.std(0) + 1e-3})
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    standard = (x - model.w["mean"]) / model.w["scale"]
    for step in range(1, EPOCHS + 1):
        h, v, u, a, z, size, logit = model.forward(x, starts)
        g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / len(labels)
        dz = np.repeat(g[:, None] * model.w["c"], size, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), size))
        dvu = de[:, None] * model.w["a"]
        dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
        dh = (a[:, None] * dz + dv @ model.w["V"].T + du @ model.w["U"].T) * (1 - h * h)
        grads = {"W": standard.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "a": (v * u).T @ de, "c": z.T @ g, "d": np.array(g.sum())}
        for k, grad in grads.items():
            grad = grad + DECAY * model.w[k] * (k not in "bd")
            m[k], s[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * s[k] + 0.001 * grad**2
            model.w[k] = model.w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([passages(t).ravel() for t in texts])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = TRAINING_DOCS) -> Model:
    """Learn from labelled documents outside fold 0."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y")).filter("y IN (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    known = known.filter(F.coalesce(fold("id") != 0, F.lit(True)))
    chosen = materialise(known.orderBy(F.xxhash64("id"), "id").limit(sample))
    # at most ``sample`` ids and labels: a broadcast of bounded size
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = texts.select("id", "y", _features("text").alias("x")).orderBy("id", "x").limit(sample).toLocalIterator()
    bags, ys = [], []
    for row in rows:
        bags.append(np.asarray(row.x, dtype=np.float32).astype(float).reshape(-1, FEATURES))
        ys.append(row.y)
    return train(bags, np.array(ys))


def quality_score(spark: SparkSession, model: Model, text: Column) -> Column:
    sent = spark.sparkContext.broadcast((model.w, model.prior))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        learned = Model(*sent.value)
        for texts in batches:
            out = np.zeros(len(texts))
            for i in range(0, len(texts), 256):  # so many bags at once in memory
                out[i : i + 256] = learned.score([passages(t) for t in texts[i : i + 256]])
            yield pd.Series(out)

    return score(F.coalesce(text, F.lit("")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns."""
    model = fit(docs, labels, text, doc_id)
    scored = docs.select(rows_of(docs).alias("row"), quality_score(docs.sparkSession, model, F.col(text)).alias("score"))
    return scored.filter(F.col("score") >= threshold).select("row.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), quality_score(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

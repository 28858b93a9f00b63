"""Histogram boosting beside a plain version that makes one split at a time."""

import numpy as np
import pytest

from corpusforge.operators import boosting as B


def plain(x, y, w, cuts, rounds, rate, leaves, l2, least):
    """Scores after boosting, the best leaf split first, every sum from the rows themselves."""
    bins = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)
    score = np.full(len(y), np.log((w * y).sum() / (w * (1 - y)).sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (p - y), w * p * (1 - p)

        def split(rows):
            best = None
            for f in range(x.shape[1]):
                for cut in range(bins[:, f].max()):
                    low, high = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                    if min(len(low), len(high)) < least or min(h[low].sum(), h[high].sum()) < B.LEAST_HESSIAN:
                        continue
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + l2) * k for s, k in ((low, 1), (high, 1), (rows, -1)))
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, low, high)
            return best

        parts = [(np.arange(len(y)), split(np.arange(len(y))))]
        while len(parts) < leaves and any(s for _, s in parts):
            at = max((i for i in range(len(parts)) if parts[i][1]), key=lambda i: parts[i][1][0])
            _, (_, low, high) = parts.pop(at)
            parts += [(low, split(low)), (high, split(high))]
        for rows, _ in parts:
            score[rows] -= rate * g[rows].sum() / (h[rows].sum() + l2)
    return 1 / (1 + np.exp(-score))


@pytest.mark.parametrize("weight, l2, leaves", [(None, 0.0, 31), ("w", 2.0, 5)])
def test_equals_the_plain_version(spark, weight, l2, leaves):
    rng = np.random.default_rng(4)
    x = np.stack([rng.normal(size=160).round(2), rng.integers(0, 4, 160).astype(float), np.full(160, 3.0)], axis=1)
    y = (x[:, 0] + 0.7 * (x[:, 1] == 2) + rng.normal(scale=0.6, size=160) > 0.2).astype(int)
    w = rng.uniform(0.5, 2.0, 160)
    df = spark.createDataFrame([(*map(float, r), int(t), float(v)) for r, t, v in zip(x, y, w)], "a double, b double, c double, label int, w double").repartition(3)
    model = B.HistBoosting(["a", "b", "c"], rounds=3, rate=0.3, leaves=leaves, l2=l2, least=8, weight=weight).fit(df)
    want = plain(x, y, w if weight else np.ones(160), model.cuts, 3, 0.3, leaves, l2, 8)
    assert np.allclose(model.scores(x), want, atol=1e-9)
    assert all(len(t.value) <= leaves for t in model.trees) and max(len(t.value) for t in model.trees) > 3
    got = {(r.a, r.b): r.p for r in model.transform(df).collect()}
    assert all(abs(got[a, b] - p) < 1e-9 for (a, b, _), p in zip(x.tolist(), want))


def test_one_class_and_nothing_to_split(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "a double, label int")
    with pytest.raises(ValueError):
        B.HistBoosting(["a"]).fit(df)
    model = B.HistBoosting(["a"], rounds=5).fit(spark.createDataFrame([(1.0, 1), (1.0, 0)], "a double, label int"))
    assert len(model.trees) == 1 and model.scores(np.array([[1.0]])).tolist() == [0.5]

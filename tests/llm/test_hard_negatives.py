import math
import random
from fractions import Fraction
from itertools import count

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import hard_negatives as H
from corpusforge.llm import topk_search as T

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=5, positives=5, share=80):
    low, high = -(2**63), 2**63 - 1
    good = [(i, n, [math.floor(256 * Fraction(x)) for x in v], c) for n, (i, v, c) in zip(count(), rows) if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for i, n, v, c in good:
        if i is None or i % 100:
            continue
        scored = [(min(max(sum(a * b for a, b in zip(v, w)), low), high), j, m, d) for j, m, w, d in good if m != n and len(w) == len(v)]
        mine = sorted((x for x in scored if x[3] == c), key=order)[:positives]
        for p in mine:
            rest = sorted((x for x in scored if x[3] != c and share * p[0] <= 100 * x[0] <= 100 * p[0]), key=order)[:k]
            out += [(i, p[1], r + 1, x[1], p[0], x[0]) for r, x in enumerate(rest)]
    return sorted(out, key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % 100 == 0, **more).collect()), key=str)


@pytest.mark.parametrize("sizes", [(4, 16, 2, 3), (4096, 16384, 512, 4096)])
def test_matches_brute_force(spark, monkeypatch, sizes):
    for name, n in zip(("QUERY_GROUP", "SHARD_GROUP", "QUERY_TILE", "SHARD_TILE"), sizes):
        monkeypatch.setattr(H, name, n)
    monkeypatch.setattr(T, "FAN_IN", 3)
    rng = random.Random(5)
    # few values, so that scores tie; a third of the rows has one label, one vector stands in a third of them
    vector = lambda: [rng.choice([-0.25, 0.0, 0.25, 0.5]) for _ in range(5)]
    rows = [(i, [0.5] * 5 if i % 3 == 0 else vector(), 0 if rng.random() < 0.34 else rng.randrange(1, 5)) for i in range(0, 2000, 4)]
    rows += [(7, None, 1), (9, [None] * 5, 1), (11, [float("nan")] * 5, 1), (13, vector(), None), (None, vector(), 1), (None, vector(), 2), (300, vector(), 2), (15, [0.5, 0.5], 2), (17, [], 2), (2100, [0.5, 0.25], 3), (2101, [0.5, 0.25], 3)]
    want = brute(rows)
    assert got(spark, rows) == want and len(want) > 60
    assert got(spark, rows, k=2, positives=3, share=50) == brute(rows, 2, 3, 50)


def test_large_ids_beside_null_ids(spark):
    big = 1 << 60
    start = big - big % 100
    rows = [(start, [0.5, 0.25], 1), (start + 1, [0.5, 0.5], 1), (start + 3, [0.5, 0.125], 2), (start + 5, [0.5, 0.125], 2), (None, [0.5, 0.25], 2)]
    assert got(spark, rows, share=70) == brute(rows, share=70) and (start, start + 1, 3, start + 5, 24576, 18432) in brute(rows, share=70)


def test_large_components_and_negative_scores(spark):
    rows = [(0, [1e306, 1.0], 1), (1, [1e306, 0.0], 1), (2, [1e307, 0.0], 2), (3, [3e12, 1.0], 2), (100, [-1.0, 0.0], 1), (101, [1.0, 0.0], 1), (102, [1.0, 0.0], 2)]
    assert got(spark, rows) == brute(rows)


def test_empty_and_clashing_columns(spark):
    assert got(spark, []) == []
    assert got(spark, [(0, [0.5], 1), (1, None, 1)]) == []
    rows = [(0, [0.5], 1), (1, [0.5], 1), (2, [0.5], 2), (2, [0.5], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("rid", "v", "dim", "q", "qg", "sg", "score", "rank", "none", "slot", "limits")})
    assert sorted(tuple(r) for r in H.hard_negatives(df, F.col("vec_id") == 0).collect()) == [(0, 1, 1, 2, 16384, 16384), (0, 1, 2, 2, 16384, 16384)]


def test_slots():
    high, low = H.slots([[100, 90, 10], [50]], 80)
    assert high.tolist() == [[100, 90, 10], [50, -1, -1]] and low.tolist() == [[91, 72, 8], [40, 0, 0]]
    assert H.first_of(np.array([1, 0, 1, 1]), np.array([5, 1, 7, 7]), np.array([0, 1, 3, 2]), 2).tolist() == [1, 3, 2]

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusforge.llm import topk_search as T


def brute(rows, k=5):
    ok = [(i, n, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, n, v in ok:
        if i is not None and i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j if j is not None else 0, m) for j, m, w in ok if m != n and len(w) == len(v))[:k]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j, m) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize("groups", [(4, 16, 2, 3), (4096, 16384, 512, 4096)])
def test_matches_brute_force(spark, monkeypatch, groups):
    for name, n in zip(("QUERY_GROUP", "SHARD_GROUP", "QUERY_TILE", "SHARD_TILE"), groups):
        monkeypatch.setattr(T, name, n)
    monkeypatch.setattr(T, "FAN_IN", 3)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, -0.1, 0.0, 0.3, 0.7]) for _ in range(6)]) for i in range(0, 160)]
    rows += [(None, [0.7] * 6), (500, None), (550, [float("nan")] * 6), (600, [None] * 6), (650, [float("inf")] * 6), (700, [0.1, 0.2]), (701, [0.5, 0.5]), (50, [0.7] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = [tuple(r) for r in T.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    want = brute([(i, None if v is None else [None if x is None else float(__import__("numpy").float32(x)) for x in v]) for i, v in rows])
    assert sorted(got, key=str) == want


def test_large_components_stay_exact(spark):
    rows = [(0, [3e12, 1.0]), (1, [3e12, 1.0]), (2, [3e12, 0.5]), (3, [1e30, 0.0])]
    got = [tuple(r) for r in T.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()]
    assert sorted(got)[0][2] == 1 and [r[2] for r in sorted(got)] == [1, 2, 3]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert T.top_k(df, F.col("vec_id") % 50 == 0).count() == 0


def test_clashing_columns_and_nulls(spark):
    rows = [(0, [0.5, 0.25]), (0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, None), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("rid", "v", "dim", "q", "qg", "sg", "score", "rank", "query_id")})
    got = sorted(tuple(r) for r in T.top_k(df, F.col("vec_id") == 0, k=2).collect())
    # of equal vectors the other row with the same id comes first, its own row never
    assert got == [(0, 1, None, 128 * 256 + 64 * 256), (0, 1, None, 128 * 256 + 64 * 256), (0, 2, 0, 128 * 128 + 64 * 64), (0, 2, 0, 128 * 128 + 64 * 64)]


def test_all_finite_components(spark):
    rows = [(0, [1e306, 1.0]), (1, [1e307, 1.0]), (2, [-1e307, 0.5]), (3, [1e-300, 0.5])]
    got = [tuple(r) for r in T.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()]
    assert [(r, j) for _, r, j, _ in sorted(got)] == [(1, 1), (2, 3), (3, 2)]
    assert [s for *_, s in sorted(got)] == [2**63 - 1, 256 * 128, -(2**63)]


def test_large_ids_beside_null_ids(spark):
    big = (1 << 60) + 24  # divisible by 50
    rows = [(big, [0.5]), (big + 1, [0.5]), (big + 3, [0.25]), (None, [0.5]), (None, [0.25])]
    got = [tuple(r) for r in T.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1), F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == sorted(brute(rows)) and [r[2] for r in sorted(got)] == [big + 1, None, big + 3, None]

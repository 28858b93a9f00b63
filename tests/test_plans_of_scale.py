"""Percentiles, first rows and indexed search: the same rows as plain versions, by plans that split hot groups."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusforge.operators import corpus as O
from corpusforge.operators import log as L
from corpusforge.operators import trigrams as T
from corpusforge.operators.boosting import HistBoosting
from corpusforge.operators.percentiles import percentiles
from corpusforge.operators.scratch import materialise
from corpusforge.plans import models


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_percentiles_equal_the_plain_ones(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.gauss(0, 1), 0.25, float(rng.randrange(5)), None])) for g in ("hot", "hot", "hot", "b", None) for _ in range(400)] + [("one", 2.0), ("none", None), ("two", 1.0), ("two", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    names = {"p01": 0.01, "p25": 0.25, "median": 0.5, "p95": 0.95, "low": 0.0, "high": 1.0}
    out = percentiles(df, ["g"], "v", names, F.count("v").alias("n"))
    assert "percentile(" not in plan(out)
    for r in out.collect():
        values = [v for g, v in rows if g == r.g and v is not None]
        assert r.n == len(values)
        for name, q in names.items():
            assert (r[name] is None) if not values else abs(r[name] - np.percentile(values, 100 * q)) < 1e-12, (r.g, name)
    (whole,) = percentiles(df, [], "v", {"median": 0.5}).collect()
    assert abs(whole.median - np.median([v for _, v in rows if v is not None])) < 1e-12
    assert percentiles(df.limit(0), [], "v", {"median": 0.5}, F.count("v").alias("n")).collect()[0].asDict() == {"n": 0, "median": None}


def test_first_rows_of_a_hot_key(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.randrange(300), f"u{rng.randrange(40)}") for i in range(600)]
    df = spark.createDataFrame(rows, "i long, k string, line long, v string").repartition(6)
    number = F.row_number().over(Window.partitionBy("k").orderBy("line", "i"))
    plain = {r.i for r in df.withColumn("n", number).filter("n = 1").collect()}
    marked = O.mark_first(df, ["k"], "i", "first").collect()
    assert len(marked) == len(rows) and {r.i for r in marked if r.first} == {min(x[0] for x in rows if x[1] == k) for k in ("hot", "a", "b", None)}
    # of rows that tie for the first place just one is it
    tied = O.mark_first(df.withColumn("line", F.lit(1)), ["k"], "line", "first")
    assert sorted(str(r.k) for r in tied.collect() if r.first) == ["None", "a", "b", "hot"]
    assert {r.i for r in O.keep_first(df, ["k"], "line", "i").collect()} == plain
    physical = O.keep_first(df, ["k"], "line", "i")._jdf.queryExecution().executedPlan().toString()
    assert physical.count("WindowGroupLimit") == 2  # one of them in the map tasks


def test_indexed_search_gives_the_same_rows(spark, tmp_path):
    rows = [(i, t, a) for i, (t, a) in enumerate([("Paypal-Login", ["x"]), ("pay_pal 100%", []), (None, ["ELF", None, "Mirai"]), ("ab", None), ("", ["a_b"]), ("Straße İstanbul", ["日本語の"]), ("pal pay", ["login"])])]
    df = spark.createDataFrame(rows, "i long, t string, a array<string>")
    T.write_postings(T.postings(df, "i", ["t"], ["a"]), f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    for text in ("PAY", "pal", "a", "_p", "100%", "mirai", "straße", "istanbul", "i̇stan", "本語の", "login", "", None, "paypal-log", "nothing", "y_p"):
        for raw in (False, True):
            found = T.search(df, index, "i", text, ["t"], ["a"], raw)
            assert sorted(r.i for r in found.collect()) == sorted(r.i for r in df.filter(L.search_condition(text, ["t"], ["a"], raw)).collect()), (text, raw)
            assert ("parquet" in plan(found)) == bool(any(len(p) > 2 for p in ((text or "").replace("%", "_").split("_") if raw else [text or ""])))


def test_statistics_of_many_indicators(spark):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id"))
    state = spark.range(20_000).select(at.alias("first_seen_at"), at.alias("ingested_at"), (F.col("id") % 2).cast("string").alias("status")).repartition(3)
    row = L.feed_stats(state, "2024-01-01 05:33:20", ["status"]).first()
    assert (row.total, row.new_24h, row.new_1h, row.by_status) == (20_000, 20_000, 3600, {"0": 10_000, "1": 10_000}) and str(row.latest) == "2024-01-01 05:33:19"


def test_features_of_models_are_a_table_made_without_a_shuffle(spark, monkeypatch):
    made = []
    monkeypatch.setattr(models, "materialise", lambda df: made.append(plan(df)) or materialise(df))
    df = models.table(spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and "Join" not in made[0] and "Aggregate" not in made[0]
    assert "html" not in plan(df) and "regexp" not in plan(df) and df.count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()


def test_boosting_plans_do_not_grow_with_trees(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 17), float(i % 5), int(i % 17 > 6) ^ int(i % 5 == 2)) for i in range(400)], "a double, b double, label int")
    sizes, real = [], type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, *a, **k: sizes.append(len(plan(out := real(self, *a, **k)).splitlines())) or out)
    model = HistBoosting(["a", "b"], rounds=4, rate=0.3, leaves=8, least=5).fit(df)
    assert len(model.trees) == 4 and max(len(t.value) for t in model.trees) > 4
    assert max(sizes[3:]) == sizes[2] and len(sizes) > 8  # binned rows, scores, then sums, step after step

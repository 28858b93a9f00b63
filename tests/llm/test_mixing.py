import pytest

from corpusforge.llm import mixing as M
from tests.llm.data import SCHEMA, prose


def table(spark, per_source):
    rows, i = [], 0
    for source, texts in per_source.items():
        for t in texts:
            rows.append((i, t, "en", source, None))
            i += 1
    return spark.createDataFrame(rows, SCHEMA)


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by filling up step by step."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        out = {s: most * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in order}
        over = [s for s in free if out[s] > most * sizes[s] + 1e-9]
        if not over:
            return out
        capped.update(over)


@pytest.mark.parametrize("rows_per_bucket", [3, 2000])
def test_targets_and_taken(spark, rows_per_bucket):
    df = table(spark, {"a": [prose(20 + i % 7, i) for i in range(120)], "b": [prose(9, 500 + i) for i in range(10)], "c": [prose(30, i) for i in range(60)], None: [prose(5, i) for i in range(4)], "d": [None, ""]})
    rows = M.mix_sizes(df, rows_per_bucket=rows_per_bucket).collect()
    src = {r.doc_id: s for r, s in zip(df.collect(), [x.source for x in df.collect()])}
    sizes, taken, largest = {}, {}, {}
    for r in rows:
        s = src[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r["size"])
        assert r.taken <= 3 * r["size"] and r.taken % max(r["size"], 1) == 0
    want = filled(sizes)
    for r in rows:
        s = src[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = M.mix_sizes(df.repartition(5), rows_per_bucket=rows_per_bucket).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_repeats_documents(spark):
    df = table(spark, {"a": [prose(10, i) for i in range(5)], "b": [prose(10, 50 + i) for i in range(40)]})
    taken = {r.doc_id: r.taken // 10 for r in M.mix_sizes(df).collect()}
    out = M.mix(df)
    assert out.columns == df.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in taken.items() if v}


def test_heavier_documents_come_first(spark):
    good, bad = [prose(10, i) for i in range(150)], ["9 8 7 6 5 4 3 2 1 0"] * 150
    df = table(spark, {"a": [prose(10, 999)], "b": good + bad})
    rows = M.mix_sizes(df).collect()
    taken = lambda lo, hi: sum(r.taken for r in rows if lo <= r.doc_id < hi)
    assert taken(1, 151) > taken(151, 301)


def test_empty_and_clashes(spark):
    df = table(spark, {})
    assert M.mix_sizes(df).count() == 0 and M.mix(df).count() == 0
    from pyspark.sql import functions as F

    one = table(spark, {"a": [prose(10, 1)]}).withColumns({c: F.lit("x") for c in ("src", "key", "size", "cut", "row", "epochs")})
    assert M.mix(one).columns == one.columns


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(None, prose(10, 1), "a"), (None, prose(10, 1), "a"), (1, prose(10, 2), "a"), (1, prose(10, 2), "a"), (1, prose(10, 2), "b"), (2, prose(60_000, 3), "a"), (3, None, "a"), (4, " \n", None), (5, prose(10, 4), None)]
    df = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], SCHEMA)
    got = M.mix_sizes(df.repartition(4)).collect()
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == [0, 0, 10, 10, 10, 10, 10, 10, 60_000]
    assert all(r.taken <= 3 * r["size"] for r in got)
    sizes = filled({"a": 60_040, "b": 10, None: 10})
    assert {r.source_size: r.target for r in got}[60_040] == pytest.approx(sizes["a"])
    # rows alike in doc_id, source and size are taken together
    assert len({r.taken for r in got if r.doc_id is None}) == 1 and len({r.taken for r in got if r.doc_id == 1 and r.source_size > 100}) == 1
    assert sum(r.taken // max(r["size"], 1) for r in got if r["size"]) == M.mix(df).filter("text RLIKE '[a-z]'").count()


def test_plan_has_no_python(spark):
    df = table(spark, {"a": [prose(10, 1)], "b": [prose(10, 2)]})
    for out in (M.mix_sizes(df), M.mix(df)):
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
